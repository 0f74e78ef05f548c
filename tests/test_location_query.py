"""The location query over whole tables, against a plain loop."""

import re

from lodestone.operators.quality import _fold, country_aliases
from lodestone.plans.rule_queries import _PLACES, location_parse
from lodestone.rules import quality as rules
from lodestone.rules.countries import COUNTRIES

ALIASES = country_aliases()
POSTAL = re.compile(r"\b[A-Z]{0,2}\d{4,6}[A-Z]{0,3}\b", re.IGNORECASE)
TEXTS = ["Calle Luna 3, 28013 Madrid, España https://a.es/x y más texto", "Visit us | Av. Brasil 99 | Lima | PE", "tel 600111222; Bogotá; Colombia", "Cuzco\nPerú", "palabras, " * 60 + "Madrid", "a@b.es, 912345678, Sevilla", "ES", None, "   ", "Rosario, Rosario, AR"]


def country_of(text):
    f = _fold(text or "")
    return next((n for a, n in ALIASES if a == f), None) or next((n for a, n in ALIASES if len(a) > 2 and f" {a} " in f" {f} "), None) if f else None


def short(text):
    return " ".join(text.split())[:120]


def noise(c):
    f = _fold(c)
    return not f or "@" in c or c.lower().startswith(("http://", "https://", "www.")) or any(h in f" {f} " for h in rules.LOCATION_NOISE) or (len(re.sub(r"\D", "", c)) >= 8 and not re.search(r"[A-Za-zÁÉÍÓÚáéíóúÑñ]", c))


def own(c, country):
    names = next(([key, name, *targets, *codes] for key, name, targets, codes, *_ in COUNTRIES if name == country), [])
    return country is not None and _fold(c) in {_fold(country), *map(_fold, names)}


def plain(text):
    raw = re.sub(r"[\n\r\t|;]+", ", ", re.sub(r"(?i)https?://\S+", " ", (text or "").strip()))
    raw = re.sub(r"\s+", " ", raw).strip(" ,.-")[:240]
    if not raw:
        return (None,) * 6
    country, code, places = country_of(raw), POSTAL.search(raw), []
    for chunk in map(short, re.split(r"[,\n]", raw)):
        if not chunk or noise(chunk):
            continue
        country = country or country_of(chunk)
        cleaned = " ".join(POSTAL.sub(" ", chunk).split()).strip(" ,.-")
        if cleaned and not own(cleaned, country):
            places.append(cleaned)
    places = [c for c in places if not any(f" {h} " in f" {_fold(c)} " for h in rules.STREETS)] or places
    city = places[-1] if places else None
    region = places[-2] if len(places) > 1 and _fold(places[-2]) != _fold(city) else None
    code = code and code.group(0).upper()
    parts = [" ".join(filter(None, (code, city)))] if code or city else []
    if region and _fold(region) not in map(_fold, [*parts, country or ""]):
        parts.append(region)
    if country and _fold(country) not in map(_fold, parts):
        parts.append(country)
    return raw, country, code, city, region, ", ".join(parts)[:160] or None


def test_location_parse_reads_all_documents(spark, tmp_path):
    texts = dict(enumerate(TEXTS, 1))
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    shown = lambda k, v: (v or "") + (f", {_PLACES[k % len(_PLACES)]}" if v is not None and len(v) < 150 else "")
    want = {k: plain(shown(k, v)) for k, v in texts.items()} | {-i - 1: plain(p) for i, p in enumerate(_PLACES)}
    rows = location_parse(spark, str(tmp_path)).collect()
    got = {r["id"]: (r["l_raw"], r["l_country"], r["l_postal"], r["l_city"], r["l_region"], r["formatted"]) for r in rows}
    assert len(rows) == len(want)
    for k, v in want.items():
        assert got[k] == v, texts.get(k)
