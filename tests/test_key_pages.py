"""Root pages merged with their key pages, against a plain loop over parsed pages."""

import pytest

from lodestone.operators import crawl
from lodestone.operators.parse import parse
from lodestone.plans import pipeline
from lodestone.sources.html import read_pages

LINKS = '<a href="/contacto">Contacto</a><a href="/precios">Precios</a><a href="/servicios">Servicios</a><a href="/about">About</a><a href="/reservas">Reserva</a><a href="/sedes">Sedes</a><a href="/empleo">Empleo</a>'
PAGES = [
    (1, "https://a.es/", f"<title>Taller A</title><html lang='es'>{LINKS} coches 20-05-2023"),
    (2, "https://a.es/contacto", '<title>Contacto</title><a href="mailto:hola@a.es">m</a><a href="tel:+34911223344">t</a>' + " largo" * 400),
    (3, "https://a.es/contacto", '<a href="mailto:later@a.es">copy of the URL</a>'),
    (4, "https://a.es/precios", '<meta name="description" content="Precios"><form></form><a href="/reservas">Reserva</a> Calle Mayor 12, Madrid 11111111 '),
    (5, "https://a.es/servicios", '<a href="mailto:nunca@a.es">after enough</a> servicios'),
    (6, "https://a.es/empleo", "sixth by rank"),
    (7, "https://b.es/", '<title>B</title><a href="/contact">Contact</a><a href="/about">About</a> uno'),
    (8, "https://b.es/about", '<p>Empresa B</p><a href="mailto:info@b.es">m</a>'),
    (9, "https://instagram.com/acme", '<a href="/acme/contact">contact</a> servicios'),
    (10, "https://instagram.com/acme/contact", '<a href="mailto:x@acme.com">m</a>'),
    (11, None, None),
]
COUNTS = ["invalid_phone_candidates_count"]


def merged(base: dict, new: dict) -> dict:
    out = {}
    for c in [*crawl.LISTS, *crawl.TEXTS, *COUNTS, "form_detected", "phone_validation_rejections"]:
        a, b = base.get(c), new.get(c)
        if c in crawl.LISTS:
            both = [*(a or []), *(b or [])]
            out[c] = [x for i, x in enumerate(both) if x not in both[:i]]
        elif c == "phone_validation_rejections":
            out[c] = {k: (a or {}).get(k, 0) + (b or {}).get(k, 0) for k in {**(a or {}), **(b or {})}}
        elif c in COUNTS:
            out[c] = (a or 0) + (b or 0)
        else:
            out[c] = a or b
    return out


def crawled(root: dict, at_hand: dict) -> dict:
    order = ["contact", "locations", "pricing", "booking", "services", "about", "careers", "other"]
    words = {"contact": ["contact"], "locations": ["location", "ubicacion", "sede"], "pricing": ["pricing", "precio", "cotiza"], "booking": ["book", "reserv", "agenda", "cita"], "services": ["servic"], "about": ["about", "nosotros", "equipo"], "careers": ["career", "trabajo", "empleo"]}
    kind = lambda u: next((k for k, ws in words.items() if any(w in u.lower() for w in ws)), "other")
    gathered, texts, seen = {}, [], []
    if root["primary_identity_type"] != "social_profile":
        for url in sorted(set(root["internal_links"]), key=lambda u: (order.index(kind(u)), u))[:5]:
            if (page := at_hand.get(url)) is None:
                continue
            texts += [f"[{kind(url).upper()}] {page['clean_text'][:1200]}"] if page["clean_text"] else []
            gathered = merged(gathered, page)
            seen.append((url, kind(url)))
            if (gathered["emails"] or gathered["phones"] or gathered["form_detected"]) and gathered["addresses"] and (gathered["primary_cta"] or gathered["booking_url"] or gathered["pricing_page_url"]):
                break
    return merged(root, gathered) | {"clean_text": "\n\n".join([root["clean_text"], *(["\n\n".join(texts)] if texts else [])]), "crawled_pages": seen}


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id bigint, url string, html string")


def test_metadata_is_merged_with_key_pages(pages):
    parsed = sorted((r.asDict(recursive=True) for r in parse(read_pages(pages)).collect()), key=lambda r: -r["page_id"])
    at_hand = {r["url"]: r for r in parsed}
    got = {r["page_id"]: r.asDict(recursive=True) for r in pipeline.metadata(pages).collect()}
    assert sorted(got) == [p[0] for p in PAGES]
    for root in parsed:
        row, want = got[root["page_id"]], crawled(root, at_hand)
        row["crawled_pages"] = [(c["url"], c["page_type"]) for c in row["crawled_pages"]]
        for c, v in want.items():
            assert (row[c] or None) == (v or None), (root["page_id"], c)
    assert [c[1] for c in got[1]["crawled_pages"]] == ["contact", "pricing"] and got[1]["emails"] == ["hola@a.es"]
    assert got[9]["crawled_pages"] == [] and got[9]["emails"] == []
    assert got[7]["clean_text"].endswith("uno\n\n[ABOUT] Empresa B m")


def test_prospect_uses_what_only_key_pages_say(pages):
    rows = pipeline.prospects(pages, {"target_language": "es"})
    assert {r["page_id"]: r["primary_email"] for r in rows.where("page_id IN (1, 7)").collect()} == {1: "hola@a.es", 7: "info@b.es"}
    kinds = {(r["url"], r["page_type"]) for r in pipeline.sinks(rows.where("page_id = 7"), "2024-01-01")["prospect_pages"].collect()}
    assert ("https://b.es/about", "about") in kinds


def test_null_and_repeated_ids_keep_their_rows(spark):
    """One row out for each row in, whatever the ids; hits that repeat don't multiply pages."""
    rows = [(1, "https://a.es/", f"<title>A</title>{LINKS}"), (1, "https://c.es/", "<title>C</title>react-dom"), (None, "https://n.es/", '<title>N</title><a href="/contacto">c</a>'), (None, "https://n.es/contacto", '<a href="mailto:hola@n.es">m</a>')]
    rows += [rows[0], (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    hits = spark.createDataFrame([("https://a.es/", "t2", "s"), ("https://a.es/", "t1", "s")], "url string, title string, snippet string")
    out = pipeline.metadata(pages, hits).collect()
    assert sorted((r["page_id"] or 0, r["url"] or "") for r in out) == sorted((p or 0, u or "") for p, u, _ in rows)
    by = {(r["page_id"], r["url"]): r for r in out}
    assert by[1, "https://c.es/"]["html_stack"] == ["React"] and by[1, "https://a.es/"]["html_stack"] == []
    assert by[None, "https://n.es/"]["emails"] == ["hola@n.es"]
    assert by[1, "https://a.es/"]["discovery_title"] == "t1"
    assert pipeline.prospects(pages, {"target_niche": "x"}, hits).count() == len(rows)


def test_nodes_at_any_depth():
    from lodestone.sources.html import nodes_of

    block = '[{"@type": "Organization", "@graph": [{"@graph": [[{"email": "a@b.es"}]], "address": "x"}, 5]}, {"telephone": "1"}]'
    assert [sorted(n) for n in nodes_of(block)] == [["@graph", "@type"], ["@graph", "address"], ["email"], ["telephone"]]
    assert nodes_of("{broken") == [] and nodes_of("[" * 100_000) == [] and nodes_of("3") == []
