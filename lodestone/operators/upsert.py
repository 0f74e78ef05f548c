"""Sinks: keyed upserts as snapshots, unpivots of contacts and pages, anti-join backfills, source names.

Parquet has no MERGE: an upsert reads the old snapshot and the incoming rows and gives the new snapshot, to be written elsewhere.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import quoted

#: Fixed values.
SOURCE_TYPES = ["duckduckgo_search", "brave_search", "mock_search", "seed_url", "manual", "enrichment"]
SOURCE_ALIASES = {"mock": "mock_search", "verification": "manual", "url_list": "seed_url", "ddg": "duckduckgo_search", "brave": "brave_search"}
METHODS = ["search_query", "seed_url", "manual", "enrichment"]
METHOD_ALIASES = {"verification": "manual", "url_list": "seed_url", "ddg": "search_query"}
CONTACT_COLUMNS = [
    ("email", "email", "primary_email", True), ("phone", "phone", "primary_phone", True), ("whatsapp", "whatsapp_url", "whatsapp", False), ("booking", "booking_url", "booking_link", False),
    ("linkedin", "linkedin_url", "linkedin_profile", False), ("instagram", "instagram_url", "instagram_profile", False), ("tiktok", "tiktok_url", "tiktok_profile", False), ("facebook", "facebook_url", "facebook_profile", False),
]
LABEL_SCORES = {"low": 0.35, "medium": 0.65, "high": 0.9}


def _named(column: str, aliases: dict[str, str], allowed: list[str]) -> str:
    whens = " ".join(f"WHEN {quoted(a)} THEN {quoted(b)}" for a, b in aliases.items())
    real = f"CASE {column} {whens} ELSE {column} END"
    return f"CASE WHEN {real} IN ({', '.join(map(quoted, allowed))}) THEN {real} END"


def source_type(column: str) -> str:
    return _named(column, SOURCE_ALIASES, SOURCE_TYPES)


def discovery_method(column: str) -> str:
    return _named(column, METHOD_ALIASES, METHODS)


def label_score(column: str) -> str:
    return f"CASE lower(trim({column})) " + " ".join(f"WHEN '{k}' THEN {v}D" for k, v in LABEL_SCORES.items()) + " ELSE 0.5D END"


def last_rows(rows: DataFrame, keys: list[str], order: list[str] = (), sequence: str | None = None, kept: list[str] = ()) -> DataFrame:
    """The last row of each key: the greatest in order, of ties the later one. One aggregate that combines before its shuffle.

    kept: columns that come from the key's first row instead, if it isn't null there.

    sequence: a column that numbers rows in the order of their arrival (left out of the result). Without it rows come in the order in which they are read,
    which holds for files and lists and not behind a shuffle. Columns may have any type, maps included, as values are never compared.
    """
    others = [c for c in rows.columns if c not in keys and c != sequence]
    name = lambda c: F.col(f"`{c}`")
    if not others:
        return rows.select(*map(name, keys)).distinct()
    rows = rows.withColumn("arrival_", name(sequence) if sequence else F.monotonically_increasing_id())
    rank = F.struct(*map(name, order), "arrival_")
    first = {c: f"first_{i}" for i, c in enumerate(c for c in kept if c in others)}
    df = rows.groupBy(*map(name, keys)).agg(F.max_by(F.struct(*map(name, others)), rank).alias("last_"), *(F.min_by(name(c), rank).alias(f) for c, f in first.items()))
    value = lambda c: F.col("last_").getField(c)
    return df.select(*map(name, keys), *((F.coalesce(first[c], value(c)) if c in first else value(c)).alias(c) for c in others))


def upsert(old: DataFrame, incoming: DataFrame, keys: list[str], order: list[str], kept: list[str] = ("created_at",), sequence: str | None = None) -> DataFrame:
    """New snapshot of a keyed table: the last incoming row of a key wins (of ties the later one), columns in kept stay from its first row ever.

    Both sides have the same columns; incoming may have one more, sequence (see last_rows). One shuffle by key, with the winner picked by an
    aggregate that combines before it. Columns may have any type: only keys, order and sequence are compared.
    """
    name = lambda c: F.col(f"`{c}`")
    arrival = name(sequence).cast("bigint") if sequence else F.monotonically_increasing_id()
    new = incoming.withColumns({"arrival_": arrival, "new_": F.lit(1)}).select(*map(name, old.columns), "new_", "arrival_")
    tagged = old.withColumns({"new_": F.lit(0), "arrival_": F.monotonically_increasing_id()}).unionByName(new)
    both = tagged.withColumn("sequence_", F.struct("new_", *map(name, order), "arrival_")).drop("new_", "arrival_")
    return last_rows(both, keys, [], "sequence_", kept).select(*map(name, [*keys, *(c for c in old.columns if c not in keys)]))


def patch(old: DataFrame, incoming: DataFrame, keys: list[str], present: str, order: list[str] = (), sequence: str | None = None) -> DataFrame:
    """Partial update: a column of incoming overwrites, null included, where the array column `present` names it; else the old value stays.

    Null keys are keys like others. Of several incoming rows of a key the last one counts (see last_rows).
    """
    columns = [c for c in old.columns if c not in keys]
    incoming = last_rows(incoming.select(*keys, *columns, present, *(c for c in {*order, *([sequence] if sequence else [])} if c not in {*keys, *columns})), keys, order, sequence)
    o, n = old.alias("o"), incoming.alias("n")
    same = functools.reduce(lambda a, b: a & b, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys])
    df = o.join(n, same, "full_outer")
    return df.select(*(F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys), *(F.when(F.array_contains(f"n.{present}", c), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in columns))


def backfill(existing: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates whose key isn't there yet, one per key: insert that does nothing on conflict."""
    return candidates.dropDuplicates(keys).join(existing.select(*keys).distinct(), keys, "left_anti")


def contacts(prospects: DataFrame, key: str = "prospect_id") -> DataFrame:
    """Contact rows of prospects: eight columns unpivoted, and the form; nulls go. Confidence from contact_channels, if there."""
    have = [x for x in CONTACT_COLUMNS if x[1] in prospects.columns]
    entries = ", ".join(f"named_struct('contact_type', '{t}', 'contact_value', {c}, 'label', '{label}', 'is_primary', {str(p).lower()})" for t, c, label, p in have)
    form = "named_struct('contact_type', 'form', 'contact_value', CASE WHEN form_detected THEN coalesce(nullif(contact_page_url, ''), website_url) END, 'label', 'contact_form', 'is_primary', false)"
    entries = f"array({entries}{', ' + form if {'form_detected', 'contact_page_url', 'website_url'} <= set(prospects.columns) else ''})"
    channels = "contact_channels" if "contact_channels" in prospects.columns else "cast(array() AS array<struct<type:string,value:string,confidence:string>>)"
    rows = prospects.select(key, F.expr(channels).alias("channels_"), F.explode(F.expr(f"filter({entries}, e -> e.contact_value <> '')")).alias("e"))
    found = "get(filter(channels_, c -> lower(trim(c.type)) = e.contact_type AND trim(c.value) = trim(e.contact_value)), 0)"
    has_confidence = "confidence" in str(rows.schema["channels_"].dataType)
    return rows.select(key, "e.*", F.lit(True).alias("is_public"), F.expr(label_score(f"{found}.confidence") if has_confidence else "0.5D").alias("confidence"))


def pages(prospects: DataFrame, key: str = "prospect_id") -> DataFrame:
    """Page rows (key, url, page_type): named pages and crawled ones overwrite in order, internal links only add.

    prospects: key, primary_identity_url, website_url, primary_identity_type, contact_page_url, booking_url, pricing_page_url,
    crawled_pages array<struct<url,page_type>>, internal_links.
    """
    home = "CASE WHEN primary_identity_type = 'social_profile' THEN 'social_profile' ELSE 'home' END"
    named = f"array(named_struct('url', coalesce(nullif(primary_identity_url, ''), website_url), 'page_type', {home}), named_struct('url', contact_page_url, 'page_type', 'contact'), named_struct('url', booking_url, 'page_type', 'booking'), named_struct('url', pricing_page_url, 'page_type', 'pricing'))"
    crawled = "transform(crawled_pages, c -> named_struct('url', c.url, 'page_type', coalesce(nullif(c.page_type, ''), 'other')))"
    links = f"transform(internal_links, l -> named_struct('url', l, 'page_type', {urls.page_kind('l', urls.STORED_KINDS)}))"
    # the greatest order wins: links come below all others, and the first link of a URL is as good as any
    ranked = f"concat(transform({links}, l -> named_struct('o', -1, 'url', l.url, 'page_type', l.page_type)), transform(concat({named}, {crawled}), (p, i) -> named_struct('o', i, 'url', p.url, 'page_type', p.page_type)))"
    rows = prospects.select(key, F.explode(F.expr(f"filter({ranked}, r -> r.url <> '')")).alias("r"))
    return rows.groupBy(key, F.col("r.url").alias("url")).agg(F.max_by("r.page_type", "r.o").alias("page_type"))


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Last row of each key in a total order."""
    return rows.withColumn("n_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("n_ = 1").drop("n_")


def skipped_counter(found: str = "total_found", saved: str = "total_saved") -> str:
    """Candidates found and not saved, never negative."""
    return f"greatest(coalesce({found}, 0) - coalesce({saved}, 0), 0)"


def fill_defaults(df: DataFrame) -> DataFrame:
    """Rows from before a column was there: quality accepted, identity by domain."""
    fills = {"quality_status": "coalesce(quality_status, 'accepted')", "canonical_identity": "coalesce(canonical_identity, domain)"}
    return df.withColumns({c: F.expr(e) for c, e in fills.items() if c in df.columns})


def append_logs(logs: DataFrame, path: str) -> None:
    """Log rows are only ever added."""
    logs.write.mode("append").parquet(path)
