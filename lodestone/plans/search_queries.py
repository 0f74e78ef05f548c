"""Search queries of jobs: one job per part, its texts out of parts, customers and nations. The twin derives every family by joins."""

from __future__ import annotations

import contextlib

from pyspark.sql import functions as F

from ..cluster import new_folder
from ..operators import parse, prompts, synthesis, upsert
from ..rules import pages as page_rules
from ..rules import queries as rules
from ..sinks.store import Store
from ..sources import providers
from . import ledger
from .adapters import adapter, with_sql
from .page_queries import _lit, _t

_PHRASES = ["cursos online", "infoproductos / shopify y coaching", "ropa & moda", "academias online e idiomas", "tienda online"]
_ROLES = ["Video editor", "Social media", "abogado", "diseñador web", "Editor", ""]
_SIGNALS = ["instagram activo", "con anuncios", "muchos seguidores", "linktree", "curso propio"]


def _pick(key: str, values: list[str], lit=_lit) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {lit(v)}" for i, v in enumerate(values)) + " END"


#: The inputs of a job, in either dialect; n_name is the place, c_mktsegment the niche's trade.
_INPUTS = {
    "search_query": f"CASE p_size % 6 WHEN 0 THEN NULL WHEN 1 THEN concat('empresas ', p_name, ', ', {_pick('p_partkey % 5', _PHRASES)}) WHEN 2 THEN concat(p_name, ' ', n_name) WHEN 3 THEN concat('Sitios ', lower(c_mktsegment), ' en ', n_name) WHEN 4 THEN '' ELSE concat(p_name, ' y ', lower(p_type)) END",
    "target_niche": f"CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN {_pick('p_size % 5', _PHRASES)} WHEN 2 THEN '' ELSE concat(c_mktsegment, ' ', p_name) END",
    "target_location": "CASE WHEN p_size % 7 = 0 THEN '' ELSE n_name END",
    "target_language": _pick("p_partkey % 5", ["es", "EN", "pt", "fr", ""]),
    "user_profession": _pick("p_size % 6", _ROLES),
    "technology": "CASE p_partkey % 3 WHEN 0 THEN concat('Shopify ', p_brand) WHEN 1 THEN 'wordpress' END",
    "offer": f"CASE WHEN p_size % 4 = 0 THEN {_pick('p_partkey % 5', _PHRASES)} END",
    "signal_a": _pick("p_partkey % 5", _SIGNALS), "signal_b": "CASE WHEN p_size % 3 = 0 THEN 'Tienda oficial' END",
    "dork": "CASE WHEN p_size % 5 = 0 THEN concat(' intitle:', p_name, '  -blog ') END", "term": "CASE WHEN p_size % 2 = 0 THEN concat('-', lower(p_type)) END",
}


def jobs(spark, sf_dir):
    # a part's customer and nation follow from its key, so the job's texts take many forms
    parts = _t(spark, sf_dir, "part").join(_t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), F.expr("c_custkey = p_partkey"), "left")
    rows = parts.join(F.broadcast(_t(spark, sf_dir, "nation").select("n_nationkey", "n_name")), F.expr("n_nationkey = coalesce(c_nationkey, 7)")).withColumn("c_mktsegment", F.coalesce("c_mktsegment", F.lit("RETAIL")))
    rows = rows.select("p_partkey", *(F.expr(e).alias(c) for c, e in _INPUTS.items()))
    lists = {"user_technologies": "array(technology)", "user_service_offers": "array(offer)", "user_service_constraints": "cast(NULL AS array<string>)", "target_budget_signals": "array_compact(array(signal_a, signal_b))", "ai_dork_queries": "array_compact(array(dork))", "ai_negative_terms": "array_compact(array(term))", "user_target_offer_focus": "cast(NULL AS string)"}
    return rows.selectExpr("p_partkey", "search_query", "target_niche", "target_location", "target_language", "user_profession", *(f"{e} AS {c}" for c, e in lists.items()))


def query_batches(spark, sf_dir):
    df = synthesis.build_queries(jobs(spark, sf_dir))
    return df.select("p_partkey", F.posexplode("query_batches").alias("batch", "b")).select("p_partkey", F.col("batch").cast("bigint").alias("batch"), F.array_join("b", " || ").alias("queries"))


#: What three providers bring for a query: hosts out of the query's digest, with fewer of the first one's queries answered.
_HOSTS = {"brave_api": ("'0'", "concat('https://b', substring(md5(q), 2, 2), '.es')"), "duckduckgo": ("'7'", "concat('https://d', substring(md5(q), 2, 2), '.es')"), "google": ("'g'", "concat('https://g', substring(md5(q), 2, 1), '.es')")}
_ORDER = "brave_api, ddg_html, google"


def _search(queries):
    # one pass over the queries, whatever the number of providers
    told = queries.withColumn("digest", F.md5("query"))
    each = ", ".join(f"CASE WHEN substring(digest, 1, 1) <= {most} THEN named_struct('provider', '{p}', 'url', {url.replace('md5(q)', 'digest')}) END" for p, (most, url) in _HOSTS.items())
    hits = told.select("job_id", "ordinal", "query", F.explode(F.expr(f"array({each})")).alias("hit")).where("hit IS NOT NULL")
    return hits.select("job_id", "ordinal", "query", "hit.provider", "hit.url", F.lit(None).cast("string").alias("exclusion_reason"))


def job_creation(spark, sf_dir):
    """Jobs created from their texts to their candidates, stopped after the search and taken up again."""
    rows = jobs(spark, sf_dir).withColumnRenamed("p_partkey", "job_id").withColumn("cap", F.expr("cast(job_id % 7 AS bigint) + 1"))
    store = Store(spark, new_folder(spark, "store"), ledger.LEDGER)

    def stopped(_):
        raise InterruptedError

    first = ledger.Ledger(store, "creation", {"jobs": sf_dir})
    with contextlib.suppress(InterruptedError):
        ledger.create_jobs(first, rows, stopped, providers.provider_order(_ORDER))
    made = ledger.create_jobs(ledger.Ledger(store, "creation", {"jobs": sf_dir}), rows, _search, providers.provider_order(_ORDER))["insert"]
    return made.select("job_id", "provider", "status", "total_found", F.coalesce("duplicates", F.lit(0)).alias("duplicates"), F.expr("array_join(transform(candidates, c -> concat(c.position, ' ', c.url)), ',')").alias("candidates"))


def _values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else _lit(x) for x in r) + ")" for r in rows)


def _contains_any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {_lit(w)})" for w in words) + ")"


def _tidy(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def _fragments(source: str, stage: str) -> str:
    """Fragments and their variants in turn: (p_partkey, seed, n) of a stage, from relation source(p_partkey, part_no, text)."""
    prefix = " ".join(f"WHEN starts_with(lower(t), {_lit(p)}) THEN {_tidy(f'substr(t, {len(p) + 1})')}" for p in rules.PREFIXES)
    return f"""
f1_{stage} AS (SELECT p_partkey, part_no, CASE {prefix} ELSE t END AS t FROM (SELECT p_partkey, part_no, CASE WHEN place = '' THEN text ELSE {_tidy("regexp_replace(text, '(?i)\\b' || place || '\\b', ' ', 'g')")} END AS t FROM {source})),
f2_{stage} AS (SELECT p_partkey, part_no, t, unnest(regexp_split_to_array(t, '(?i)\\s*(?:,|/|&|\\by\\b|\\be\\b)\\s*')) AS x, generate_subscripts(regexp_split_to_array(t, '(?i)\\s*(?:,|/|&|\\by\\b|\\be\\b)\\s*'), 1) AS i FROM f1_{stage} WHERE t <> ''),
f3_{stage} AS (SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY part_no, i) AS g, {_tidy('x')} AS x FROM f2_{stage} WHERE {_tidy('x')} <> ''),
f4_{stage} AS (SELECT f.p_partkey, f.g, coalesce(v.variant, f.x) AS seed, min(coalesce(v.n, 0)) AS o FROM f3_{stage} f LEFT JOIN variants v ON contains(lower(f.x), v.key) GROUP BY ALL),
f5_{stage} AS (SELECT p_partkey, g, seed, row_number() OVER (PARTITION BY p_partkey, g ORDER BY o) AS r FROM f4_{stage}),
s_{stage} AS (SELECT p_partkey, seed, row_number() OVER (PARTITION BY p_partkey ORDER BY r, g) AS n FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey, seed ORDER BY r, g) AS again FROM f5_{stage}) WHERE again = 1)"""


def _ctes() -> str:
    variants = [(k, v, 100 * i + j) for i, (k, vs) in enumerate(rules.VARIANTS.items()) for j, v in enumerate(vs)]
    hints = [(lang, kind, text, n) for lang, h in rules.LANGUAGE_HINTS.items() for kind, v in h.items() for n, text in enumerate(v if isinstance(v, list) else [v])]
    budget = [(test, key, synthesis.BUDGET_ORDER.index(key)) for tests, keys in synthesis.BUDGET_RULES for test in tests for key in keys]
    refused = [(w, n, 0) for n, w in enumerate(rules.NEGATIVES)] + [(w, 200 + n, 1) for n, w in enumerate(rules.PROVIDER_NEGATIVES)]
    sites = _values([("instagram", 0), ("tiktok", 1)])
    social = [(h, n) for n, h in enumerate(rules.COMMERCIAL_HINTS[:4])]
    platforms = [(h, n) for n, h in enumerate(rules.PLATFORM_HINTS[:2])]
    retry_social = [(h, n) for n, h in enumerate(["marca personal", "coach", "link in bio"])]
    held = lambda q, phrase: f"({phrase} <> '' AND contains(' ' || lower({q}) || ' ', ' ' || lower({phrase}) || ' '))"
    return f"""
WITH variants(key, variant, n) AS ({_values(variants)}), hints(lang, kind, hint, n) AS ({_values(hints)}), budget_rules(test, key, n) AS ({_values(budget)}), refused(term, n, online) AS ({_values(refused)}),
raw AS (SELECT p.*, n.n_name, coalesce(c.c_mktsegment, 'RETAIL') AS c_mktsegment FROM part p LEFT JOIN customer c ON c.c_custkey = p.p_partkey JOIN nation n ON n.n_nationkey = coalesce(c.c_nationkey, 7)),
inputs AS (SELECT p_partkey, {', '.join(f'{e} AS {c}' for c, e in _INPUTS.items())} FROM raw),
j0 AS (SELECT p_partkey, {_tidy("coalesce(search_query, '')")} AS query, {_tidy('target_niche')} AS niche, target_location AS place, CASE WHEN lower(target_language) IN ('es', 'en', 'pt') THEN lower(target_language) ELSE 'es' END AS lang,
  lower(user_profession) AS role, lower(coalesce(technology, '')) AS tech, offer, signal_a, signal_b, dork, term, CASE WHEN target_location = '' THEN '' ELSE ' ' || target_location END AS here FROM inputs),
j1 AS (SELECT *, trim(niche || ' ' || place) AS both_, CASE WHEN query <> '' THEN query ELSE trim(niche || ' ' || place) END AS base, {_contains_any('role', synthesis.SOCIAL_ROLES)} AS social, {_contains_any('role', synthesis.CREATIVE_ROLES)} AS creative,
  {_contains_any("lower(concat_ws(' ', niche, offer))", synthesis.ONLINE_NICHES)} AS online FROM j0),
j2 AS (SELECT *, CASE WHEN place <> '' AND NOT {held('base', 'place')} THEN base || here ELSE base END AS geo FROM j1),
j AS (SELECT *, coalesce(nullif(both_, ''), nullif(geo, ''), base) AS main, coalesce(nullif(both_, ''), nullif(trim(query || here), ''), query) AS stem FROM j2),
terms AS (SELECT p_partkey, list(u.term ORDER BY u.n) AS terms FROM (SELECT p_partkey, term, min(n) AS n FROM (
  SELECT p_partkey, r.term, r.n FROM j JOIN refused r ON r.online = 0 OR j.online UNION ALL SELECT p_partkey, term, 100 FROM j WHERE term IS NOT NULL) GROUP BY ALL) u
  JOIN j USING (p_partkey) WHERE NOT (creative AND u.term IN ({', '.join(map(_lit, synthesis.VISUAL_NEGATIVES))})) GROUP BY p_partkey),
budget AS (SELECT p_partkey, key, row_number() OVER (PARTITION BY p_partkey ORDER BY n) AS n FROM (SELECT DISTINCT p_partkey, b.key, b.n FROM j JOIN budget_rules b ON contains(lower(signal_a), b.test) OR contains(lower(coalesce(signal_b, '')), b.test))),
src_a AS (SELECT p_partkey, place, 1 AS part_no, niche AS text FROM j UNION ALL SELECT p_partkey, place, 2, base FROM j), src_b AS (SELECT p_partkey, place, 1 AS part_no, niche AS text FROM j UNION ALL SELECT p_partkey, place, 2, query FROM j),
{_fragments('src_a', 'a')}, {_fragments('src_b', 'b')},
placed AS (SELECT p_partkey, seed || here AS x, n FROM s_a JOIN j USING (p_partkey)),
site(site, n) AS ({sites}),
near_hints AS (SELECT p_partkey, h, row_number() OVER (PARTITION BY p_partkey ORDER BY o, n) AS n FROM (SELECT p_partkey, key AS h, 0 AS o, n FROM budget WHERE n <= 3 UNION ALL SELECT p_partkey, h, 1, k FROM j, ({_values(social)}) c(h, k))),
main_hints AS (SELECT p_partkey, key AS h, n FROM budget WHERE n <= 2 UNION ALL SELECT p_partkey, h, 10 + k FROM j, ({_values(platforms)}) c(h, k)),
retry_hints AS (SELECT p_partkey, key AS h, n FROM budget WHERE n <= 2 UNION ALL SELECT p_partkey, h, 10 + k FROM j, ({_values(retry_social)}) c(h, k)),
families(p_partkey, a, b, c, d, text, neg) AS (
  SELECT p_partkey, 1, 0, 0, 0, dork, true FROM j WHERE dork IS NOT NULL UNION ALL SELECT p_partkey, 2, 0, 0, 0, base, false FROM j UNION ALL SELECT p_partkey, 2, 1, 0, 0, both_, false FROM j UNION ALL SELECT p_partkey, 2, 2, 0, 0, geo, false FROM j
  UNION ALL SELECT p_partkey, 3, n, 0, 0, x, false FROM placed WHERE n <= 3
  UNION ALL SELECT p.p_partkey, 4, p.n, 0, s.n, p.x || ' site:' || s.site || '.com', true FROM placed p JOIN j USING (p_partkey), site s WHERE p.n <= 2 AND j.social
  UNION ALL SELECT p.p_partkey, 4, p.n, h.n, s.n, p.x || ' ' || h.h || ' site:' || s.site || '.com', true FROM placed p JOIN j USING (p_partkey) JOIN near_hints h USING (p_partkey), site s WHERE p.n <= 2 AND h.n <= 3 AND j.social
  UNION ALL SELECT p_partkey, 5, 0, 0, s.n, main || ' site:' || s.site || '.com', true FROM j, site s WHERE social
  UNION ALL SELECT p_partkey, 5, 1, h.n, s.n, main || ' ' || h.h || ' site:' || s.site || '.com', true FROM j JOIN main_hints h USING (p_partkey), site s WHERE social
  UNION ALL SELECT p_partkey, 6, 0, 0, 0, main || ' "powered by shopify"', true FROM j WHERE contains(tech, 'shopify') UNION ALL SELECT p_partkey, 6, 1, 0, 0, main || ' "creado con wordpress"', true FROM j WHERE contains(tech, 'wordpress')
  UNION ALL SELECT p_partkey, 7, CASE kind WHEN 'official' THEN 0 WHEN 'contact' THEN 1 ELSE 2 END, 0, 0, main || ' ' || hint, true FROM j JOIN hints h ON h.lang = j.lang AND kind IN ('official', 'contact', 'services')
  UNION ALL SELECT p_partkey, 8, p.n, CASE kind WHEN 'official' THEN 0 ELSE 1 END, 0, x || ' ' || hint, true FROM placed p JOIN j USING (p_partkey) JOIN hints h ON h.lang = j.lang AND kind IN ('official', 'contact') WHERE p.n <= 2
  UNION ALL SELECT p_partkey, 9, n, 0, 0, x, false FROM placed WHERE n > 3
  UNION ALL SELECT p_partkey, 10, 0, 0, 0, base || ' ' || niche, true FROM j WHERE niche <> '' AND NOT {held('base', 'niche')}),
retries(p_partkey, a, b, c, d, text, neg) AS (
  SELECT p_partkey, 1, h.n, 0, 0, stem || ' ' || hint, true FROM j JOIN hints h ON h.lang = j.lang AND kind = 'commercial'
  UNION ALL SELECT p_partkey, 2, 0, 0, s.n, stem || ' site:' || s.site || '.com', true FROM j, site s WHERE social
  UNION ALL SELECT p_partkey, 2, 1, h.n, s.n, stem || ' ' || h.h || ' site:' || s.site || '.com', true FROM j JOIN retry_hints h USING (p_partkey), site s WHERE social
  UNION ALL SELECT p_partkey, 3, h.n, 0, 0, stem || ' ' || hint, true FROM j JOIN hints h ON h.lang = j.lang AND kind = 'locations'
  UNION ALL SELECT p_partkey, 4, s.n, h.n, 0, seed || here || ' ' || hint, true FROM s_b s JOIN j USING (p_partkey) JOIN hints h ON h.lang = j.lang AND kind = 'commercial' WHERE s.n <= 4
  UNION ALL SELECT p_partkey, 5, CASE kind WHEN 'official' THEN 0 ELSE 1 END, 0, 0, niche || here || ' ' || hint, true FROM j JOIN hints h ON h.lang = j.lang AND kind IN ('official', 'contact') WHERE niche <> '' AND query <> '' AND NOT {held('query', 'niche')}
  UNION ALL SELECT p_partkey, 6, 0, 0, 0, query || here, true FROM j WHERE place <> '' AND query <> '' AND NOT {held('query', 'place')}),
both_stages AS (SELECT 0 AS stage, f.* FROM families f JOIN j USING (p_partkey) WHERE base <> '' UNION ALL SELECT 1, r.* FROM retries r JOIN j USING (p_partkey) WHERE stem <> ''),
whole AS (SELECT stage, p_partkey, a, b, c, d, CASE WHEN t = '' OR NOT neg THEN t ELSE trim(concat_ws(' ', t, nullif(array_to_string(list_filter(terms, lambda w: NOT contains(lower(t), lower(w))), ' '), ''))) END AS q
  FROM (SELECT *, {_tidy('text')} AS t FROM both_stages) LEFT JOIN terms USING (p_partkey)),
once AS (SELECT *, row_number() OVER (PARTITION BY stage, p_partkey ORDER BY a, b, c, d) AS n FROM (SELECT *, row_number() OVER (PARTITION BY stage, p_partkey, q ORDER BY a, b, c, d) AS again FROM whole WHERE q <> '') WHERE again = 1),
kept AS (SELECT stage, p_partkey, q, row_number() OVER (PARTITION BY stage, p_partkey ORDER BY n) - 1 AS n FROM once o
  WHERE stage = 0 AND n <= {synthesis.MOST_QUERIES} OR stage = 1 AND NOT EXISTS (SELECT 1 FROM once e WHERE e.stage = 0 AND e.n <= {synthesis.MOST_QUERIES} AND e.p_partkey = o.p_partkey AND e.q = o.q))"""


def _batches_sql() -> str:
    return f"""{_ctes()},
chunked AS (SELECT p_partkey, stage, n // {synthesis.QUERY_BATCH} AS k, string_agg(q, ' || ' ORDER BY n) AS queries FROM kept GROUP BY ALL)
SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY stage, k) - 1 AS batch, queries FROM chunked"""


def _creation_sql() -> str:
    each = " UNION ALL ".join(f"SELECT job_id, o, {i} AS p, '{name}' AS provider, {url} AS url FROM flat WHERE substring(md5(q), 1, 1) <= {most}" for i, (name, (most, url)) in enumerate(_HOSTS.items()))
    return f"""{_ctes()},
flat AS (SELECT p_partkey AS job_id, q, row_number() OVER (PARTITION BY p_partkey ORDER BY stage, n) AS o FROM kept),
h AS ({each}), b AS (SELECT * FROM h QUALIFY p = min(p) OVER (PARTITION BY job_id)),
u AS (SELECT job_id, provider, url, min(o) AS o, count(*) - 1 AS again FROM b GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY o) AS position FROM u),
k AS (SELECT job_id, sum(again)::BIGINT AS duplicates, min(provider) AS provider, count(*) FILTER (position <= job_id % 7 + 1) AS total_found, string_agg(position || ' ' || url, ',' ORDER BY position) FILTER (position <= job_id % 7 + 1) AS candidates FROM r GROUP BY job_id)
SELECT p_partkey AS job_id, provider, CASE WHEN total_found > 0 THEN 'pending' ELSE 'completed' END AS status, coalesce(total_found, 0) AS total_found, coalesce(duplicates, 0) AS duplicates, candidates FROM part LEFT JOIN k ON p_partkey = job_id"""


def demo_fallback(spark, sf_dir):
    """Jobs whose search brought nothing get the demo hits."""
    jobs_ = _t(spark, sf_dir, "customer").selectExpr("c_custkey AS job_id", "c_mktsegment AS query")
    found = _t(spark, sf_dir, "orders").selectExpr("o_custkey AS job_id", "concat('https://o', o_orderkey, '.es') AS url", "cast(o_orderkey AS int) AS position")
    missing = jobs_.join(found.select("job_id").distinct(), "job_id", "left_anti")
    demo = providers.demo_hits(missing, 2).select("job_id", "url", "position", "discovery_confidence")
    return found.groupBy("job_id").agg(F.min_by("url", "position").alias("url"), F.lit(1).alias("position"), F.lit("high").alias("discovery_confidence")).unionByName(demo)


DEMO_FALLBACK = """SELECT o_custkey AS job_id, arg_min('https://o' || o_orderkey || '.es', o_orderkey) AS url, 1 AS position, 'high' AS discovery_confidence FROM orders GROUP BY o_custkey
UNION ALL SELECT c_custkey, u.url, u.position, 'low' FROM customer, (VALUES ('https://example.com', 1), ('https://example.org', 2)) u(url, position) WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"""


def logs_appended(spark, sf_dir):
    """Log rows appended in two runs, read back: rows, last id and errors of each job."""
    logs, path = adapter(spark, sf_dir, "logs").select("id", "job_id", "level", "message", "context"), new_folder(spark, "logs")
    for run in ("id % 3 = 0", "id % 3 > 0"):
        upsert.append_logs(logs.where(run), path)
    return spark.read.parquet(path).groupBy("job_id").agg(F.count("*").alias("n"), F.max("id").alias("last_id"), F.count_if(F.col("level") == "ERROR").alias("errors"))


LOGS_APPENDED = with_sql("logs") + "SELECT job_id, count(*) AS n, max(id) AS last_id, count(*) FILTER (level = 'ERROR') AS errors FROM logs GROUP BY job_id"


_ADDRESSED = "concat(coalesce(text, ''), '|Calle Mayor ', doc_id, ', ', coalesce(source, ''), '|Avenida ', coalesce(substring(text, 1, 60), ''), ' madrid|plaza x')"


def visible_addresses(spark, sf_dir):
    """Street addresses in whole texts, with lines of addresses out of the documents' own fields."""
    rows = _t(spark, sf_dir, "documents").selectExpr("doc_id", f"{_ADDRESSED} AS t")
    return rows.select("doc_id", F.expr(f"array_join({parse.addresses_in('t')}, ' # ')").alias("addresses"))


VISIBLE_ADDRESSES = f"""WITH m AS (SELECT doc_id, list_transform(regexp_extract_all({_ADDRESSED}, {_lit(parse.ADDRESS)}, 1), lambda x: {_tidy('x')}) AS found FROM documents)
SELECT doc_id, array_to_string(list_filter(found, lambda x: regexp_matches(x, '[0-9]') OR {_contains_any('lower(x)', page_rules.ADDRESS_PLACES)}), ' # ') AS addresses FROM m"""


def prompt_sections(spark, sf_dir):
    """Prompts of jobs: the seller's context, the planner's rules where there are hints, and evidence within its budget."""
    df = jobs(spark, sf_dir).selectExpr("*", "ai_dork_queries AS target_entity_hints", "ai_negative_terms AS exclusion_entity_hints", "cast(NULL AS string) AS user_value_proposition", "array(target_niche, '') AS user_past_successes", "array('', NULL) AS user_roi_metrics", "concat(' ', target_location, ' ') AS target_company_size", "cast(NULL AS array<string>) AS target_pain_points", "array_join(target_budget_signals, '; ') AS evidence")
    lists = ["user_technologies", "user_past_successes", "user_roi_metrics", "target_pain_points", "target_budget_signals"]
    whole = prompts.template([prompts.persona(lists, "CONTEXTO DEL VENDEDOR", 400), prompts.entity_rules(), prompts.Section("EVIDENCIA", [prompts.Text("evidence")], 30, "size(target_budget_signals) > 1")])
    return df.select("p_partkey", F.expr(whole).alias("prompt"))


def _prompt_sql() -> str:
    value = lambda e, empty=prompts.MISSING: f"coalesce(nullif(trim({e}), ''), '{empty}')"
    shown = {
        "user_profession": value("user_profession"), "user_technologies": value("technology"), "user_value_proposition": f"'{prompts.MISSING}'", "user_past_successes": value("target_niche"), "user_roi_metrics": f"'{prompts.MISSING}'",
        "target_niche": value("target_niche", "General"), "target_location": value("target_location"), "target_language": value("target_language"), "target_company_size": value("target_location"), "target_pain_points": f"'{prompts.MISSING}'",
        "target_budget_signals": value("concat_ws(', ', signal_a, signal_b)"),
    }
    context = " || chr(10) || ".join(f"'- {label}: ' || {shown[c]}" for label, c, _ in prompts.PERSONA)
    return f"""WITH raw AS (SELECT p.*, n.n_name, coalesce(c.c_mktsegment, 'RETAIL') AS c_mktsegment FROM part p LEFT JOIN customer c ON c.c_custkey = p.p_partkey JOIN nation n ON n.n_nationkey = coalesce(c.c_nationkey, 7)),
j AS (SELECT p_partkey, {', '.join(f'{e} AS {c}' for c, e in _INPUTS.items())} FROM raw)
SELECT p_partkey, substr('CONTEXTO DEL VENDEDOR' || chr(10) || {context}, 1, 400)
  || CASE WHEN dork IS NULL AND term IS NULL THEN '' ELSE chr(10) || chr(10) || '{prompts.RULES_TITLE}' || CASE WHEN dork IS NULL THEN '' ELSE chr(10) || '{prompts.RULES_FOR}' || chr(10) || '- ' || dork END || CASE WHEN term IS NULL THEN '' ELSE chr(10) || '{prompts.RULES_AGAINST}' || chr(10) || '- ' || term END END
  || CASE WHEN signal_b IS NULL THEN '' ELSE chr(10) || chr(10) || substr('EVIDENCIA' || chr(10) || signal_a || '; ' || signal_b, 1, 30) END AS prompt FROM j"""


QUERIES = {
    "query_batches": (query_batches, _batches_sql()), "job_creation": (job_creation, _creation_sql()), "demo_fallback": (demo_fallback, DEMO_FALLBACK), "logs_appended": (logs_appended, LOGS_APPENDED),
    "visible_addresses": (visible_addresses, VISIBLE_ADDRESSES), "prompt_sections": (prompt_sections, _prompt_sql()),
}
