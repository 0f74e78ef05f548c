"""Queries over inputs that are put together from cases by id, so that the SQL twins can state each case's result outright.

Every row of a table takes part; which cases meet follows from remainders of its id.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import crawl, extraction, kpi, quality, synthesis, upsert
from ..operators import hits as operators_hits
from ..operators.parse import parse
from ..sources import providers
from ..sources.html import read_pages
from .page_queries import _lit, _t
from .rule_queries import _spark_lit


def _case(key: str, k: int, values: list[str | None], lit=_lit) -> str:
    """CASE over key modulo k in either dialect; None is null."""
    return f"CASE {key} % {k} " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else lit(v)}" for i, v in enumerate(values)) + " END"


# ---- HTML to metadata ----

_LANG = [("es-ES", "es-es"), ("EN", "en"), ("", None)]
_META = ['<meta name="description" content=" Desc ">', '<meta property="og:description" content="OG">']
_META_IS = ["Desc", "OG"]
_LD = [
    "", '{"@type":"Dentist","address":{"streetAddress":"Calle Mayor 1","addressLocality":"Madrid","postalCode":"28013"},"telephone":"+34 911 22 33 44","email":"Info@acme.es","openingHours":"Mo-Fr 9-18","areaServed":["Toledo",{"name":"Getafe"}]}',
    '{"@graph":[{"@type":"Organization","@graph":[{"@type":"Store","address":"Plaza 5"}]}]}', '{"@type":"Product"}', "{broken",
]
_LINKS = [
    '<a href="/contacto">Contacto</a><a href="mailto:Ventas@acme.es?x=1">m</a>', '<a href="/precios">Precios</a><a href="https://wa.me/34600111222">w</a>', '<a href="/reservas">Reserva cita</a>', '<a href="https://instagram.com/acme">ig</a><a href="https://maps.app.goo.gl/x">mapa</a>',
    '<a href="https://other.org/x">o</a><a href="tel:+34600111222">t</a><a href="tel:20240105">d</a>', '<a href="/servicios">Servicios</a><button>Comprar</button>',
]
_LABELS = ["Contacto m", "Precios w", "Reserva cita", "ig mapa", "o t d", "Servicios Comprar"]


def page_parse_cases(spark, sf_dir):
    pick = lambda k, values: _case("page_id", k, values, _spark_lit)
    html = (
        f"concat('<html lang=\"', {pick(3, [a for a, _ in _LANG])}, '\"><head><title> Acme ', page_id, ' | Web</title>', {pick(2, _META)}, CASE WHEN page_id % 4 = 0 THEN '<meta property=\"og:locale\" content=\"es_ES\">' ELSE '' END,"
        f" '<script type=\"application/ld+json\">', {pick(5, _LD)}, '</script></head><body><p>hola  <b>mundo</b></p><script>var x</script><style>p</style>', {pick(6, _LINKS)}, CASE WHEN page_id % 7 = 0 THEN '<form></form>' ELSE '' END, '</body></html>')"
    )
    df = parse(read_pages(_t(spark, sf_dir, "pages").selectExpr("page_id", "'https://www.acme.es/' AS url", f"{html} AS html")))
    joined = lambda c: F.array_join(c, "|").alias(c)
    channels = F.expr("array_join(transform(contact_channels, c -> concat(c.type, ':', c.value, ':', c.source)), '|')").alias("contact_channels")
    lists = ["emails", "phones", "addresses", "opening_hours", "area_served", "social_links", "internal_links", "external_links", "map_links", "cta_candidates", "structured_data_evidence"]
    return df.select(
        "page_id", "title", "description", "html_lang", "meta_locale", "clean_text", "form_detected", *map(joined, lists), channels, "whatsapp_url", "booking_url", "pricing_page_url", "service_page_url", "primary_cta", "primary_identity_type",
        F.size("structured_data").alias("n_nodes"), F.expr("array_join(transform(social_profiles, p -> concat(p.platform, ':', p.handle, ':', p.is_primary, ':', p.confidence)), '|')").alias("profiles"), "invalid_phone_candidates_count", F.expr("element_at(phone_validation_rejections, 'date_like')").alias("date_like"),
    )


PAGE_PARSE_CASES = f"""WITH p AS (SELECT page_id, page_id % 5 AS ld, page_id % 6 AS ln, page_id % 7 = 0 AS form FROM pages)
SELECT page_id, 'Acme ' || page_id || ' | Web' AS title, {_case('page_id', 2, _META_IS)} AS description, {_case('page_id', 3, [b for _, b in _LANG])} AS html_lang, CASE WHEN page_id % 4 = 0 THEN 'es_es' END AS meta_locale,
  'Acme ' || page_id || ' | Web hola mundo ' || {_case('page_id', 6, _LABELS)} AS clean_text, form AS form_detected, concat_ws('|', CASE WHEN ld = 1 THEN 'info@acme.es' END, CASE WHEN ln = 0 THEN 'ventas@acme.es' END) AS emails,
  concat_ws('|', CASE WHEN ln = 4 THEN '+34600111222' END, CASE WHEN ld = 1 THEN '+34911223344' END) AS phones, CASE ld WHEN 1 THEN 'Calle Mayor 1, Madrid, 28013|Toledo|Getafe' WHEN 2 THEN 'Plaza 5' ELSE '' END AS addresses, CASE ld WHEN 1 THEN 'Mo-Fr 9-18' ELSE '' END AS opening_hours, CASE ld WHEN 1 THEN 'Toledo|Getafe' ELSE '' END AS area_served,
  CASE ln WHEN 3 THEN 'https://instagram.com/acme' ELSE '' END AS social_links, CASE ln WHEN 0 THEN 'https://www.acme.es/contacto' WHEN 1 THEN 'https://www.acme.es/precios' WHEN 2 THEN 'https://www.acme.es/reservas' WHEN 5 THEN 'https://www.acme.es/servicios' ELSE '' END AS internal_links,
  CASE ln WHEN 1 THEN 'https://wa.me/34600111222' WHEN 3 THEN 'https://maps.app.goo.gl/x' WHEN 4 THEN 'https://other.org/x' ELSE '' END AS external_links, CASE ln WHEN 3 THEN 'https://maps.app.goo.gl/x' ELSE '' END AS map_links,
  CASE ln WHEN 0 THEN 'contact_form' WHEN 1 THEN 'whatsapp' WHEN 2 THEN 'booking' ELSE '' END AS cta_candidates, CASE WHEN ld IN (1, 2) THEN 'json_ld_detected|structured_address_detected' ELSE '' END AS structured_data_evidence,
  concat_ws('|', CASE WHEN ld = 1 THEN 'phone:+34911223344:structured_data|email:info@acme.es:structured_data' END, CASE ln WHEN 0 THEN 'email:ventas@acme.es:mailto_link' WHEN 1 THEN 'whatsapp:https://wa.me/34600111222:whatsapp_link' WHEN 4 THEN 'phone:+34600111222:tel_link' END,
    CASE WHEN form THEN 'contact_form:https://www.acme.es/:html_form' END, CASE WHEN ln = 2 THEN 'booking:https://www.acme.es/reservas:booking_link' END) AS contact_channels,
  CASE WHEN ln = 1 THEN 'https://wa.me/34600111222' END AS whatsapp_url, CASE WHEN ln = 2 THEN 'https://www.acme.es/reservas' END AS booking_url, CASE WHEN ln = 1 THEN 'https://www.acme.es/precios' END AS pricing_page_url, CASE WHEN ln = 5 THEN 'https://www.acme.es/servicios' END AS service_page_url,
  CASE ln WHEN 0 THEN 'contact_form' WHEN 1 THEN 'whatsapp' WHEN 2 THEN 'booking' END AS primary_cta, 'website' AS primary_identity_type, CASE ld WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS n_nodes, CASE WHEN ln = 3 THEN 'instagram:acme:false:high' ELSE '' END AS profiles, (ln = 4)::int AS invalid_phone_candidates_count, CASE WHEN ln = 4 THEN 1 END AS date_like FROM p"""


def social_parse_cases(spark, sf_dir):
    """Profile pages: handle by platform, display name, signals in the text."""
    url = _case("page_id", 6, ["https://instagram.com/acme", "https://www.tiktok.com/@acme", "https://instagram.com/p/xyz", "https://tiktok.com/acme", "https://www.linkedin.com/company/x", "https://instagram.com/acme.co/reels"], _spark_lit)
    text = _case("page_id", 4, ["servicios reels clientes link in bio", "hola", "Curso para marcas, ugc", "agenda"], _spark_lit)
    title = _case("page_id", 3, ["Acme (@acme) | Perfil", "", "Acme"], _spark_lit)
    html = f"concat('<html><head><title>', {title}, '</title><meta name=\"description\" content=\"Coach\"></head><body>', {text}, ' <a href=\"https://acme.com\">web</a><a href=\"mailto:a@acme.com\">m</a></body></html>')"
    df = parse(read_pages(_t(spark, sf_dir, "pages").selectExpr("page_id", f"{url} AS url", f"{html} AS html")))
    s = "social_profile"
    one = lambda c: F.expr(f"array_join({s}.{c}, '|')").alias(c)
    return df.select("page_id", "primary_identity_type", F.expr(f"{s}.platform").alias("platform"), F.expr(f"{s}.handle").alias("handle"), F.expr(f"{s}.display_name").alias("display_name"), F.expr(f"{s}.bio").alias("bio"), *map(one, ["external_links", "platform_ctas", "offer_signals", "activity_signals", "audience_signals"]), F.expr("array_join(social_profiles[0].contact_signals, '|')").alias("contact_signals"))


SOCIAL_PARSE_CASES = """WITH p AS (SELECT page_id, page_id % 6 AS u, page_id % 4 AS t, page_id % 3 AS n FROM pages), h AS (SELECT *, u <> 4 AS own, CASE u WHEN 0 THEN 'acme' WHEN 1 THEN 'acme' WHEN 5 THEN 'acme.co' END AS handle, CASE WHEN u IN (1, 3) THEN 'tiktok' WHEN u = 4 THEN NULL ELSE 'instagram' END AS platform FROM p)
SELECT page_id, 'social_profile' AS primary_identity_type, platform, handle, CASE WHEN own THEN CASE WHEN n = 1 THEN coalesce(handle, platform) ELSE 'Acme' END END AS display_name, CASE WHEN own THEN 'Coach' END AS bio, CASE WHEN own THEN 'https://acme.com' END AS external_links,
  CASE WHEN own THEN CASE WHEN t IN (0, 3) THEN 'profile_cta_visible' ELSE '' END END AS platform_ctas, CASE WHEN own THEN CASE WHEN t IN (0, 2) THEN 'commercial_offer_detected' ELSE '' END END AS offer_signals,
  CASE WHEN own THEN CASE WHEN t IN (0, 2) THEN 'content_format_visible' ELSE '' END END AS activity_signals, CASE WHEN own THEN CASE WHEN t IN (0, 2) THEN 'buyer_audience_visible' ELSE '' END END AS audience_signals, CASE WHEN own THEN 'public_email|external_link' ELSE '' END AS contact_signals FROM h"""


# ---- providers ----

_ERRORS = [(None, "no_results"), ("202 Ratelimit", "rate_limit"), ("HTTP 429", "rate_limit"), ("Read TIMEOUT", "timeout"), ("boom", "unexpected_error")]
_HTML = ["<p>ok</p>", '<div id="challenge-form">', "please solve the reCAPTCHA", "ANOMALY.JS", "/sorry/index"]


def provider_errors(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").selectExpr("event_id", "event_id % 3 AS found", f"{_case('event_id', 5, [e for e, _ in _ERRORS], _spark_lit)} AS message", "cast(element_at(array(200, 202, 429), cast(event_id % 3 AS int) + 1) AS int) AS status", f"{_case('event_id', 5, _HTML, _spark_lit)} AS html", f"{_case('event_id', 6, ['Video Editor', 'abogado', None, 'SEO consultant', 'Community manager', ''], _spark_lit)} AS profession")
    return rows.select("event_id", F.expr(providers.search_error("found", "message")).alias("failure"), F.expr(providers.challenged("status", "html")).alias("challenged"), F.expr(providers.blocked_page("status", "html")).alias("blocked"), F.expr(providers.allows_social("profession")).alias("allows_social"))


PROVIDER_ERRORS = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN CASE WHEN event_id % 3 = 0 THEN 'no_results' END WHEN 1 THEN 'rate_limit' WHEN 2 THEN 'rate_limit' WHEN 3 THEN 'timeout' ELSE 'unexpected_error' END AS failure,
  event_id % 3 = 1 AND event_id % 5 IN (1, 3) AS challenged, event_id % 3 = 2 OR event_id % 5 IN (2, 4) AS blocked, event_id % 6 IN (0, 3, 4) AS allows_social FROM events"""


def provider_discovery(spark, sf_dir):
    """Every order is a job that can ask three providers; what each brings follows from its key."""
    orders = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"))
    runs = orders.withColumn("provider", F.explode(F.expr("array('brave_api', 'duckduckgo', 'google')"))).withColumns({
        "warning": F.expr("CASE WHEN provider = 'duckduckgo' AND job_id % 2 = 0 THEN 'slow' WHEN provider = 'brave_api' AND job_id % 5 = 0 THEN 'quota' END"),
        "failure_reason": F.expr("CASE WHEN provider = 'google' THEN CASE job_id % 3 WHEN 0 THEN 'google_captcha' WHEN 1 THEN 'unexpected_error' END END"),
    })
    found = runs.where("(provider = 'brave_api' AND job_id % 4 < 3) OR (provider = 'duckduckgo' AND job_id % 3 < 2) OR (provider = 'google' AND job_id % 7 = 0)")
    hits = found.select("job_id", "provider", F.explode(F.expr("sequence(1, 3)")).alias("i")).select("job_id", "provider", F.expr("concat('https://', i, '.es')").alias("url"), F.expr("CASE WHEN i = 1 OR (job_id % 4 < 2 AND provider = 'brave_api') THEN 'excluded_as_article' END").alias("exclusion_reason"))
    order = providers.provider_order(" Brave_API, ddg_html,unknown, google")
    chain = providers.provider_chain(hits, order).groupBy("job_id").agg(F.min("provider").alias("chain_provider"), F.count("*").alias("chain_hits"))
    return providers.discover(hits, runs, order).join(chain, "job_id", "left").select("job_id", "provider", "provider_status", "failure_reason", "warning", "n_kept", "n_excluded", "chain_provider", F.coalesce("chain_hits", F.lit(0)).alias("chain_hits"))


PROVIDER_DISCOVERY = """WITH j AS (SELECT o_orderkey AS job_id FROM orders), k AS (SELECT job_id, CASE WHEN job_id % 4 = 2 THEN 2 ELSE 0 END AS b, CASE WHEN job_id % 3 < 2 THEN 2 ELSE 0 END AS d, CASE WHEN job_id % 7 = 0 THEN 2 ELSE 0 END AS g, CASE job_id % 4 WHEN 3 THEN 0 WHEN 2 THEN 1 ELSE 3 END AS xb, (job_id % 3 < 2)::int AS xd, (job_id % 7 = 0)::int AS xg FROM j),
w AS (SELECT *, CASE WHEN b > 0 THEN 1 WHEN d > 0 THEN 2 ELSE 3 END AS n, CASE WHEN b > 0 THEN b WHEN d > 0 THEN d ELSE g END AS kept FROM k)
SELECT job_id, ['brave_api', 'duckduckgo', 'google'][n] AS provider, CASE WHEN kept > 0 THEN 'ok' WHEN job_id % 3 = 0 THEN 'blocked' ELSE 'no_results' END AS provider_status, CASE WHEN kept = 0 THEN CASE job_id % 3 WHEN 0 THEN 'google_captcha' WHEN 1 THEN 'unexpected_error' ELSE 'no_results' END END AS failure_reason,
  nullif(concat_ws('; ', CASE WHEN job_id % 5 = 0 THEN 'quota' END, CASE WHEN n >= 2 AND job_id % 2 = 0 THEN 'slow' END), '') AS warning, kept AS n_kept, xb + CASE WHEN n >= 2 THEN xd ELSE 0 END + CASE WHEN n = 3 THEN xg ELSE 0 END AS n_excluded, CASE WHEN kept > 0 THEN ['brave_api', 'duckduckgo', 'google'][n] END AS chain_provider, kept AS chain_hits FROM w"""


def seed_and_json_hits(spark, sf_dir):
    """Seed URLs of jobs cut at their cap, and hits out of JSON result pages."""
    parts = _t(spark, sf_dir, "part")
    jobs = parts.selectExpr("p_partkey AS job_id", "transform(sequence(1, cast(p_partkey % 4 AS int) + 1), i -> concat('https://', i, '.es')) AS seed_urls", "cast(p_partkey % 3 AS int) AS max_candidates_to_process")
    seeds = providers.seed_hits(jobs).selectExpr("job_id", "cast(position AS bigint) AS position", "url", "source_type", "discovery_confidence AS note")
    payload = """CASE p_partkey % 4 WHEN 0 THEN '{"web": {"results": [{"url": " https://a.es ", "title": "A", "description": "x"}, {"url": "https://b.es", "title": "B"}]}}' WHEN 1 THEN '{"web": {"results": []}}' WHEN 2 THEN 'broken' ELSE '{"web": {}}' END"""
    found = providers.json_hits(parts.selectExpr("p_partkey AS job_id", f"{payload} AS payload")).selectExpr("job_id", "cast(ordinal AS bigint) + 1 AS position", "url", "'json' AS source_type", "title AS note")
    return seeds.unionByName(found)


SEED_AND_JSON_HITS = """SELECT p_partkey AS job_id, i AS position, 'https://' || i || '.es' AS url, 'seed_url' AS source_type, 'high' AS note FROM part, (VALUES (1), (2), (3), (4)) v(i) WHERE i <= p_partkey % 4 + 1 AND i <= p_partkey % 3
UNION ALL SELECT p_partkey, i, u, 'json', n FROM part, (VALUES (1, 'https://a.es', 'A'), (2, 'https://b.es', 'B')) v(i, u, n) WHERE p_partkey % 4 = 0"""


def result_page_hits(spark, sf_dir):
    """Hits out of result pages in HTML of both layouts, redirects unwrapped, the engine's own links dropped."""
    pages = [
        '<div class="result"><a class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.es%2F&amp;rut=1">A &amp; B</a><a class="result__snippet">uno dos</a></div><div class="result"><a class="result__a" href="https://b.es/">B</a></div>',
        '<div class="g"><a href="https://c.es/"><h3>C</h3></a><span class="st">short one</span><div class="VwiC3b">the longer snippet</div><div>a text that is longer than both of them</div></div><div class="g"><a href="https://www.google.com/x"><h3>G</h3></a></div>'
        '<div class="g"><a href="https://d.es/"><h3>D</h3></a><span>too short</span><div>the first text of some length</div><div>another text that is longer than the first</div></div><div data-sokoban-container="1"><a href="https://no.es/"><h3>N</h3></a></div>',
        "<p>nothing</p>", '<div data-sokoban-container="1"><a href="https://e.es/"><h3>E</h3></a></div>',
    ]
    rows = _t(spark, sf_dir, "supplier").selectExpr("cast(s_suppkey AS string) AS query", f"{_case('s_suppkey', 4, pages, _spark_lit)} AS html")
    return providers.html_hits(rows).selectExpr("cast(query AS bigint) AS query", "cast(ordinal AS bigint) AS ordinal", "url", "title", "snippet")


RESULT_PAGE_HITS = """SELECT s_suppkey AS query, o AS ordinal, u AS url, t AS title, s AS snippet FROM supplier JOIN (VALUES (0, 0, 'https://a.es/', 'A & B', 'uno dos'), (0, 1, 'https://b.es/', 'B', ''), (1, 0, 'https://c.es/', 'C', 'the longer snippet'),
  (1, 1, 'https://d.es/', 'D', 'the first text of some length'), (3, 0, 'https://e.es/', 'E', '')) v(m, o, u, t, s) ON s_suppkey % 4 = m"""


# ---- sinks ----


def upsert_contacts_pages(spark, sf_dir):
    """Contacts by (prospect, type, value) and pages by (prospect, URL): the last row wins, the first creation time stays."""
    rows = _t(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS prospect_id", "CASE l_linenumber % 2 WHEN 0 THEN 'email' ELSE 'phone' END AS kind", "cast(l_partkey % 5 AS string) AS value", "l_quantity AS confidence", "l_orderkey * 10 + l_linenumber AS seq", "l_shipdate AS created_at", "l_linestatus AS part")
    old, new = (upsert.upsert(rows.limit(0).drop("part"), rows.where(f"part = '{p}'").drop("part"), ["prospect_id", "kind", "value"], ["seq", "confidence"]) for p in ("F", "O"))
    return upsert.upsert(old, new, ["prospect_id", "kind", "value"], ["seq", "confidence"]).select("prospect_id", "kind", "value", "confidence", "seq", "created_at")


UPSERT_CONTACTS_PAGES = """WITH r AS (SELECT l_suppkey AS prospect_id, CASE l_linenumber % 2 WHEN 0 THEN 'email' ELSE 'phone' END AS kind, (l_partkey % 5)::varchar AS value, l_quantity, l_quantity AS confidence, l_orderkey * 10 + l_linenumber AS seq, l_shipdate AS created_at, CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS part FROM lineitem)
SELECT prospect_id, kind, value, arg_max(confidence, {'p': part, 's': seq, 'c': l_quantity}) AS confidence, arg_max(seq, {'p': part, 's': seq, 'c': l_quantity}) AS seq, arg_min(created_at, {'p': part, 's': seq, 'c': l_quantity}) AS created_at FROM r GROUP BY prospect_id, kind, value"""


def page_rows(spark, sf_dir):
    """Page rows of prospects: named pages, crawled ones over them, links only where nothing else names the URL."""
    p = _t(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS prospect_id", "CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'https://a.es/' END AS primary_identity_url", "'https://w.es/' AS website_url", "CASE WHEN s_suppkey % 3 = 0 THEN 'social_profile' ELSE 'website' END AS primary_identity_type",
        "CASE WHEN s_suppkey % 2 = 0 THEN 'https://a.es/contacto' END AS contact_page_url", "CASE WHEN s_suppkey % 5 = 0 THEN 'https://a.es/reservas' END AS booking_url", "cast(NULL AS string) AS pricing_page_url",
        "CASE WHEN s_suppkey % 6 = 0 THEN array(named_struct('url', 'https://a.es/contacto', 'page_type', ''), named_struct('url', 'https://a.es/x', 'page_type', 'services')) ELSE cast(array() AS array<struct<url:string,page_type:string>>) END AS crawled_pages", "array('https://a.es/contacto', 'https://a.es/about', 'https://a.es/about') AS internal_links")
    return upsert.pages(p)


PAGE_ROWS = """SELECT s_suppkey AS prospect_id, CASE WHEN s_suppkey % 4 = 0 THEN 'https://w.es/' ELSE 'https://a.es/' END AS url, CASE WHEN s_suppkey % 3 = 0 THEN 'social_profile' ELSE 'home' END AS page_type FROM supplier
UNION ALL SELECT s_suppkey, 'https://a.es/contacto', CASE WHEN s_suppkey % 6 = 0 THEN 'other' ELSE 'contact' END FROM supplier UNION ALL SELECT s_suppkey, 'https://a.es/about', 'about' FROM supplier
UNION ALL SELECT s_suppkey, 'https://a.es/reservas', 'booking' FROM supplier WHERE s_suppkey % 5 = 0 UNION ALL SELECT s_suppkey, 'https://a.es/x', 'services' FROM supplier WHERE s_suppkey % 6 = 0"""


def counter_and_null_fills(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").selectExpr("c_custkey", "cast(CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 7 END AS bigint) AS total_found", "cast(CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 4 END AS bigint) AS total_saved", "CASE WHEN c_custkey % 2 = 0 THEN 'rejected' END AS quality_status", "CASE WHEN c_custkey % 3 = 0 THEN 'acme' END AS canonical_identity", "concat(c_mktsegment, '.es') AS domain")
    return upsert.fill_defaults(rows.withColumn("total_skipped", F.expr(upsert.skipped_counter()))).select("c_custkey", "total_skipped", "quality_status", "canonical_identity")


COUNTER_AND_NULL_FILLS = """SELECT c_custkey, greatest(CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 7 ELSE 0 END - CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 4 ELSE 0 END, 0) AS total_skipped, CASE WHEN c_custkey % 2 = 0 THEN 'rejected' ELSE 'accepted' END AS quality_status, CASE WHEN c_custkey % 3 = 0 THEN 'acme' ELSE c_mktsegment || '.es' END AS canonical_identity FROM customer"""


def saved_rows(spark, sf_dir):
    """One row for each supplier, order, line and run, so that no two rows of a run have one place in the order."""
    one = _t(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey", "l_linenumber", "l_linestatus").agg(F.max(F.struct("l_quantity", "l_partkey")).alias("m"))
    return one.selectExpr("concat('s', l_suppkey, '.es') AS canonical_identity", "l_orderkey % 7 AS job_id", "m.l_quantity AS score", "cast(m.l_partkey % 4 AS string) AS v", "l_orderkey * 10 + l_linenumber AS seq", "l_linestatus AS run")


def save_four_tables(spark, sf_dir):
    """Two runs saved one after the other: counts and checksums of the four tables of each prospect."""
    from . import pipeline

    rows = saved_rows(spark, sf_dir)
    kinds = {"prospects": "prospect_id, canonical_identity, score", "job_prospects": "job_id, prospect_id, score", "prospect_contacts": "prospect_id, contact_type, contact_value, score", "prospect_pages": "prospect_id, url, score"}

    def tables(run: str) -> dict:
        r = rows.where(f"run = '{run}'").selectExpr("canonical_identity", "job_id", "score", "'email' AS contact_type", "v AS contact_value", "concat('https://', v, '.es') AS url", f"concat('{run}', canonical_identity) AS prospect_id", "seq AS created_at", "seq AS updated_at")
        return {name: r.select("canonical_identity", *(c for c in [*columns.split(", "), "created_at", "updated_at"] if c != "canonical_identity")) for name, columns in kinds.items()}

    empty = {name: tables("F")[name].limit(0).select(*columns.split(", "), "created_at", "updated_at") for name, columns in kinds.items()}
    saved = pipeline.save(pipeline.save(empty, tables("F")), tables("O"))
    sums = [saved[n].groupBy("prospect_id").agg(F.count("*").alias(f"{n}_rows"), F.sum("score").alias(f"{n}_score"), F.sum("created_at").alias(f"{n}_created")) for n in kinds]
    df = sums[0]
    for other in sums[1:]:
        df = df.join(other, "prospect_id")
    return df


def _save_sql() -> str:
    keys = {"prospects": "1", "job_prospects": "job_id", "prospect_contacts": "v", "prospect_pages": "v"}
    one = lambda n, k: f"{n} AS (SELECT s, count(*) AS {n}_rows, sum(score) AS {n}_score, sum(created)::bigint AS {n}_created FROM (SELECT s, {k} AS k, arg_max(score, {{'r': run, 'q': seq}}) AS score, arg_min(seq, {{'r': run, 'q': seq}}) AS created FROM r GROUP BY s, k) GROUP BY s)"
    columns = ", ".join(f"{n}_rows, {n}_score, {n}_created" for n in keys)
    return f"""WITH g AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_linestatus, max({{'q': l_quantity, 'p': l_partkey}}) AS m FROM lineitem GROUP BY ALL), r AS (SELECT l_suppkey AS s, l_orderkey % 7 AS job_id, m.q AS score, m.p % 4 AS v, l_orderkey * 10 + l_linenumber AS seq, CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS run FROM g), f AS (SELECT s, min(run) AS run FROM r GROUP BY s), {', '.join(one(n, k) for n, k in keys.items())}
SELECT CASE f.run WHEN 0 THEN 'F' ELSE 'O' END || 's' || s || '.es' AS prospect_id, {columns} FROM f {' '.join(f'JOIN {n} USING (s)' for n in keys)}"""


# ---- jobs ----


def job_status(spark, sf_dir):
    from .adapters import adapter

    logs = adapter(spark, sf_dir, "logs")
    jobs = logs.select("job_id").distinct().selectExpr(
        "job_id", "element_at(array('completed', 'failed', 'running', 'pending'), cast(job_id % 4 AS int) + 1) AS status", "job_id % 10 AS total_processed", "job_id % 5 AS total_saved", "job_id % 3 AS total_skipped", "job_id % 2 AS total_failed",
        "concat('day ', job_id % 28) AS started_at", "concat('day ', job_id % 28 + 1) AS finished_at", "CASE WHEN job_id % 8 = 1 THEN 'sin red' END AS error_message")
    totals, errors = kpi.logs_total(logs), kpi.logs_total(logs, "ERROR").withColumnRenamed("total", "errors")
    df = kpi.job_status(jobs, kpi.recent_errors(logs), log=totals, log_errors=errors)
    return df.select("job_id", "status", F.col("message").alias("status_message"), F.col("log.total").alias("log_rows"), F.coalesce("log_errors.errors", F.lit(0)).alias("error_rows"), F.expr("coalesce(array_join(transform(recent_errors, e -> e.message), ','), '')").alias("recent"))


JOB_STATUS = """WITH l AS (SELECT user_id AS job_id, event_type = 'error' AS bad FROM events), c AS (SELECT job_id, count(*) AS log_rows, count(*) FILTER (bad) AS error_rows FROM l GROUP BY job_id), j AS (SELECT *, 'Procesadas: ' || (job_id % 10) || ', guardadas: ' || (job_id % 5) || ', omitidas: ' || (job_id % 3) || ', fallidas: ' || (job_id % 2) AS counts FROM c)
SELECT job_id, ['completed', 'failed', 'running', 'pending'][job_id % 4 + 1] AS status, CASE job_id % 4 WHEN 0 THEN 'Completado en day ' || (job_id % 28 + 1) || ' | ' || counts WHEN 1 THEN 'Falló en day ' || (job_id % 28 + 1) || ' | ' || CASE WHEN job_id % 8 = 1 THEN 'sin red' ELSE 'Error no especificado' END WHEN 2 THEN 'En ejecución desde day ' || (job_id % 28) || ' | ' || counts ELSE 'Pendiente' END AS status_message,
  log_rows, error_rows, array_to_string(list_transform(range(least(error_rows, 3)), lambda i: 'error'), ',') AS recent FROM j"""


def batch_flatten(spark, sf_dir):
    rows = _t(spark, sf_dir, "part").selectExpr("p_partkey", "array(array(concat('q', p_partkey % 3), 'a'), array('a', concat('q', p_partkey % 2)), cast(array() AS array<string>), array('b')) AS query_batches")
    return rows.select("p_partkey", F.expr(f"array_join({synthesis.flatten_batches('query_batches')}, ',')").alias("queries"))


BATCH_FLATTEN = "SELECT p_partkey, 'q' || (p_partkey % 3) || ',a' || CASE WHEN p_partkey % 3 <> p_partkey % 2 THEN ',q' || (p_partkey % 2) ELSE '' END || ',b' AS queries FROM part"


# ---- location, sizes, social evidence ----

_TARGETS = ["", "España", "Lima", "Madrid"]


def location_assess(spark, sf_dir):
    """What a page says of its place against the target of a job: six kinds of pages, four targets."""
    none = "cast(array() AS array<string>)"
    node = "array('{\"address\": {\"addressLocality\": \"Cusco\", \"addressRegion\": \"Sierra\", \"addressCountry\": \"PE\", \"postalCode\": \"08001\"}}')"
    rows = _t(spark, sf_dir, "customer").selectExpr(
        "c_custkey", f"CASE c_custkey % 6 WHEN 0 THEN array('Calle Mayor 1, 28013 Madrid, España') WHEN 5 THEN array('Hotel Castellana') ELSE {none} END AS addresses", f"{none} AS map_links", f"CASE WHEN c_custkey % 6 = 1 THEN array('Lima') ELSE {none} END AS area_served",
        f"CASE WHEN c_custkey % 6 = 2 THEN {node} ELSE {none} END AS structured_data", "CASE WHEN c_custkey % 6 = 3 THEN 'Taller en Madrid' ELSE '' END AS title", "'' AS description", "cast(NULL AS string) AS discovery_title", "cast(NULL AS string) AS discovery_snippet",
        "CASE WHEN c_custkey % 6 = 4 THEN 'https://acme.es/' ELSE 'https://acme.com/' END AS website_url", f"CASE WHEN c_custkey % 6 = 4 THEN array('+34911223344') ELSE {none} END AS phones", f"{_case('c_custkey div 6', 4, _TARGETS, _spark_lit)} AS target_location",
        f"CASE WHEN c_custkey % 7 = 0 THEN array('https://x.es/equipo') ELSE {none} END AS internal_links", f"CASE c_custkey % 4 WHEN 0 THEN array('a', 'b') WHEN 1 THEN array('a') ELSE {none} END AS social_links", "c_custkey % 9 = 0 AS form_detected", "c_custkey % 11 = 0 AS hiring_signals", "(c_custkey % 10) / 10D AS score",
        f"CASE WHEN c_custkey % 2 = 0 THEN array('o') ELSE {none} END AS offer_signals", f"CASE WHEN c_custkey % 3 = 0 THEN array('c') ELSE {none} END AS platform_ctas", f"CASE WHEN c_custkey % 5 = 0 THEN array('l') ELSE {none} END AS profile_links", "CASE WHEN c_custkey % 8 = 0 THEN 'w' END AS whatsapp_url", f"{none} AS emails",
        "CASE WHEN c_custkey % 13 = 0 THEN 'match' ELSE 'unknown' END AS language_match_status", f"{none} AS audience_signals", f"CASE WHEN c_custkey % 4 = 3 THEN array('a') ELSE {none} END AS activity_signals")
    df = quality.assess_location(rows)
    evidence = F.expr("array_join(transform(geo_evidence, e -> concat(e.source, ':', e.value)), '|')").alias("evidence")
    return df.select("c_custkey", evidence, "city", "region", "country", "postal_code", "location", "location_match_status", "location_confidence", "validated_location", F.expr(quality.company_size()).alias("company_size"), F.expr(quality.social_evidence()).alias("social_evidence"))


LOCATION_ASSESS = f"""WITH r AS (SELECT c_custkey, c_custkey % 6 AS k, {_case('c_custkey // 6', 4, _TARGETS)} AS t FROM customer), p AS (SELECT *, CASE k WHEN 0 THEN 'Madrid' WHEN 1 THEN 'Lima' WHEN 2 THEN 'Cusco' END AS city, CASE WHEN k = 2 THEN 'Sierra' END AS region, CASE WHEN k = 0 OR (k = 4 AND t = 'España') THEN 'España' WHEN k IN (1, 2) THEN 'Perú' END AS country, CASE k WHEN 0 THEN '28013' WHEN 2 THEN '08001' END AS postal_code,
  CASE WHEN k = 0 THEN '28013 Madrid, España' WHEN k = 1 THEN 'Lima, Perú' WHEN k = 2 THEN '08001 Cusco, Sierra, Perú' WHEN k = 4 AND t = 'España' THEN 'España' END AS location, (k = 0 AND t = 'España') OR (k = 1 AND t = 'Lima') OR (k = 3 AND t IN ('España', 'Madrid')) OR (k = 4 AND t = 'España') AS hit, k = 0 AND t IN ('Lima', 'Madrid') AS against FROM r)
SELECT c_custkey, CASE WHEN k = 0 THEN 'address:Calle Mayor 1, 28013 Madrid, España' WHEN k = 1 THEN 'area_served:Lima' WHEN k = 2 THEN 'postal_address_country:Perú' WHEN k = 3 THEN 'title:Taller en Madrid' WHEN k = 5 THEN 'address:Hotel Castellana' WHEN t = 'España' THEN 'tld:España|phone_prefix:España' ELSE '' END AS evidence, city, region, country, postal_code, location,
  CASE WHEN hit THEN 'match' WHEN against THEN 'mismatch' ELSE 'unknown' END AS location_match_status, CASE WHEN k IN (0, 5) OR (k = 4 AND t = 'España') THEN 'high' WHEN k IN (1, 2, 3) THEN 'medium' ELSE 'low' END AS location_confidence, CASE WHEN hit THEN coalesce(location, 'Taller en Madrid') WHEN against THEN location END AS validated_location,
  CASE WHEN c_custkey % 11 = 0 THEN 'medium' WHEN c_custkey % 7 = 0 OR c_custkey % 4 = 0 THEN 'small' WHEN (c_custkey % 10) / 10.0 <= 0.25 AND c_custkey % 9 <> 0 THEN 'solo' ELSE 'unknown' END AS company_size,
  (c_custkey % 2 = 0)::int + (c_custkey % 3 = 0 OR c_custkey % 5 = 0)::int + (c_custkey % 8 = 0 OR k = 4)::int + (hit OR c_custkey % 13 = 0)::int + (c_custkey % 4 = 3)::int AS social_evidence FROM p"""


# ---- key pages ----


def crawl_merge(spark, sf_dir):
    """Metadata of up to five pages of a site, with an early stop, merged in order; then the site's identity."""
    none = "cast(array() AS array<string>)"
    docs = _t(spark, sf_dir, "documents").where("doc_id IS NOT NULL").selectExpr("doc_id div 5 AS root", "cast(doc_id % 5 AS int) AS o", "doc_id AS d", "coalesce(text, '') AS clean_text")
    one = lambda k, expr: f"CASE WHEN d % {k} = 0 THEN array({expr}) ELSE {none} END"
    made = {
        "emails": one(7, "concat('e', d % 3)"), "phones": one(11, "'p'"), "social_links": none, "social_profiles": none, "internal_links": one(2, "concat('l', d % 4), 'x'"), "external_links": none, "map_links": none, "addresses": one(3, "concat('a', d % 2)"), "opening_hours": none, "cta_candidates": none,
        "structured_data": none, "structured_data_evidence": one(4, "'json_ld_detected'"), "contact_channels": none, "area_served": none, "title": "CASE d % 4 WHEN 0 THEN '' WHEN 1 THEN concat('t', d) END", "description": "cast(NULL AS string)", "html_lang": "CASE WHEN d % 5 = 2 THEN 'es' END", "meta_locale": "cast(NULL AS string)",
        "whatsapp_url": "CASE WHEN d % 6 = 0 THEN concat('w', d) END", "booking_url": "CASE WHEN d % 8 = 1 THEN concat('b', d) END", "pricing_page_url": "cast(NULL AS string)", "service_page_url": "cast(NULL AS string)", "primary_cta": "CASE WHEN d % 3 = 1 THEN 'booking' END", "primary_identity_type": "'website'", "primary_identity_url": "concat('https://www.', d, '.es/')",
        "form_detected": "d % 13 = 0", "url": "concat('u', d)", "invalid_phone_candidates_count": "cast(d % 3 AS int)", "phone_validation_rejections": "CASE WHEN d % 2 = 0 THEN map('date_like', cast(d % 3 AS int), 'noise', 1) ELSE map('date_like', 1) END", "social_profile": "cast(NULL AS struct<handle:string>)", "page_type": "CASE d % 3 WHEN 0 THEN 'contact' WHEN 1 THEN 'about' END",
    }
    rows = docs.select("root", "o", "d", "clean_text", *(F.expr(e).alias(c) for c, e in made.items()))
    df = crawl.merge(crawl.stop_when_enough(rows, "root", "o"), "root", "o")
    joined = lambda c: F.array_join(c, "|").alias(c)
    counts = [F.expr(f"coalesce(element_at(phone_validation_rejections, '{k}'), 0)").alias(k) for k in ("date_like", "noise")]
    return df.select("root", *map(joined, ["emails", "phones", "internal_links", "addresses", "structured_data_evidence"]), "title", "html_lang", "whatsapp_url", "booking_url", "primary_cta", "primary_identity_url", "form_detected", "invalid_phone_candidates_count", *counts, "pages_crawled", F.md5("crawl_text").alias("text_md5"), F.expr("array_join(transform(crawled_pages, p -> concat(p.url, ':', coalesce(p.page_type, ''))), '|')").alias("pages"))


def _crawl_sql() -> str:
    listed = lambda name, test, items: f"{name} AS (SELECT root, array_to_string(list(v ORDER BY place), '|') AS {name} FROM (SELECT root, v, min(o * 10 + i) AS place FROM (SELECT root, o, unnest({items}) AS v, unnest(range(len({items}))) AS i FROM k WHERE {test}) GROUP BY root, v) GROUP BY root)"
    first = lambda name, expr: f"arg_min({expr}, o) FILTER (coalesce({expr}, '') <> '') AS {name}"
    lists = [("emails", "d % 7 = 0", "['e' || (d % 3)]"), ("phones", "d % 11 = 0", "['p']"), ("internal_links", "d % 2 = 0", "['l' || (d % 4), 'x']"), ("addresses", "d % 3 = 0", "['a' || (d % 2)]"), ("structured_data_evidence", "d % 4 = 0", "['json_ld_detected']")]
    before = "OVER (PARTITION BY root ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""WITH r AS (SELECT doc_id // 5 AS root, doc_id % 5 AS o, doc_id AS d, coalesce(text, '') AS t FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT *, coalesce(max((d % 7 = 0 OR d % 11 = 0 OR d % 13 = 0)::int) {before}, 0) * coalesce(max((d % 3 = 0)::int) {before}, 0) * coalesce(max((d % 3 = 1 OR d % 8 = 1)::int) {before}, 0) AS enough FROM r), k AS (SELECT * FROM s WHERE enough = 0),
{', '.join(listed(*x) for x in lists)},
m AS (SELECT root, {first('title', "CASE WHEN d % 4 = 1 THEN 't' || d END")}, {first('html_lang', "CASE WHEN d % 5 = 2 THEN 'es' END")}, {first('whatsapp_url', "CASE WHEN d % 6 = 0 THEN 'w' || d END")}, {first('booking_url', "CASE WHEN d % 8 = 1 THEN 'b' || d END")}, {first('primary_cta', "CASE WHEN d % 3 = 1 THEN 'booking' END")}, {first('primary_identity_url', "'https://www.' || d || '.es/'")},
  bool_or(d % 13 = 0) AS form_detected, sum(d % 3)::bigint AS invalid_phone_candidates_count, sum(CASE WHEN d % 2 = 0 THEN d % 3 ELSE 1 END)::bigint AS date_like, sum(CASE WHEN d % 2 = 0 THEN 1 ELSE 0 END)::bigint AS noise, count(*) AS pages_crawled, string_agg('u' || d || ':' || CASE d % 3 WHEN 0 THEN 'contact' WHEN 1 THEN 'about' ELSE '' END, '|' ORDER BY o) AS pages,
  md5(coalesce(string_agg('[' || CASE d % 3 WHEN 0 THEN 'CONTACT' WHEN 1 THEN 'ABOUT' ELSE 'OTHER' END || '] ' || substr(t, 1, 1200), chr(10) || chr(10) ORDER BY o) FILTER (t <> ''), '')) AS text_md5 FROM k GROUP BY root)
SELECT m.*, {', '.join(f"coalesce({n}, '') AS {n}" for n, _, _ in lists)} FROM m {' '.join(f'LEFT JOIN {n} USING (root)' for n, _, _ in lists)}"""


def site_identity(spark, sf_dir):
    """Canonical identity, website, domain and contact page of pages with metadata."""
    none = "cast(array() AS array<string>)"
    rows = _t(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "CASE WHEN c_custkey % 3 = 0 THEN 'social_profile' ELSE 'website' END AS primary_identity_type", f"{_case('c_custkey', 4, ['https://www.Acme.es/x', 'https://instagram.com/Acme', 'http://acme.es:8080/', 'https://tiktok.com/@a'], _spark_lit)} AS primary_identity_url", "concat('https://www.s', c_custkey % 5, '.es/') AS url",
        f"CASE WHEN c_custkey % 3 = 0 THEN named_struct('platform', 'instagram', 'handle', CASE WHEN c_custkey % 2 = 0 THEN 'Acme' END, 'external_links', CASE c_custkey % 4 WHEN 0 THEN array('mailto:x', 'https://www.out.es/a') ELSE {none} END) END AS social_profile",
        f"CASE c_custkey % 5 WHEN 0 THEN array('https://x.es/nosotros', 'https://x.es/Contacto') WHEN 1 THEN array('https://x.es/equipo') ELSE {none} END AS internal_links")
    return crawl.identity(rows).select("c_custkey", "canonical_identity", "website_url", "domain", "contact_page_url")


SITE_IDENTITY = """WITH r AS (SELECT c_custkey AS c, c_custkey % 3 = 0 AS soc FROM customer), w AS (SELECT *, CASE WHEN NOT soc THEN 'https://www.s' || (c % 5) || '.es/' WHEN c % 4 = 0 THEN 'https://www.out.es/a' END AS website_url FROM r)
SELECT c AS c_custkey, CASE WHEN soc AND c % 2 = 0 THEN 'instagram:acme' WHEN soc THEN ['', 'https://instagram.com/acme', '', 'https://tiktok.com/@a'][c % 4 + 1] ELSE ['acme.es', 'instagram.com', 'acme.es:8080', 'tiktok.com'][c % 4 + 1] END AS canonical_identity, website_url, CASE WHEN soc AND c % 4 = 0 THEN 'out.es' ELSE 's' || (c % 5) || '.es' END AS domain,
  CASE c % 5 WHEN 0 THEN 'https://x.es/Contacto' WHEN 1 THEN 'https://x.es/equipo' END AS contact_page_url FROM w"""


# ---- what models are asked and what is kept of it ----


def search_plans(spark, sf_dir):
    """Search plans out of payloads, their cache key, and prompts cut to their limits.

    The made-up texts grow with the key up to twice their limit: what a prompt leaves out is there, but a row's size doesn't grow with the table.
    """
    payloads = ['{"optimal_dork_queries": [" a ", "a", "", null, "b"], "dynamic_negative_terms": ["-x"], "target_entity_hints": [], "exclusion_entity_hints": ["y", "z"]}', "broken", None, '{"optimal_dork_queries": "no list"}']
    rows = _t(spark, sf_dir, "part").selectExpr("p_partkey", f"{_case('p_partkey', 4, payloads, _spark_lit)} AS payload", "CASE WHEN p_partkey % 2 = 0 THEN 'Dentistas' END AS query", "CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'Editor' END AS profession", f"repeat('x', cast(least(p_partkey * 7, {2 * extraction.TEXT_LIMIT}) AS int)) AS body", f"CASE WHEN p_partkey % 5 = 0 THEN repeat('y', cast(least(p_partkey * 5, {2 * extraction.PACK_LIMIT}) AS int)) END AS pack")
    df = extraction.search_plan(rows)
    lists = ["optimal_dork_queries", "dynamic_negative_terms", "target_entity_hints", "exclusion_entity_hints"]
    return df.select("p_partkey", *(F.array_join(c, "|").alias(c) for c in lists), F.expr(extraction.plan_key("query", "profession", "cast(NULL AS string)", "'Lima'")).alias("plan_key"), F.md5(F.expr(extraction.extraction_prompt("'Perfil X'", "pack", "body"))).alias("prompt_md5"))


SEARCH_PLANS = """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a|b' ELSE '' END AS optimal_dork_queries, CASE p_partkey % 4 WHEN 0 THEN '-x' ELSE '' END AS dynamic_negative_terms, '' AS target_entity_hints, CASE p_partkey % 4 WHEN 0 THEN 'y|z' ELSE '' END AS exclusion_entity_hints,
  CASE WHEN p_partkey % 2 = 0 THEN 'dentistas' ELSE '' END || '|' || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'editor' END || '||lima' AS plan_key, md5('Perfil: Perfil X' || chr(10) || CASE WHEN p_partkey % 5 = 0 THEN repeat('y', least(p_partkey * 5, 4000)::int) ELSE repeat('x', least(p_partkey * 7, 10000)::int) END) AS prompt_md5 FROM part"""


def model_traces(spark, sf_dir):
    """Payloads met by signature, the method that scores a page, its trace, and fields of the evidence pack."""
    good = '{"inferred_niche": "Dental", "inferred_tech_stack": [], "generic_attributes": {}, "hiring_signals": false, "estimated_revenue_signal": "low", "score": 0.5, "confidence_level": "high"}'
    pages = _t(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "concat('s', c_custkey % 50) AS signature", f"{_case('c_custkey', 4, ['ai_required', 'quality_rejected', 'ai_required', 'commercial_rejected'], _spark_lit)} AS ai_gate", "repeat('a b  ', cast(c_custkey % 30 * 20 + 10 AS int)) AS clean_text", "'acme.es' AS domain", "CASE WHEN c_custkey % 3 = 0 THEN 'T' END AS title", "c_custkey / 1000D AS heuristic_score", "array('x') AS service_keywords")
    payloads = _t(spark, sf_dir, "nation").selectExpr("explode(array(n_nationkey, n_nationkey + 25)) AS k").selectExpr("concat('s', k) AS signature", f"CASE k % 3 WHEN 0 THEN {_spark_lit(good)} WHEN 1 THEN 'broken' ELSE '{{}}' END AS payload", "cast(k AS bigint) AS total_tokens").where("signature <> 's7'")
    df = extraction.evidence_pack(extraction.trace(extraction.with_payloads(pages, payloads.unionByName(payloads)), "acme", "v2"))
    t = "ai_trace."
    return df.select("c_custkey", "selected_method", "fallback_reason", "ai_niche", "ai_score", F.expr(t + "status").alias("status"), F.expr(t + "evaluation_method").alias("method"), F.expr(t + "prompt_version").alias("version"), F.expr(t + "total_tokens").alias("tokens"), F.expr("length(get_json_object(evidence_pack, '$.summary_text'))").alias("summary_chars"), F.expr("get_json_object(evidence_pack, '$.title')").alias("pack_title"), F.expr("get_json_object(evidence_pack, '$.service_keywords[0]')").alias("pack_keyword"))


MODEL_TRACES = """WITH r AS (SELECT c_custkey, c_custkey % 50 AS k, c_custkey % 4 IN (0, 2) AS asked, (c_custkey % 30 * 20 + 10) AS n FROM customer), j AS (SELECT *, asked AND k <> 7 AS has FROM r),
m AS (SELECT *, CASE WHEN NOT asked THEN CASE c_custkey % 4 WHEN 1 THEN 'quality_rejected' ELSE 'commercial_rejected' END WHEN n * 5 < 100 THEN 'insufficient_text' WHEN NOT has THEN 'missing_payload' WHEN k % 3 = 1 THEN 'invalid_json' WHEN k % 3 = 2 THEN 'invalid_payload' END AS reason FROM j)
SELECT c_custkey, CASE WHEN reason IS NULL THEN 'ai' ELSE 'heuristic' END AS selected_method, reason AS fallback_reason, CASE WHEN has AND k % 3 = 0 THEN 'Dental' END AS ai_niche, CASE WHEN has AND k % 3 = 0 THEN 0.5::double END AS ai_score, CASE WHEN NOT asked THEN 'skipped' WHEN reason IS NULL THEN 'success' ELSE 'fallback' END AS status, CASE WHEN reason IS NULL THEN 'model' ELSE 'heuristic' END AS method, 'v2' AS version,
  CASE WHEN has THEN k END AS tokens, least(n * 4 - 1, 1800) AS summary_chars, CASE WHEN c_custkey % 3 = 0 THEN 'T' END AS pack_title, 'x' AS pack_keyword FROM m"""


def job_contexts(spark, sf_dir):
    """Query parameters of jobs, and what a hit keeps of its discovery."""
    from . import pipeline

    filters = ['{"discovery_profile": {"user_service_offers": ["web", "seo"], "user_target_offer_focus": "tiendas"}, "target_accepted_results": 7}', '{"target_accepted_results": "x", "max_candidates_to_process": "12"}', None, "broken"]
    jobs = _t(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", f"{_case('o_orderkey', 4, filters, _spark_lit)} AS filters_json", f"{_case('o_orderkey', 5, ['ddg', 'url_list', 'google_search', None, 'mock'], _spark_lit)} AS source_type", "CASE WHEN o_orderkey % 2 = 0 THEN 'Dental' END AS target_niche")
    df = pipeline.job_context(jobs).select("job_id", F.array_join("user_service_offers", "|").alias("offers"), "user_target_offer_focus", "source_type", "target_niche", "target_accepted_results", "max_candidates_to_process")
    hits = df.selectExpr("*", "concat('q', job_id % 3) AS query", "cast(job_id % 9 AS int) AS position", "'T' AS title", "0.5D AS score", "array('q0', 'q1') AS queries")
    d = operators_hits.discovery_metadata(hits)
    return d.select(*df.columns, F.expr("discovery.source_query").alias("source_query"), F.expr("discovery.serp_position").alias("serp_position"), F.expr("discovery.business_likeness_score").alias("likeness"), F.expr("discovery.seed_source_url").cast("string").alias("seed"), F.expr("size(discovery.queries)").alias("n_queries"))


JOB_CONTEXTS = """SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 4 = 0 THEN 'web|seo' END AS offers, CASE WHEN o_orderkey % 4 = 0 THEN 'tiendas' END AS user_target_offer_focus, CASE o_orderkey % 5 WHEN 0 THEN 'duckduckgo_search' WHEN 1 THEN 'seed_url' WHEN 4 THEN 'mock_search' END AS source_type, CASE WHEN o_orderkey % 2 = 0 THEN 'Dental' END AS target_niche,
  CASE WHEN o_orderkey % 4 = 0 THEN 7 END AS target_accepted_results, CASE WHEN o_orderkey % 4 = 1 THEN 12 END AS max_candidates_to_process, 'q' || (o_orderkey % 3) AS source_query, o_orderkey % 9 AS serp_position, 0.5::double AS likeness, NULL::varchar AS seed, 2 AS n_queries FROM orders"""


def seed_expand(spark, sf_dir):
    """Kept hits on directories give way to the official site that their page links, else they go."""
    rows = _t(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "CASE WHEN s_suppkey % 4 = 3 THEN 'https://plain.es/' ELSE concat('https://www.yelp.com/biz/', s_suppkey) END AS url", "'Clinica dental' AS title", "'contacto y servicios' AS snippet")
    kept = operators_hits.process(rows, True, blocked=["blocked.invalid"]).withColumnRenamed("result_kind", "kind_").withColumn("exclusion_reason", F.lit(None).cast("string"))
    kept = kept.select("id", "url", "title", "snippet", "score", "reasons", "discovery_confidence")
    anchors = rows.where("id % 4 < 2").selectExpr("url AS seed_url", "explode(array(named_struct('o', 0, 'u', 'https://www.yelp.com/about', 'l', 'sitio web'), named_struct('o', 1, 'u', 'https://facebook.com/x', 'l', 'web'), named_struct('o', 2, 'u', concat('https://s', id, '.es/a/b/c'), 'l', CASE WHEN id % 4 = 0 THEN 'Sitio web' ELSE 'x' END), named_struct('o', 3, 'u', concat('https://t', id, '.es/'), 'l', 'otro'))) AS a").selectExpr("seed_url", "a.o AS ordinal", "a.u AS url", "a.l AS label")
    best = operators_hits.official_site(anchors)
    found, gone = operators_hits.expand_seeds(kept, anchors, True)
    out = found.select("id", "url", "seed_source_url", "seed_source_type").unionByName(gone.selectExpr("cast(NULL AS bigint) AS id", "url", "reason AS seed_source_url", "'gone' AS seed_source_type"))
    return out.unionByName(best.selectExpr("cast(NULL AS bigint) AS id", "url", "concat(seed_url, ' ', score) AS seed_source_url", "'best' AS seed_source_type"))


SEED_EXPAND = """WITH r AS (SELECT s_suppkey AS id, s_suppkey % 4 AS k, 'https://www.yelp.com/biz/' || s_suppkey AS seed FROM supplier), b AS (SELECT id, seed, CASE k WHEN 0 THEN 'https://s' || id || '.es/a/b/c' ELSE 'https://t' || id || '.es/' END AS url, CASE k WHEN 0 THEN '0.75' ELSE '0.55' END AS score FROM r WHERE k < 2)
SELECT id, 'https://plain.es/' AS url, NULL AS seed_source_url, NULL AS seed_source_type FROM r WHERE k = 3 UNION ALL SELECT id, url, seed, 'directory_seed' FROM b UNION ALL SELECT NULL, seed, 'excluded_as_directory_seed:yelp', 'gone' FROM r WHERE k < 3 UNION ALL SELECT NULL, url, seed || ' ' || score, 'best' FROM b"""


QUERIES = {
    "page_parse_cases": (page_parse_cases, PAGE_PARSE_CASES), "social_parse_cases": (social_parse_cases, SOCIAL_PARSE_CASES), "provider_errors": (provider_errors, PROVIDER_ERRORS), "provider_discovery": (provider_discovery, PROVIDER_DISCOVERY), "seed_and_json_hits": (seed_and_json_hits, SEED_AND_JSON_HITS),
    "result_page_hits": (result_page_hits, RESULT_PAGE_HITS), "upsert_contacts_pages": (upsert_contacts_pages, UPSERT_CONTACTS_PAGES), "page_rows": (page_rows, PAGE_ROWS), "counter_and_null_fills": (counter_and_null_fills, COUNTER_AND_NULL_FILLS), "save_four_tables": (save_four_tables, _save_sql()), "job_status": (job_status, JOB_STATUS), "batch_flatten": (batch_flatten, BATCH_FLATTEN),
    "location_assess": (location_assess, LOCATION_ASSESS), "crawl_merge": (crawl_merge, _crawl_sql()), "site_identity": (site_identity, SITE_IDENTITY),  "search_plans": (search_plans, SEARCH_PLANS), "model_traces": (model_traces, MODEL_TRACES), "job_contexts": (job_contexts, JOB_CONTEXTS), "seed_expand": (seed_expand, SEED_EXPAND),
}
