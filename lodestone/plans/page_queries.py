"""Queries over pages and documents: text scalars, links, hits, entities, features, geography, contacts, pipelines; with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import contacts, urls
from ..functions.plan import spread
from ..functions.text import fold_padded, fold_trimmed
from ..functions.text import hits as count_hits
from ..operators import crawl, entity, features, hits, quality
from ..rules import features as feature_rules
from ..rules import hits as hit_rules
from ..rules import quality as quality_rules
from ..rules import taxonomy as taxonomy_rules
from ..sources import providers
from ..sources.html import read_pages
from . import pipeline


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


# ---- SQL helpers, for the twins only ----


def _lit(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _any(column: str, tokens) -> str:
    return "(" + " OR ".join(f"contains({column}, {_lit(t)})" for t in dict.fromkeys(tokens)) + ")"


def _count(column: str, tokens) -> str:
    return "(" + " + ".join(f"(contains({column}, {_lit(t)}))::int" for t in tokens) + ")"


def _occ(column: str, tokens) -> str:
    return "(" + " + ".join(f"((length({column}) - length(replace({column}, {_lit(t)}, ''))) // {len(t)})" for t in tokens) + ")"


FOLD = "lower(regexp_replace(strip_accents({0}), '[^\\x00-\\x7F]', '', 'g'))"
COLLAPSE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
HOST = "regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www[.]', '')"
PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


# ---- emails, phones, language, keywords ----


def email_extract(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.explode(F.expr(contacts.extract_emails("text"))).alias("raw"))
    return rows.select("doc_id", "raw", F.expr(contacts.email("raw")).alias("email"), F.expr(contacts.email("raw", ["yourdomain"])).alias("email_unblocked"))


EMAIL_EXTRACT = r"""WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b')) AS raw FROM documents), c AS (SELECT *, lower(trim(trim(raw), '.,;:()[]{}<>"''')) AS v FROM r)
SELECT doc_id, raw, CASE WHEN contains(v, '@') AND NOT (contains(v, 'example.com') OR contains(v, 'yourdomain') OR contains(v, 'domain.com') OR contains(v, 'email.com') OR contains(v, 'test.com') OR contains(v, 'localhost')) THEN v END AS email,
  CASE WHEN NOT contains(v, 'yourdomain') THEN v END AS email_unblocked FROM c"""

_PHONES = r"""r AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:(?:\+|00)\d{1,3}[\s\-./]?)?(?:\(?\d{2,4}\)?[\s\-./]?){2,5}\d{2,4}')) AS raw FROM documents
  UNION ALL SELECT -1, unnest(['+34 600 111 222', '0034600111222', '++34600111', '123456', '1234567890123456', '20052023', '20230520', '10:30 12 11', '12k 555 1234', '1912345678', '2055123456', '7777777', '1234567', '9876543', 'm 5551234'])),
n AS (SELECT doc_id, raw, regexp_replace(regexp_replace(raw, '[^0-9+]', '', 'g'), '^00', '+') AS n FROM r), d AS (SELECT *, replace(n, '+', '') AS d FROM n),
j AS (SELECT *, CASE WHEN length(n) - length(replace(n, '+', '')) > 1 OR (contains(n, '+') AND NOT starts_with(n, '+')) THEN 'invalid_plus_format' WHEN length(d) < 7 OR length(d) > 15 THEN 'invalid_length'
  WHEN length(d) = 8 AND ((substr(d, 1, 2)::int BETWEEN 1 AND 31 AND substr(d, 3, 2)::int BETWEEN 1 AND 12 AND substr(d, 5, 4)::int BETWEEN 1900 AND 2100) OR (substr(d, 1, 4)::int BETWEEN 1900 AND 2100 AND substr(d, 5, 2)::int BETWEEN 1 AND 12 AND substr(d, 7, 2)::int BETWEEN 1 AND 31)) THEN 'date_like'
  WHEN (contains(raw, ':') AND length(d) <= 8) OR regexp_matches(raw, '\b[0-9]{1,2}:[0-9]{2}\b') THEN 'timestamp_like' WHEN contains(lower(raw), 'k') OR contains(lower(raw), 'm') OR (length(d) IN (8, 10) AND substr(d, 1, 2) IN ('19', '20')) THEN 'metric_like'
  WHEN replace(d, left(d, 1), '') = '' OR contains('01234567890', d) OR contains('09876543210', d) THEN 'sequence_noise' END AS reason FROM d)"""
_FIXTURE_PHONES = ["+34 600 111 222", "0034600111222", "++34600111", "123456", "1234567890123456", "20052023", "20230520", "10:30 12 11", "12k 555 1234", "1912345678", "2055123456", "7777777", "1234567", "9876543", "m 5551234"]


def _phones(spark, sf_dir):
    found = _t(spark, sf_dir, "documents").select("doc_id", F.explode(F.expr(contacts.extract_phones("text"))).alias("raw"))
    extra = spark.createDataFrame([(-1, p) for p in _FIXTURE_PHONES], "doc_id bigint, raw string")
    df = found.unionByName(extra).withColumn("n", F.expr(contacts.phone_digits("raw"))).withColumn("d", F.expr("replace(n, '+', '')"))
    return df.withColumn("reason", F.expr(contacts.phone_rejection("raw", "n", "d")))


def phone_classify(spark, sf_dir):
    return _phones(spark, sf_dir).select("doc_id", "raw", F.expr("CASE WHEN reason IS NULL THEN n END").alias("phone"), "reason")


PHONE_CLASSIFY = f"WITH {_PHONES} SELECT doc_id, raw, CASE WHEN reason IS NULL THEN n END AS phone, reason FROM j"


def phone_rejection_counts(spark, sf_dir):
    return _phones(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


PHONE_COUNTS = f"WITH {_PHONES} SELECT coalesce(reason, 'ok') AS reason, count(*) AS n, count(DISTINCT doc_id) AS docs FROM j GROUP BY 1"


def language_detect(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    return docs.select("doc_id", F.expr(quality.detect_language("text")).alias("detected"), F.expr(features.language_hint(fold_padded("text"))).alias("hint"))


def _best(scores: dict[str, str]) -> str:
    top = f"greatest({', '.join(scores.values())})"
    return f"CASE WHEN {top} > 1 THEN CASE " + " ".join(f"WHEN {s} = {top} THEN '{n}'" for n, s in scores.items()) + " END END"


_PADDED = "CASE WHEN " + COLLAPSE.format("lower(text)") + " = '' THEN ' ' ELSE ' ' || " + COLLAPSE.format("lower(text)") + " || ' ' END"
_DETECTED = _best({k: _occ("p", v) for k, v in quality_rules.LANGUAGES.items()})
LANGUAGE_DETECT = f"SELECT doc_id, {_DETECTED} AS detected, {_best({k: _occ('f', v) for k, v in feature_rules.LANGUAGES.items()})} AS hint FROM (SELECT doc_id, {_PADDED} AS p, ' ' || {FOLD.format('text')} || ' ' AS f FROM documents)"


def language_confusion(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").withColumn("detected", F.expr(quality.detect_language("text")))
    df = docs.groupBy("lang", "detected").agg(F.count("*").alias("n"))
    return df.withColumn("status", F.expr(quality.language_match("lang", "detected")))


LANGUAGE_CONFUSION = f"SELECT lang, detected, count(*) AS n, CASE WHEN detected IS NULL THEN 'unknown' WHEN lang = detected THEN 'match' ELSE 'mismatch' END AS status FROM (SELECT lang, {_DETECTED} AS detected FROM (SELECT lang, {_PADDED} AS p FROM documents)) GROUP BY lang, detected"


def service_keywords_top5(spark, sf_dir):
    df = quality.service_keywords(_t(spark, sf_dir, "documents"), "doc_id", "text")
    return df.select("doc_id", F.col("rank").cast("bigint").alias("rank"), "token", "n")


SERVICE_KEYWORDS = "WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-zA-ZáéíóúñÁÉÍÓÚÑ]{4,}')) AS token FROM documents), c AS (SELECT doc_id, token, count(*) AS n FROM t WHERE token NOT IN (" + ", ".join(map(_lit, quality_rules.STOPWORDS)) + ") GROUP BY ALL) SELECT doc_id, rank, token, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, token) AS rank FROM c) WHERE rank <= 5"


def ai_signature(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    return docs.select("doc_id", F.expr(quality.signature("source", "substring(text, 1, 2500)", "'v1'")).alias("signature"))


AI_SIGNATURE = "SELECT doc_id, sha256(source || '|v1|' || substr(text, 1, 2500)) AS signature FROM documents"


def text_fold(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.expr(f"length({fold_trimmed('text')})").alias("folded_chars"), F.expr(f"md5({fold_trimmed('text')})").alias("folded_md5"))


TEXT_FOLD = f"SELECT doc_id, length({COLLAPSE.format(FOLD.format('text'))}) AS folded_chars, md5({COLLAPSE.format(FOLD.format('text'))}) AS folded_md5 FROM documents"


# ---- URLs and links ----


def url_identity(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", F.expr(urls.domain("url")).alias("domain"), F.expr(urls.registered(urls.host("url"), quality_rules.SECOND_LEVEL)).alias("registered"), F.expr(urls.path("url")).alias("path"))


URL_IDENTITY = f"SELECT page_id, {HOST} AS domain, CASE WHEN len(string_split({HOST}, '.')) <= 2 THEN {HOST} ELSE array_to_string(list_slice(string_split({HOST}, '.'), -2, -1), '.') END AS registered, {PATH} AS path FROM pages"

_KIND_WORDS = [("contact", ["the", "an"]), ("pricing", ["on", "er"]), ("services", ["de"])]


def page_type_classify(spark, sf_dir):
    kinds = {"parsed": urls.PARSED_KINDS, "crawled": urls.CRAWL_KINDS, "stored": urls.STORED_KINDS, "words": _KIND_WORDS}
    fixture = [f"https://a.test/{p}" for p in ("contacto", "book-a-quote", "precios", "servicios/citas", "sedes", "equipo", "empleo", "location/contact", "x")]
    rows = _t(spark, sf_dir, "pages").select("url").unionByName(spark.createDataFrame([(u,) for u in fixture], "url string"))
    return rows.select("url", *(F.expr(urls.page_kind("url", k)).alias(n) for n, k in kinds.items()))


def _kind_sql(kinds) -> str:
    return "CASE " + " ".join(f"WHEN {_any('lower(url)', w)} THEN '{k}'" for k, w in kinds) + " ELSE 'other' END"


PAGE_TYPES = "SELECT url, " + ", ".join(f"{_kind_sql(k)} AS {n}" for n, k in (("parsed", urls.PARSED_KINDS), ("crawled", urls.CRAWL_KINDS), ("stored", urls.STORED_KINDS), ("words", _KIND_WORDS))) + " FROM (SELECT url FROM pages UNION ALL SELECT 'https://a.test/' || unnest(['contacto', 'book-a-quote', 'precios', 'servicios/citas', 'sedes', 'equipo', 'empleo', 'location/contact', 'x']))"


def html_links(spark, sf_dir):
    raw = read_pages(_t(spark, sf_dir, "pages"))
    return raw.select("page_id", F.explode("anchors").alias("a")).select("page_id", F.col("a.ordinal").cast("bigint").alias("ordinal"), "a.href", "a.label", F.col("a.url").alias("target"))


_LINKS = """a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS tag, generate_subscripts(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>'), 1) - 1 AS ordinal FROM pages),
l AS (SELECT page_id, url, ordinal, html_unescape(regexp_extract(tag, 'href="([^"]*)"', 1)) AS href, trim(html_unescape(regexp_extract(tag, '>([^<]*)<', 1))) AS label FROM a)"""
HTML_LINKS = ("WITH " + _LINKS + """ SELECT page_id, ordinal, href, label, CASE WHEN starts_with(href, 'http') THEN href WHEN starts_with(href, '/') THEN regexp_extract(url, '^[a-z]+://[^/?#]*') || href END AS target FROM l""").replace("html_unescape", "")


def links_internal_external(spark, sf_dir):
    raw = read_pages(_t(spark, sf_dir, "pages"))
    rows = raw.select("page_id", "url", F.explode("anchors").alias("a"))
    inside = f"{urls.host('a.url')} = {urls.host('url')}"
    return rows.groupBy("page_id").agg(F.count_if(F.expr(inside)).alias("internal"), F.count_if(F.expr(f"NOT ({inside})")).alias("external"), F.count_if(F.expr(f"{urls.page_kind('a.url', _KIND_WORDS)} <> 'other'")).alias("keyed"))


LINKS_IN_OUT = ("WITH " + _LINKS + ", t AS (SELECT page_id, " + HOST + " AS h, CASE WHEN starts_with(href, 'http') THEN href ELSE regexp_extract(url, '^[a-z]+://[^/?#]*') || href END AS target FROM l), u AS (SELECT *, " + HOST.replace("(url", "(target") + " AS th FROM t) SELECT page_id, count(*) FILTER (th = h) AS internal, count(*) FILTER (th <> h) AS external, count(*) FILTER (" + _kind_sql(_KIND_WORDS).replace("url", "target") + " <> 'other') AS keyed FROM u GROUP BY page_id").replace("html_unescape", "")


def key_links_top5(spark, sf_dir):
    raw = read_pages(_t(spark, sf_dir, "pages")).withColumn("host", F.expr(urls.host("url")))
    df = crawl.key_links(raw.select("host", F.explode("anchors").alias("a")).select("host", F.col("a.url").alias("link")), "host", "link")
    return df.select("host", "link", "page_type", F.col("crawl_rank").cast("bigint").alias("crawl_rank"))


KEY_LINKS = ("WITH " + _LINKS + ", t AS (SELECT DISTINCT " + HOST + " AS host, CASE WHEN starts_with(href, 'http') THEN href ELSE regexp_extract(url, '^[a-z]+://[^/?#]*') || href END AS link FROM l), k AS (SELECT *, " + _kind_sql(urls.CRAWL_KINDS).replace("url", "link") + " AS page_type FROM t) SELECT host, link, page_type, crawl_rank FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY list_position(['contact', 'locations', 'pricing', 'booking', 'services', 'about', 'careers', 'other'], page_type), link) AS crawl_rank FROM k) WHERE crawl_rank <= 5").replace("html_unescape", "")


def page_merge_by_host(spark, sf_dir):
    raw = read_pages(_t(spark, sf_dir, "pages")).withColumn("host", F.expr(urls.host("url")))
    # one row for each link, so that no host's links are gathered in one place
    rows = raw.select("host", "page_id", "title", F.posexplode_outer(F.transform("anchors", lambda a: a["href"])).alias("place", "href"))
    pages = F.count_if(F.col("place").isNull() | (F.col("place") == 0))
    return rows.groupBy("host").agg(pages.alias("pages"), F.count_distinct("href").alias("links"), F.expr("min_by(title, page_id) <> ''").alias("titled"), F.min("page_id").alias("first_page"))


PAGE_MERGE = ("WITH " + _LINKS + f", h AS (SELECT {HOST} AS host, count(*) AS pages, min(page_id) AS first_page, arg_min(contains(html, '<title>'), page_id) AS titled FROM pages GROUP BY 1), c AS (SELECT {HOST} AS host, count(DISTINCT href) AS links FROM l GROUP BY 1) SELECT h.host, pages, coalesce(links, 0) AS links, titled, first_page FROM h LEFT JOIN c ON h.host = c.host").replace("html_unescape", "")


def html_text_parse(spark, sf_dir):
    raw = read_pages(_t(spark, sf_dir, "pages"))
    return raw.select("page_id", "title", "html_lang", "form_detected", F.length("clean_text").alias("chars"), F.sha2("clean_text", 256).alias("text_sha256"))


_UNESCAPED = "replace(replace(replace(replace({0}, '&middot;', '·'), '&copy;', '©'), '&quot;', '\"'), '&amp;', '&')"
_VISIBLE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', '', 'gs'), '<style[^>]*>.*?</style>', '', 'gs'), '<!--.*?-->', ' ', 'gs'), '<[^>]+>', ' ', 'g')"
HTML_TEXT = f"""WITH p AS (SELECT page_id, trim({_UNESCAPED.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")}) AS title, nullif(regexp_extract(html, '<html lang="([^"]*)"', 1), '') AS html_lang, contains(html, '<form') AS form_detected, {COLLAPSE.format(_UNESCAPED.format(_VISIBLE))} AS t FROM pages)
SELECT page_id, title, html_lang, form_detected, length(t) AS chars, sha256(t) AS text_sha256 FROM p"""


def page_metadata(spark, sf_dir):
    from ..operators.parse import parse

    df = parse(read_pages(_t(spark, sf_dir, "pages")))
    return df.select("page_id", "title", "html_lang", F.size("emails").alias("emails"), F.size("phones").alias("phones"), F.size("internal_links").alias("internal"), F.size("external_links").alias("external"), "primary_cta", "primary_identity_type", "invalid_phone_candidates_count")


def site_summary(spark, sf_dir):
    raw = read_pages(_t(spark, sf_dir, "pages")).withColumns({"domain": F.expr(urls.domain("url")), "language": F.expr(quality.detect_language("clean_text", "html_lang")), "n_links": F.size("anchors").cast("bigint")})
    return raw.groupBy("domain").agg(F.count("*").alias("pages"), F.sum("n_links").alias("links"), F.count_if(F.col("language") == "en").alias("english"), F.countDistinct("language").alias("languages"), F.min("page_id").alias("first_page"))


SITE_SUMMARY = ("WITH " + _LINKS + f", p AS (SELECT page_id, {HOST} AS domain, regexp_extract(html, '<html lang=\"([a-z]+)', 1) AS language FROM pages), n AS (SELECT page_id, count(*) AS n FROM l GROUP BY 1) SELECT domain, count(*) AS pages, cast(sum(coalesce(n, 0)) AS bigint) AS links, count(*) FILTER (language = 'en') AS english, count(DISTINCT language) AS languages, min(p.page_id) AS first_page FROM p LEFT JOIN n ON p.page_id = n.page_id GROUP BY domain").replace("html_unescape", "")


# ---- hits ----

#: Hits: pages with their title as title, and a fixture with one row for each branch.
_BRANCHES = [
    ("https://www.acme.com/", "Acme sitio oficial", "contacto y reserva"), ("https://wix.com/x", "a", "b"), ("https://es.wikipedia.org/wiki/a", "a", "b"), ("https://foo.com/blog/x", "a", "b"), ("https://forbes.com/a", "a", "b"),
    ("https://hubspot.com/a", "a", "b"), ("https://instagram.com/pepe", "t", "dm coach"), ("https://instagram.com/acme", "t", "dm coach"), ("https://tiktok.com/@acme", "t", "x"), ("https://linkedin.com/in/a", "t", "x"),
    ("https://foo.com/product/1", "x", "sku"), ("https://doctoralia.es/a/b/c", "x", "y"), ("https://acme.com/a/b.html", "Acme store tienda", "servicios"), ("ftp://x", "t", "s"), ("https://foo.com/a/b/c", "ministerio directory", "agencia"),
]
_TITLES = ["the", "for"]
_WORDS = [("official_site_hint", 0.35, ["ed ", "tion"]), ("contact_or_services_hint", 0.18, ["an "]), ("conversion_cta_hint", 0.18, ["ment"]), ("business_category_hint", 0.12, ["ung"]), ("commercial_hint", 0.14, ["ción"])]


def _hit_rows(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages").select("page_id", "url", F.expr("regexp_extract(html, '<title>([^<]*)</title>', 1)").alias("title"), F.lit("").alias("snippet"))
    extra = spark.createDataFrame([(-i - 1, *b) for i, b in enumerate(_BRANCHES)], "page_id bigint, url string, title string, snippet string")
    return pages.unionByName(extra)


def hit_classify(spark, sf_dir):
    df = hits.process(_hit_rows(spark, sf_dir), True, positive=_WORDS)
    return df.select("page_id", "result_kind", "score", "exclusion_reason", "discovery_confidence", F.array_join("reasons", ",").alias("reasons"))


def _hits_sql(positive=_WORDS, snippet: str = "''") -> str:
    rows = ", ".join(f"({-i - 1}, {_lit(u)}, {_lit(t)}, {_lit(s)})" for i, (u, t, s) in enumerate(_BRANCHES))
    r = hit_rules
    rated = [(f"'{n}'", w, _any("b", ws)) for n, w, ws in positive]
    rated += [(f"'{n}'", w, f"({_any('b', ws)} OR {_any('p', ws)})") for n, w, ws in (("product_page", -0.35, [*r.PRODUCT_PATHS, *r.PRODUCT_WORDS]), ("institutional_page", -0.25, r.INSTITUTIONS), ("marketplace_or_listing", -0.25, ["marketplace", "listing", "directory", "directorio"]))]
    rated += [("'shallow_url'", 0.12, "n <= 1"), ("'moderate_depth'", 0.04, "n = 2"), ("'deep_url'", -0.18, "n > 2"), ("'document_like_path'", -0.05, "(suffix(p, '.html') OR suffix(p, '.php'))"), ("'concise_title'", 0.08, "w BETWEEN 1 AND 10"), ("'brand_domain_match'", 0.22, "brand"), ("'root_domain_url'", 0.08, "p IN ('', '/')"), ("'directory_seed_candidate'", -0.2, _any("u", r.SEED_HOSTS))]
    social = [("'social_profile_candidate'", 0.35, "true"), ("'platform:' || CASE WHEN contains(h, 'instagram.com') THEN 'instagram' ELSE 'tiktok' END", 0.0, "true"), ("'canonical_handle_detected'", 0.2, "true"), ("'social_commercial_cta_hint'", 0.2, _any("b", r.PROFILE_HINTS)), ("'social_commercial_niche_hint'", 0.15, _any("b", r.COMMERCIAL)), ("'concise_title'", 0.05, "w BETWEEN 1 AND 12")]
    total = lambda x: " + ".join(f"CASE WHEN {c} THEN {w}::double ELSE 0::double END" for _, w, c in x)
    names = lambda x: "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN {n} END" for n, _, c in x) + ")"
    words = lambda c: f"list_filter(string_split(trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda t: length(t) >= 4 AND t NOT IN ('http', 'https', 'www', 'site', 'oficial', 'official', 'contacto', 'contact'))"
    return f"""WITH i AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, {snippet} AS snippet FROM pages UNION ALL SELECT * FROM (VALUES {rows})),
c AS (SELECT page_id, lower(url) AS u, {COLLAPSE.format('title')} AS t, {COLLAPSE.format('snippet')} AS s FROM i), k AS (SELECT *, lower(t || ' ' || s) AS b, regexp_extract(u, '^[a-z]+://([^/?#]*)', 1) AS h, regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM c),
x AS (SELECT *, list_filter(string_split(p, '/'), lambda g: g <> '') AS g, len(list_filter(string_split(p, '/'), lambda g: g <> '')) AS n, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS w, len(list_intersect({words('t')}, {words("string_split(regexp_replace(h, '^www[.]', ''), '.')[1]")})) > 0 AS brand FROM k),
z AS (SELECT *, CASE {' '.join(f"WHEN contains(u, {_lit(t)}) THEN {_lit('blocked_domain:' + t)}" for t in r.BLOCKED)} END AS blk, {_any('p', r.EDITORIAL_PATHS)} AS ep, {total(rated)} AS web, {names(rated)} AS wr, least({total(social)}, 1.0::double) AS soc, {names(social)} AS sr FROM x),
q AS (SELECT *, CASE WHEN blk IS NOT NULL THEN 'blocked' WHEN {_any('h', r.REFERENCE_HOSTS)} OR {_any('b', r.REFERENCE_WORDS)} THEN 'reference' WHEN ep OR {_any('b', r.EDITORIAL_TITLES)} THEN 'article' WHEN {_any('h', [*r.NEWS_HOSTS, *r.FINANCE_HOSTS])} OR {_any('b', r.ENTERPRISE_WORDS)} THEN 'media' WHEN {_any('h', r.ENTERPRISE_HOSTS)} THEN 'enterprise'
  WHEN {_any('u', r.SOCIAL_HOSTS)} THEN CASE WHEN {_any('u', [*r.POST_PATHS, *r.SHARE_MARKS])} THEN 'post' WHEN (contains(h, 'instagram.com') AND n = 1 AND NOT (starts_with(g[1], 'p') OR starts_with(g[1], 'reel') OR starts_with(g[1], 'explore') OR starts_with(g[1], 'stories'))) OR (contains(h, 'tiktok.com') AND n = 1 AND starts_with(g[1], '@')) THEN 'profile' ELSE 'not_profile' END ELSE 'website' END AS st FROM z),
o AS (SELECT page_id, u, b, st, blk, wr, web, CASE st WHEN 'blocked' THEN -0.5::double WHEN 'website' THEN round_even(web, 4) WHEN 'profile' THEN round_even(soc, 4) ELSE 0::double END AS score, CASE WHEN p IN ('', '/') THEN 'website_home' ELSE 'website_inner_page' END AS home, ep, sr FROM q),
e AS (SELECT *, CASE st WHEN 'blocked' THEN home WHEN 'website' THEN home WHEN 'reference' THEN 'article_or_reference' WHEN 'article' THEN 'article_or_reference' WHEN 'media' THEN 'media_or_news' WHEN 'enterprise' THEN 'large_enterprise_noise' WHEN 'profile' THEN 'social_profile' ELSE 'social_post' END AS result_kind,
  CASE WHEN NOT starts_with(u, 'http') THEN 'invalid_url' WHEN st = 'blocked' THEN blk WHEN st IN ('reference', 'media') THEN 'excluded_reference_page' WHEN st = 'article' THEN 'excluded_as_article' WHEN st = 'enterprise' THEN 'excluded_large_enterprise' WHEN st IN ('post', 'not_profile') THEN 'excluded_social_post' WHEN st = 'website' THEN CASE WHEN contains(wr, 'product_page') THEN 'excluded_as_product_page' WHEN web < 0.15::double THEN 'low_business_likeness' END END AS exclusion_reason FROM o)
SELECT page_id, result_kind, score, exclusion_reason, CASE WHEN exclusion_reason IS NULL THEN CASE WHEN contains(b, 'oficial') OR contains(b, 'official') OR result_kind = 'social_profile' OR score >= 0.45 THEN 'high' WHEN score <= 0.2 THEN 'low' ELSE 'medium' END END AS discovery_confidence,
  CASE st WHEN 'blocked' THEN blk WHEN 'reference' THEN 'reference_or_article' WHEN 'article' THEN CASE WHEN ep THEN 'editorial_path' ELSE 'editorial_title' END WHEN 'media' THEN 'media_or_finance' WHEN 'enterprise' THEN 'large_enterprise_noise' WHEN 'post' THEN 'social_post_or_share' WHEN 'not_profile' THEN 'non_canonical_social_profile' WHEN 'profile' THEN sr ELSE wr END AS reasons FROM e"""


HIT_CLASSIFY = _hits_sql()

_SNIPPETS = ["Sitio oficial de la casa", "contacto y servicios", "reserva tu cita", "clinica dental", "agencia para empresas y coaches", "comprar, carrito, sku", "ministerio de obras", "marketplace directory", ""]


def hit_classify_real(spark, sf_dir):
    """The same with the real word lists, and a snippet for every page."""
    snippet = f"CASE WHEN page_id >= 0 THEN element_at(array({', '.join(_lit(x) for x in _SNIPPETS)}), cast(pmod(page_id, {len(_SNIPPETS)}) AS int) + 1) ELSE snippet END"
    df = hits.process(_hit_rows(spark, sf_dir).withColumn("snippet", F.expr(snippet)), True)
    return df.select("page_id", "result_kind", "score", "exclusion_reason", "discovery_confidence", F.array_join("reasons", ",").alias("reasons"))


HIT_CLASSIFY_REAL = _hits_sql(hits.POSITIVE, "[" + ", ".join(map(_lit, _SNIPPETS)) + f"][page_id % {len(_SNIPPETS)} + 1]")


def hit_rank(spark, sf_dir):
    df = hits.process(_hit_rows(spark, sf_dir), True, positive=_WORDS).withColumn("query", F.expr("pmod(page_id, 7)"))
    return hits.rank(df, ["query"], "page_id").where("rank <= 10").select("query", "page_id", F.col("rank").cast("bigint").alias("rank"), "score")


HIT_RANK = "WITH hc AS (" + HIT_CLASSIFY + f"), u AS (SELECT page_id, url FROM pages UNION ALL SELECT * FROM (VALUES {', '.join(f'({-i - 1}, {_lit(b[0])})' for i, b in enumerate(_BRANCHES))})), k AS (SELECT ((hc.page_id % 7) + 7) % 7 AS query, hc.page_id, score, row_number() OVER (PARTITION BY ((hc.page_id % 7) + 7) % 7 ORDER BY score DESC, discovery_confidence <> 'high', length(url), hc.page_id) AS rank FROM hc JOIN u ON hc.page_id = u.page_id WHERE exclusion_reason IS NULL) SELECT query, page_id, rank, score FROM k WHERE rank <= 10"


def url_dedupe_position(spark, sf_dir):
    rows = _t(spark, sf_dir, "pages").select("page_id", F.expr(urls.host("url")).alias("url"), F.expr("page_id % 3").alias("job_id"))
    df = hits.dedupe(rows, "url", ["page_id"], ["job_id"])
    return df.select("job_id", "page_id", "url", F.col("position").cast("bigint").alias("position"), "exclusion_reason")


URL_DEDUPE = f"WITH h AS (SELECT page_id, {HOST} AS url, page_id % 3 AS job_id FROM pages), c AS (SELECT *, row_number() OVER (PARTITION BY job_id, url ORDER BY page_id) AS n FROM h), p AS (SELECT job_id, page_id, url, CASE WHEN n = 1 THEN row_number() OVER (PARTITION BY job_id, n = 1 ORDER BY page_id) END AS position, CASE WHEN n > 1 THEN 'duplicate_url' END AS exclusion_reason FROM c) SELECT * FROM p"


def brand_overlap(spark, sf_dir):
    rows = _hit_rows(spark, sf_dir)
    return rows.select("page_id", F.expr(f"array_join(array_sort(array_distinct({hits.brand_tokens('title')})), ' ')").alias("brand"), F.expr(f"array_join({hits.domain_brand('url')}, ' ')").alias("site"))


_TOKENS = "list_filter(string_split(trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda t: length(t) >= 4 AND t NOT IN ('http', 'https', 'www', 'site', 'oficial', 'official', 'contacto', 'contact'))"
BRAND_OVERLAP = "WITH i AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-i - 1}, {_lit(b[0])}, {_lit(b[1])})" for i, b in enumerate(_BRANCHES)) + ")) SELECT page_id, array_to_string(list_sort(list_distinct(" + _TOKENS.format("title") + ")), ' ') AS brand, array_to_string(" + _TOKENS.format("string_split(" + HOST + ", '.')[1]") + ", ' ') AS site FROM i"


# ---- entities, taxonomy, features, gate, geography ----

_ENTITY_WORDS = {"agency": ["tion", "ment"], "directory": ["the ", "ing"], "media": ["ung", "ción"], "association": ["thath"]}


def entity_scores(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.expr(f"concat(' ', {fold_trimmed('substring(text, 1, 1200)')}, ' ')").alias("s"))
    df = docs.select("doc_id", *(F.expr(count_hits("s", entity.folded(ws))).alias(k) for k, ws in _ENTITY_WORDS.items()))
    order = "array_sort(array(" + ", ".join(f"named_struct('s', -{p} * {k}, 'o', {i}, 'k', '{k}')" for i, (k, p) in enumerate((("agency", 3), ("directory", 3), ("media", 2), ("association", 4)))) + "))"
    return df.select("doc_id", *_ENTITY_WORDS, F.expr(f"CASE WHEN {order}[0].s < 0 THEN {order}[0].k ELSE 'unknown' END").alias("top"), F.expr(f"-{order}[0].s + {order}[1].s").alias("margin"))


_ENTITY_SUMS = ", ".join(f"{_count('s', entity.folded(ws))} AS {k}" for k, ws in _ENTITY_WORDS.items())
ENTITY_SCORES = f"WITH d AS (SELECT doc_id, ' ' || {COLLAPSE.format(FOLD.format('substr(text, 1, 1200)'))} || ' ' AS s FROM documents), c AS (SELECT doc_id, {_ENTITY_SUMS} FROM d), o AS (SELECT *, list_reverse_sort([3 * agency, 3 * directory, 2 * media, 4 * association]) AS v FROM c) SELECT doc_id, agency, directory, media, association, CASE WHEN v[1] = 0 THEN 'unknown' WHEN 3 * agency = v[1] THEN 'agency' WHEN 3 * directory = v[1] THEN 'directory' WHEN 2 * media = v[1] THEN 'media' ELSE 'association' END AS top, v[1] - v[2] AS margin FROM o"

_TAX = [("alpha", "a", "A", "A", ["tion", "ment", "the "], []), ("beta", "b", "B", "B", ["ung", "eur", "que"], []), ("gamma", "c", "C", "C", ["ing", "and", "ción", "spa"], []), ("unknown", "unknown", "Desconocido", "Desconocido", [], [])]


def taxonomy_topscore(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.lit("").alias("title"), F.lit("").alias("description"), F.expr("cast(array() AS array<string>)").alias("internal_links"), F.col("text").alias("clean_text"), F.expr("cast(array() AS array<string>)").alias("structured_data"), F.lit(None).cast("string").alias("inferred_niche"), F.lit(None).cast("string").alias("kind"))
    made = ["taxonomy_business_type", "taxonomy_top_level", "display_category", "taxonomy_score", "taxonomy_niche"]
    real = entity.taxonomy(docs, "kind").withColumn("real_type", F.col("taxonomy_business_type")).drop(*made)
    return entity.taxonomy(real, "kind", table=_TAX).select("doc_id", "taxonomy_business_type", "taxonomy_top_level", "taxonomy_score", "real_type")


def _taxonomy_sql() -> str:
    text = COLLAPSE.format(FOLD.format("substr(text, 1, 2400)"))
    score = lambda ws: f"2 * least(3, {_count('s', entity.folded(ws))})"
    real = {row[0]: score(row[4]) for row in taxonomy_rules.TAXONOMY if row[4]}
    return f"""WITH d AS (SELECT doc_id, {text} AS s FROM documents), o AS (SELECT doc_id, {', '.join(f"{score(r[4])} AS {r[0]}" for r in _TAX[:3])}, greatest({', '.join(real.values())}) AS best, CASE {' '.join(f"WHEN {e} = greatest({', '.join(real.values())}) THEN '{k}'" for k, e in real.items())} END AS rk FROM d)
SELECT doc_id, CASE WHEN greatest(alpha, beta, gamma) < 3 THEN 'unknown' WHEN alpha >= beta AND alpha >= gamma THEN 'alpha' WHEN beta >= gamma THEN 'beta' ELSE 'gamma' END AS taxonomy_business_type, CASE WHEN greatest(alpha, beta, gamma) < 3 THEN 'unknown' WHEN alpha >= beta AND alpha >= gamma THEN 'a' WHEN beta >= gamma THEN 'b' ELSE 'c' END AS taxonomy_top_level,
  greatest(alpha, beta, gamma) AS taxonomy_score, CASE WHEN best < 3 THEN 'unknown' ELSE rk END AS real_type FROM o"""


TAXONOMY_TOPSCORE = _taxonomy_sql()


def business_model_fit(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").withColumns({"low": F.lower(F.substring("text", 1, 2400)), "niche": F.expr("CASE pmod(doc_id, 3) WHEN 0 THEN 'Tienda online' WHEN 1 THEN 'cursos online y shopify' ELSE '' END")})
    targets, observed = quality.target_models("niche", "cast(NULL AS string)"), quality.observed_model("low", "cast(NULL AS string)", provider=["thatha"], product=["ungen"], education=["tion "], shop=["que "])
    df = docs.select("doc_id", F.expr(targets).alias("t"), F.expr(observed).alias("observed"))
    return df.select("doc_id", F.array_join("t", ",").alias("targets"), "observed", F.expr(quality.model_fit("t", "observed")).alias("fit"))


MODEL_FIT = """WITH d AS (SELECT doc_id, lower(substr(text, 1, 2400)) AS s, CASE doc_id % 3 WHEN 0 THEN 'ecommerce_business' WHEN 1 THEN 'ecommerce_business,education_business' ELSE '' END AS targets FROM documents), o AS (SELECT *, CASE WHEN contains(s, 'thatha') THEN 'service_provider' WHEN contains(s, 'ungen') THEN 'product_page' WHEN contains(s, 'tion ') THEN 'education_business' WHEN contains(s, 'que ') THEN 'ecommerce_business' END AS observed FROM d)
SELECT doc_id, targets, observed, CASE WHEN targets = '' THEN 'unknown' WHEN observed IS NOT NULL AND contains(targets, observed) THEN 'match' WHEN observed IN ('service_provider', 'product_page') THEN 'mismatch' ELSE 'unknown' END AS fit FROM o"""

_OFFERS = ["consultoria para empresas ", "anadir al carrito ", "curso online ", "tienda online ", "", "agencia de marketing "]


def business_model_real(spark, sf_dir):
    """Business models with the real word lists: an offer in front of every text, the entity type by id."""
    offer = "element_at(array(" + ", ".join(map(_lit, _OFFERS)) + f"), cast(pmod(doc_id, {len(_OFFERS)}) AS int) + 1)"
    docs = _t(spark, sf_dir, "documents").withColumns({"low": F.expr(f"lower(substring(concat({offer}, text), 1, 2400))"), "kind": F.expr("CASE pmod(doc_id, 5) WHEN 0 THEN ' Agency' WHEN 1 THEN 'media' END"), "niche": F.expr("CASE pmod(doc_id, 4) WHEN 0 THEN 'Tienda online' WHEN 1 THEN 'Academia' END"), "focus": F.expr("CASE pmod(doc_id, 7) WHEN 0 THEN 'cursos' END")})
    df = docs.select("doc_id", F.expr(quality.target_models("niche", "focus")).alias("t"), F.expr(quality.observed_model("low", "kind")).alias("observed"))
    return df.select("doc_id", F.array_join("t", ",").alias("targets"), "observed", F.expr(quality.model_fit("t", "observed")).alias("fit"))


def _model_sql() -> str:
    r = quality_rules
    target = "lower(concat_ws(' ', CASE doc_id % 4 WHEN 0 THEN 'Tienda online' WHEN 1 THEN 'Academia' ELSE '' END, CASE doc_id % 7 WHEN 0 THEN 'cursos' ELSE '' END))"
    offer = "[" + ", ".join(map(_lit, _OFFERS)) + f"][doc_id % {len(_OFFERS)} + 1]"
    return f"""WITH d AS (SELECT doc_id, lower(substr({offer} || text, 1, 2400)) AS s, {target} AS n FROM documents), o AS (SELECT doc_id, concat_ws(',', CASE WHEN {_any('n', r.TARGET_ECOMMERCE)} THEN 'ecommerce_business' END, CASE WHEN {_any('n', r.TARGET_EDUCATION)} THEN 'education_business' END) AS targets,
  CASE WHEN doc_id % 5 = 0 OR {_any('s', r.SERVICE_PROVIDER)} THEN 'service_provider' WHEN {_any('s', r.PRODUCT_PAGE)} THEN 'product_page' WHEN {_any('s', r.EDUCATION)} THEN 'education_business' WHEN {_any('s', r.ECOMMERCE)} THEN 'ecommerce_business' END AS observed FROM d)
SELECT doc_id, targets, observed, CASE WHEN targets = '' THEN 'unknown' WHEN contains(',' || targets || ',', ',' || observed || ',') THEN 'match' WHEN observed IN ('service_provider', 'product_page') THEN 'mismatch' ELSE 'unknown' END AS fit FROM o"""


BUSINESS_MODEL_REAL = _model_sql()

_PLACES = ["Calle Mayor 1, 28013 Madrid, España", "es", "Lima", "Ciudad de México 06000", "Hotel Castellana, Madrid", "Santiago; Chile", "tel 600 111 222, Bogotá", "Springfield", "La Paz, Bolivia", "Av. Corrientes 1234 | Buenos Aires | AR", "MADRID", "nowhere in particular", "Córdoba, Argentina", "uruguay montevideo", ""]


def geo_country_match(spark, sf_dir):
    fixed = spark.createDataFrame([(-i - 1, p) for i, p in enumerate(_PLACES)], "doc_id bigint, place string")
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.expr(f"concat(text, ' ', CASE pmod(doc_id, 4) WHEN 0 THEN 'Perú' WHEN 1 THEN 'in Barcelona now' WHEN 2 THEN 'limabc' ELSE 'México df' END, ' end')").alias("place"))
    rows = fixed.unionByName(docs)
    return rows.select("doc_id", F.expr(quality.country_of("place")).alias("country"), F.expr(quality.country_rule("place")).alias("rule"), F.expr(quality.postal("place")).alias("postal_code"))


def _geo_sql() -> str:
    values = ", ".join(f"({-i - 1}, {_lit(p)})" for i, p in enumerate(_PLACES))
    aliases = quality.country_aliases()
    exact = "CASE f " + " ".join(f"WHEN {_lit(a)} THEN {_lit(n)}" for a, n in aliases) + " END"
    inside = "CASE " + " ".join(f"WHEN contains(' ' || f || ' ', {_lit(f' {a} ')}) THEN {_lit(n)}" for a, n in aliases if len(a) > 2) + " END"
    from ..rules.countries import COUNTRIES

    rule = "CASE " + " ".join(f"WHEN f IN ({', '.join(_lit(quality._fold(x)) for x in [*t, *c])}) THEN {_lit(k)}" for k, _, t, c, _, _, _ in COUNTRIES) + " END"
    return f"WITH r AS (SELECT * FROM (VALUES {values}) v(doc_id, place) UNION ALL SELECT doc_id, text || ' ' || CASE doc_id % 4 WHEN 0 THEN 'Perú' WHEN 1 THEN 'in Barcelona now' WHEN 2 THEN 'limabc' ELSE 'México df' END || ' end' FROM documents), x AS (SELECT *, {COLLAPSE.format(FOLD.format('place'))} AS f FROM r) SELECT doc_id, coalesce({exact}, {inside}) AS country, {rule} AS rule, nullif(upper(regexp_extract(place, '(?i)\\b[A-Z]{{0,2}}\\d{{4,6}}[A-Z]{{0,3}}\\b', 0)), '') AS postal_code FROM x"


GEO_COUNTRY = _geo_sql()


def contact_quality(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.expr("concat('https://www.', CASE pmod(doc_id, 3) WHEN 0 THEN 'mail.example.com' WHEN 1 THEN 'acme.com.ar' ELSE 'other.org' END, '/')").alias("website_url"))
    mail = "CASE pmod(doc_id, 5) WHEN 0 THEN 'a@acme.com.ar' WHEN 1 THEN 'b@gmail.com' WHEN 2 THEN 'c@shop.other.org' WHEN 3 THEN 'd@third.net' END"
    second = "CASE pmod(doc_id, 7) WHEN 0 THEN 'z@example.com' WHEN 3 THEN 'y@yahoo.com' END"
    phone = "CASE pmod(doc_id, 4) WHEN 0 THEN '+34600111222' WHEN 1 THEN '911223344' END"
    one = lambda kind, value, source: f"named_struct('type', '{kind}', 'value', {value}, 'source', {source})"
    source = "CASE pmod(doc_id, 2) WHEN 0 THEN 'mailto_link' ELSE 'visible_text' END"
    channels = f"filter(array({one('email', mail, source)}, {one('phone', phone, quoted_source)}, {one('email', second, quoted_source)}), c -> c.value IS NOT NULL)"
    df = docs.withColumns({"contact_channels": F.expr(channels), "form_detected": F.expr("pmod(doc_id, 6) = 0"), "whatsapp_url": F.expr("CASE WHEN pmod(doc_id, 8) = 0 THEN 'w' END"), "booking_url": F.lit(None).cast("string"), "social_profile": F.expr("cast(NULL AS struct<external_links: array<string>>)")})
    return quality.contact_quality(df).select("doc_id", "primary_email", "primary_phone", "primary_email_confidence", "primary_phone_confidence", "contact_consistency_status", "contact_quality_score", "primary_contact_source")


quoted_source = "'visible_text'"

CONTACT_QUALITY = """WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'example.com' WHEN 1 THEN 'acme.com.ar' ELSE 'other.org' END AS root, CASE doc_id % 5 WHEN 0 THEN 'a@acme.com.ar' WHEN 1 THEN 'b@gmail.com' WHEN 2 THEN 'c@shop.other.org' WHEN 3 THEN 'd@third.net' END AS m1,
  CASE doc_id % 7 WHEN 0 THEN 'z@example.com' WHEN 3 THEN 'y@yahoo.com' END AS m2, CASE doc_id % 4 WHEN 0 THEN '+34600111222' WHEN 1 THEN '911223344' END AS ph, CASE doc_id % 2 WHEN 0 THEN 'mailto_link' ELSE 'visible_text' END AS src FROM documents),
m AS (SELECT doc_id, root, ph, 1 AS o, m1 AS mail, src FROM d WHERE m1 IS NOT NULL UNION ALL SELECT doc_id, root, ph, 3, m2, 'visible_text' FROM d WHERE m2 IS NOT NULL),
r AS (SELECT *, CASE WHEN split_part(mail, '@', 2) = root OR suffix(split_part(mail, '@', 2), '.' || root) THEN 3 WHEN split_part(mail, '@', 2) IN ('gmail.com', 'yahoo.com') THEN 2 ELSE 1 END AS rk FROM m),
b AS (SELECT *, CASE WHEN rk = 3 THEN 'high' WHEN rk = 1 THEN 'low' WHEN src = 'mailto_link' THEN 'high' ELSE 'medium' END AS conf FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rk DESC, o) AS n FROM r) WHERE n = 1),
j AS (SELECT d.doc_id, d.ph, b.rk, CASE WHEN b.rk > 1 THEN b.mail END AS em, CASE WHEN b.rk > 1 THEN b.conf ELSE 'low' END AS ec, b.src AS esrc, CASE WHEN starts_with(d.ph, '+') THEN 'high' WHEN d.ph IS NOT NULL THEN 'medium' ELSE 'low' END AS pc FROM d LEFT JOIN b ON d.doc_id = b.doc_id)
SELECT doc_id, em AS primary_email, ph AS primary_phone, ec AS primary_email_confidence, pc AS primary_phone_confidence, CASE rk WHEN 3 THEN 'consistent' WHEN 1 THEN 'inconsistent' ELSE 'unknown' END AS contact_consistency_status,
  round_even(least(CASE WHEN em IS NOT NULL THEN 0.35::double * CASE ec WHEN 'high' THEN 0.9::double WHEN 'medium' THEN 0.65::double ELSE 0.35::double END ELSE 0.0::double END + CASE WHEN ph IS NOT NULL THEN 0.25::double * CASE pc WHEN 'high' THEN 0.9::double WHEN 'medium' THEN 0.65::double ELSE 0.35::double END ELSE 0.0::double END
    + CASE WHEN doc_id % 6 = 0 THEN 0.15::double ELSE 0.0::double END + CASE WHEN doc_id % 8 = 0 THEN 0.1::double ELSE 0.0::double END, 1.0::double), 4) AS contact_quality_score, CASE WHEN em IS NOT NULL THEN 'email:' || esrc WHEN ph IS NOT NULL THEN 'phone:visible_text' END AS primary_contact_source FROM j"""


def quality_gate(spark, sf_dir):
    pick = lambda k, *vs: "element_at(array(" + ", ".join(f"'{v}'" for v in vs) + f"), cast(pmod(l_partkey div {k}, {len(vs)}) AS int) + 1)"
    rows = _t(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_partkey", "l_suppkey", "l_suppkey % 3 > 0 AS has_target_location", "l_quantity / 50D AS score", f"{pick(1, 'low', 'medium', 'high')} AS confidence_level", f"{pick(3, 'match', 'mismatch', 'unknown', 'match')} AS location_match_status", f"{pick(2, 'match', 'unknown', 'mismatch', 'match', 'match')} AS language_match_status",
        "l_discount * 8D AS contact_quality_score", f"{pick(5, 'consistent', 'unknown', 'inconsistent', 'unknown')} AS contact_consistency_status", f"{pick(7, 'low', 'medium')} AS primary_email_confidence", f"{pick(11, 'low', 'high', 'low')} AS primary_phone_confidence", f"{pick(13, 'website', 'social_profile')} AS primary_identity_type", "cast(l_linenumber % 4 AS int) AS social_evidence",
        f"{pick(17, 'direct_business', 'agency', 'unknown', 'directory', 'media', 'blog_post')} AS entity_type_detected", f"{pick(19, 'low', 'high')} AS entity_type_confidence", "CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_suppkey % 4 = 1 END AS is_target_entity", "CASE WHEN l_linenumber % 2 = 0 THEN 'dental' ELSE '' END AS target_niche", "l_tax * 8D AS context_fit", f"{pick(23, 'match', 'mismatch', 'unknown')} AS business_model_fit_status")
    df = quality.decide(quality.gate(rows))
    return df.select("l_orderkey", "l_partkey", "l_suppkey", "quality_status", "rejection_reason", "quality_flag", "technical_multiplier", "acceptance_decision", "commercial_multiplier", "score_cap", F.expr(quality.needs_model()).alias("ai_gate"))


def _gate_sql() -> str:
    pick = lambda k, *vs: "[" + ", ".join(f"'{v}'" for v in vs) + f"][(l_partkey // {k}) % {len(vs)} + 1]"
    return f"""WITH r AS (SELECT l_orderkey, l_partkey, l_suppkey, l_suppkey % 3 > 0 AS loc, l_quantity / 50.0::double AS sc, {pick(1, 'low', 'medium', 'high')} AS conf, {pick(3, 'match', 'mismatch', 'unknown', 'match')} AS lm, {pick(2, 'match', 'unknown', 'mismatch', 'match', 'match')} AS gm, l_discount * 8.0::double AS cq, {pick(5, 'consistent', 'unknown', 'inconsistent', 'unknown')} AS cc, {pick(7, 'low', 'medium')} AS ec, {pick(11, 'low', 'high', 'low')} AS pc,
  {pick(13, 'website', 'social_profile')} = 'social_profile' AS soc, l_linenumber % 4 AS ev, {pick(17, 'direct_business', 'agency', 'unknown', 'directory', 'media', 'blog_post')} AS et, {pick(19, 'low', 'high')} AS etc, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_suppkey % 4 = 1 END AS tgt, l_linenumber % 2 = 0 AS niche, l_tax * 8.0::double AS fit, {pick(23, 'match', 'mismatch', 'unknown')} AS bm FROM lineitem),
g AS (SELECT *, CASE WHEN loc AND lm = 'mismatch' THEN 1 WHEN loc AND lm = 'unknown' AND sc < 0.45 THEN 2 WHEN loc AND lm = 'unknown' THEN 3 WHEN gm = 'mismatch' AND sc < 0.6 THEN 4 WHEN gm = 'mismatch' THEN 5 WHEN cc = 'inconsistent' AND pc = 'low' AND cq < 0.15 THEN 6 WHEN cc = 'inconsistent' THEN 7 WHEN soc AND ev < 2 THEN 8 WHEN ec = 'low' AND pc = 'low' AND cq < 0.3 AND soc THEN 9 WHEN ec = 'low' AND pc = 'low' AND cq < 0.3 THEN 10 WHEN cq < 0.25 AND conf = 'low' THEN 11 ELSE 12 END AS k FROM r),
q AS (SELECT *, ['rejected', 'rejected', 'needs_review', 'rejected', 'needs_review', 'rejected', 'needs_review', 'needs_review', 'accepted', 'rejected', 'rejected', 'accepted'][k] AS quality_status, ['geo_mismatch', 'geo_unknown_low_score', 'geo_unknown', 'language_mismatch', 'language_mismatch', 'contact_inconsistent', 'contact_inconsistent', 'rejected_social_low_evidence', NULL, 'low_contact_quality', 'low_contact_quality', NULL][k] AS rejection_reason,
  ['geo_mismatch', 'geo_unknown', 'geo_unknown', 'language_mismatch', 'language_mismatch', 'contact_inconsistent', 'contact_inconsistent', 'weak_social_business_evidence', 'social_first_low_direct_contact', 'weak_primary_contact', 'weak_contactability', NULL][k] AS quality_flag, [0.35, 0.8, 0.9, 0.75, 0.75, 0.55, 0.75, 0.75, 0.9, 0.7, 0.75, 1.0][k]::double AS technical_multiplier, coalesce(tgt, false) AS t FROM g),
d AS (SELECT *, CASE WHEN et = 'directory' THEN 1 WHEN et = 'media' THEN 2 WHEN et = 'blog_post' THEN 3 WHEN soc AND quality_status = 'accepted' AND t AND ev >= 2 THEN CASE WHEN niche AND bm = 'mismatch' THEN 4 ELSE 5 END WHEN soc AND quality_status = 'needs_review' THEN 6 WHEN quality_status = 'accepted' AND t THEN CASE WHEN niche AND bm = 'mismatch' THEN 7 WHEN niche AND least(greatest(fit, 0.0), 1.0) < 0.3 THEN 8 ELSE 5 END
  WHEN quality_status = 'accepted' AND et = 'unknown' THEN CASE WHEN sc >= 0.55 AND etc = 'high' THEN 9 ELSE 10 END WHEN quality_status = 'accepted' THEN 11 WHEN rejection_reason = 'low_contact_quality' THEN 12 WHEN quality_status = 'needs_review' THEN 13 ELSE 14 END AS s FROM q),
a AS (SELECT *, ['rejected_directory', 'rejected_media', 'rejected_article', 'accepted_related', 'accepted_target', 'rejected_low_confidence', 'accepted_related', 'accepted_related', 'accepted_related', 'rejected_low_confidence', 'accepted_related', 'rejected_low_confidence', 'rejected_low_confidence', 'rejected_low_confidence'][s] AS acceptance_decision, [0.2, 0.25, 0.15, 0.55, 1.0, 0.5, 0.5, 0.65, 0.75, 0.45, 0.7, 0.5, 0.55, 0.45][s]::double AS commercial_multiplier, [0.25, 0.3, 0.2, 0.6, NULL, 0.5, 0.55, 0.65, 0.7, 0.45, 0.65, 0.45, 0.5, 0.4][s]::double AS score_cap FROM d)
SELECT l_orderkey, l_partkey, l_suppkey, quality_status, rejection_reason, quality_flag, technical_multiplier, acceptance_decision, commercial_multiplier, score_cap, CASE WHEN quality_status = 'rejected' THEN 'quality_rejected' WHEN starts_with(acceptance_decision, 'rejected_') THEN 'commercial_rejected' WHEN acceptance_decision = 'accepted_related' THEN 'commercial_related_only' WHEN conf = 'high' AND quality_status = 'accepted' AND sc >= 0.7 THEN 'heuristic_high_confidence' WHEN conf = 'high' AND sc <= 0.2 THEN 'low_value_heuristic' ELSE 'ai_required' END AS ai_gate FROM a"""


QUALITY_GATE = _gate_sql()


def technology_detect(spark, sf_dir):
    html = "concat(html, CASE pmod(page_id, 6) WHEN 0 THEN '<link href=wp-content>' WHEN 1 THEN 'cdn.SHOPIFY x _next/static' WHEN 2 THEN 'gtag( fbq(' WHEN 3 THEN 'js.stripe.com hubspot' ELSE '' END)"
    pages = _t(spark, sf_dir, "pages").select("page_id", F.expr(html).alias("html"))
    return pages.select("page_id", F.array_join(F.expr(features.technologies("html")), ",").alias("stack"), F.expr(features.hiring("html", "cast(array() AS array<string>)")).alias("hiring"))


TECHNOLOGIES = "WITH p AS (SELECT page_id, lower(html || CASE page_id % 6 WHEN 0 THEN '<link href=wp-content>' WHEN 1 THEN 'cdn.SHOPIFY x _next/static' WHEN 2 THEN 'gtag( fbq(' WHEN 3 THEN 'js.stripe.com hubspot' ELSE '' END) AS h FROM pages) SELECT page_id, concat_ws(',', " + ", ".join(f"CASE WHEN {_any('h', s)} THEN {_lit(n)} END" for n, s in feature_rules.TECHNOLOGIES.items()) + ") AS stack, " + _any("h", features.HIRING_PHRASES) + " AS hiring FROM p"


def heuristic_score(spark, sf_dir):
    rows = pipeline.with_criteria(pipeline.metadata(_t(spark, sf_dir, "pages")), {"target_niche": "the thing", "target_language": "en", "target_budget_signals": ["tion"], "user_technologies": ["React"]})
    df = features.heuristics(rows)
    return df.select("page_id", "score", "confidence_level", "business_identity", "contact_availability", "commercial_intent", "digital_maturity", "context_fit", "stack_fit", "estimated_revenue_signal", "fit_summary")


def prospect_pipeline(spark, sf_dir):
    df = pipeline.prospects(_t(spark, sf_dir, "pages"), {"target_niche": "the thing", "target_language": "en"})
    return df.select("page_id", "canonical_identity", "entity_type_detected", "quality_status", "acceptance_decision", "final_score", "taxonomy_business_type", "detected_language")


def fetch_policy(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").selectExpr(
        "event_id", "CASE event_type WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 429 ELSE 503 END WHEN 'click' THEN 403 WHEN 'view' THEN 404 WHEN 'signup' THEN NULL ELSE 200 END AS status", "CASE event_id % 4 WHEN 0 THEN 'timeout' WHEN 1 THEN 'tls' WHEN 2 THEN 'dns' ELSE 'other' END AS cause",
        "CASE event_id % 3 WHEN 0 THEN '7' WHEN 1 THEN 'Wed, 21 Oct 2015 07:28:00 GMT' ELSE '-1' END AS retry_after", "cast(event_id % 3 + 1 AS int) AS attempt")
    return providers.next_attempt(rows).select("event_id", "error_type", "retryable", "will_retry", "delay_seconds")


FETCH_POLICY = """WITH r AS (SELECT event_id, CASE event_type WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 429 ELSE 503 END WHEN 'click' THEN 403 WHEN 'view' THEN 404 WHEN 'signup' THEN NULL ELSE 200 END AS st, event_id % 4 AS c, event_id % 3 AS h FROM events),
e AS (SELECT *, CASE WHEN st = 403 THEN 'http_403' WHEN st = 429 THEN 'http_429' WHEN st = 503 THEN 'http_5xx' WHEN st = 404 THEN 'http_4xx' WHEN st IS NULL THEN CASE c WHEN 0 THEN 'timeout' WHEN 1 THEN 'tls_error' WHEN 2 THEN 'dns_error' ELSE 'network_error' END END AS error_type FROM r), k AS (SELECT *, coalesce(error_type IN ('http_429', 'http_5xx', 'timeout', 'network_error'), false) AS retryable FROM e)
SELECT event_id, error_type, retryable, retryable AND h + 1 < 3 AS will_retry, CASE WHEN retryable AND h + 1 < 3 THEN CASE WHEN error_type = 'http_429' AND h = 0 THEN 7.0::double ELSE power(2, h)::double END END AS delay_seconds FROM k"""

QUERIES = {
    "site_summary": (site_summary, SITE_SUMMARY), "email_extract": (email_extract, EMAIL_EXTRACT), "phone_classify": (phone_classify, PHONE_CLASSIFY), "phone_rejection_counts": (phone_rejection_counts, PHONE_COUNTS), "language_detect": (language_detect, LANGUAGE_DETECT),
    "language_confusion": (language_confusion, LANGUAGE_CONFUSION), "service_keywords_top5": (service_keywords_top5, SERVICE_KEYWORDS), "ai_signature": (ai_signature, AI_SIGNATURE), "text_fold": (text_fold, TEXT_FOLD), "url_identity": (url_identity, URL_IDENTITY), "page_type_classify": (page_type_classify, PAGE_TYPES),
    "html_links": (html_links, HTML_LINKS), "links_internal_external": (links_internal_external, LINKS_IN_OUT), "key_links_top5": (key_links_top5, KEY_LINKS), "page_merge_by_host": (page_merge_by_host, PAGE_MERGE), "html_text_parse": (html_text_parse, HTML_TEXT), "page_metadata": (page_metadata, None),
    "hit_classify": (hit_classify, HIT_CLASSIFY), "hit_rank": (hit_rank, HIT_RANK), "url_dedupe_position": (url_dedupe_position, URL_DEDUPE), "brand_overlap": (brand_overlap, BRAND_OVERLAP), "entity_scores": (entity_scores, ENTITY_SCORES), "taxonomy_topscore": (taxonomy_topscore, TAXONOMY_TOPSCORE),
    "business_model_fit": (business_model_fit, MODEL_FIT), "business_model_real": (business_model_real, BUSINESS_MODEL_REAL), "hit_classify_real": (hit_classify_real, HIT_CLASSIFY_REAL), "geo_country_match": (geo_country_match, GEO_COUNTRY), "contact_quality": (contact_quality, CONTACT_QUALITY), "quality_gate": (quality_gate, QUALITY_GATE), "technology_detect": (technology_detect, TECHNOLOGIES),
    "heuristic_score": (heuristic_score, None), "prospect_pipeline": (prospect_pipeline, None), "fetch_policy": (fetch_policy, FETCH_POLICY),
}

