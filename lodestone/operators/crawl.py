"""Crawl merge and identity: key pages of a site, merged metadata with an early stop, canonical identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import any_in

MOST_KEY_PAGES = 5
PAGE_TEXT = 1200
LISTS = ["emails", "phones", "social_links", "social_profiles", "internal_links", "external_links", "map_links", "addresses", "opening_hours", "cta_candidates", "structured_data", "structured_data_evidence", "contact_channels", "area_served"]
TEXTS = ["title", "description", "html_lang", "meta_locale", "whatsapp_url", "booking_url", "pricing_page_url", "service_page_url", "primary_cta", "primary_identity_type", "primary_identity_url"]


def key_links(links: DataFrame, root: str = "root", url: str = "url", most: int = MOST_KEY_PAGES) -> DataFrame:
    """Distinct internal links of each root by kind, then URL; the first most of them with their rank."""
    kind = urls.page_kind(url, urls.CRAWL_KINDS)
    rated = links.select(root, url).distinct().withColumn("page_type", F.expr(kind)).withColumn("priority_", F.expr(urls.crawl_priority("page_type")))
    rated = rated.withColumn("crawl_rank", F.row_number().over(Window.partitionBy(root).orderBy("priority_", url)))
    return rated.where(F.col("crawl_rank") <= most).drop("priority_")


def enough(prefix: str = "") -> str:
    """Whether gathered metadata has contact, address and a call to action."""
    c = lambda x: prefix + x
    return f"(size({c('emails')}) > 0 OR size({c('phones')}) > 0 OR {c('form_detected')}) AND size({c('addresses')}) > 0 AND coalesce({c('primary_cta')}, {c('booking_url')}, {c('pricing_page_url')}) IS NOT NULL"


def merge(parts: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Metadata rows of one key merged in order: lists joined without repeats, counts added, flags or-ed, first value kept.

    parts: key, ordinal and the columns of parse(). The rows of a key are gathered into one, so a key should have few of them, as
    the key pages of a site are.
    """
    held = F.expr(f"array_sort(collect_list(struct({ordinal} AS o_, " + ", ".join([*LISTS, *TEXTS, "form_detected", "url", "invalid_phone_candidates_count", "phone_validation_rejections", "social_profile", "clean_text", "page_type"]) + ")))")
    # maps can't be sorted, so they travel as entries
    parts = parts.withColumn("phone_validation_rejections", F.expr("map_entries(phone_validation_rejections)"))
    df = parts.groupBy(key).agg(held.alias("p"))
    counts = "flatten(transform(p, x -> coalesce(x.phone_validation_rejections, array())))"
    return df.select(
        key,
        *(F.expr(f"array_distinct(flatten(transform(p, x -> coalesce(x.{c}, array()))))").alias(c) for c in LISTS),
        *(F.expr(f"get(filter(transform(p, x -> x.{c}), v -> v <> ''), 0)").alias(c) for c in TEXTS),
        F.expr("exists(p, x -> x.form_detected)").alias("form_detected"),
        F.expr("aggregate(p, 0, (a, x) -> a + coalesce(x.invalid_phone_candidates_count, 0))").alias("invalid_phone_candidates_count"),
        F.expr(f"map_from_entries(transform(array_distinct(transform({counts}, e -> e.key)), k -> struct(k, aggregate(filter({counts}, e -> e.key = k), 0, (a, e) -> a + e.value))))").alias("phone_validation_rejections"),
        F.expr("try_element_at(filter(transform(p, x -> x.social_profile), v -> v IS NOT NULL), -1)").alias("social_profile"),
        F.expr("array_join(transform(filter(p, x -> x.clean_text <> ''), x -> concat('[', upper(coalesce(x.page_type, 'other')), '] ', substring(x.clean_text, 1, " + str(PAGE_TEXT) + "))), '\\n\\n')").alias("crawl_text"),
        F.expr("size(p)").alias("pages_crawled"),
        F.expr("transform(p, x -> named_struct('url', x.url, 'page_type', x.page_type))").alias("crawled_pages"),
    )


def stop_when_enough(parts: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Rows up to and with the first at which the rows so far have enough signals: a prefix by running sums of flags."""
    w = Window.partitionBy(key).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda e: F.coalesce(F.max(F.expr(f"cast({e} AS int)")).over(w), F.lit(0))
    contact = so_far("size(emails) > 0 OR size(phones) > 0 OR form_detected")
    place, call = so_far("size(addresses) > 0"), so_far("coalesce(primary_cta, booking_url, pricing_page_url) IS NOT NULL")
    return parts.withColumn("enough_", contact * place * call).where("enough_ = 0").drop("enough_")


def crawl(roots: DataFrame, pages: DataFrame, key: str = "url") -> DataFrame:
    """Merged metadata of the key pages of every root page: self-join of internal links with the pages at hand.

    Of pages with one URL the least page_id counts. Only narrow rows meet by URL; metadata joins by the row's own key.
    """
    own = "row_key" if "row_key" in pages.columns else "page_id"
    links = key_links(roots.select(F.col(key).alias("root"), F.explode("internal_links").alias("url")))
    at_hand = pages.groupBy("url").agg(F.min(F.struct(F.col("page_id").isNull().alias("n"), "page_id", F.col(own).alias("k"))).alias("m")).select("url", F.col("m.k").alias("own_"))
    texts = pages.drop("url").withColumn("clean_text", F.substring("clean_text", 1, PAGE_TEXT)).withColumnRenamed(own, "own_")
    if own == "row_key":
        texts = texts.drop("page_id")
    # rows that repeat altogether give the same metadata; a link takes one of them
    found = links.join(at_hand, "url").join(texts, "own_").dropDuplicates(["root", "crawl_rank"])
    return merge(stop_when_enough(found, "root", "crawl_rank"), "root", "crawl_rank")


def with_key_pages(roots: DataFrame, pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Root pages merged with their key pages, root first; adds crawled_pages. Social profiles stay as they are."""
    found = crawl(roots.where("primary_identity_type <> 'social_profile'"), pages, key)
    df = roots.join(found.select(F.col("root").alias(key), F.struct(*found.drop("root").columns).alias("k_")), key, "left")
    merged = {c: f"array_distinct(concat(coalesce({c}, array()), coalesce(k_.{c}, array())))" for c in LISTS}
    merged |= {c: f"coalesce(nullif({c}, ''), k_.{c}, {c})" for c in TEXTS}
    merged |= {
        "form_detected": "form_detected OR k_.form_detected",
        "invalid_phone_candidates_count": "invalid_phone_candidates_count + k_.invalid_phone_candidates_count",
        "phone_validation_rejections": "map_zip_with(phone_validation_rejections, k_.phone_validation_rejections, (k, a, b) -> coalesce(a, 0) + coalesce(b, 0))",
        "social_profile": "coalesce(k_.social_profile, social_profile)",
        "social_links_count": "size(array_distinct(concat(social_links, k_.social_links)))",
        "clean_text": "CASE WHEN k_.crawl_text <> '' THEN concat(clean_text, '\\n\\n', k_.crawl_text) ELSE clean_text END",
    }
    crawled = F.expr("coalesce(k_.crawled_pages, cast(array() AS array<struct<url:string,page_type:string>>))")
    return df.withColumns({c: F.expr(f"CASE WHEN k_ IS NULL THEN {c} ELSE {e} END") for c, e in merged.items()} | {"crawled_pages": crawled}).drop("k_")


def identity(page: DataFrame) -> DataFrame:
    """Adds canonical_identity, domain, website_url and contact_page_url to pages with metadata."""
    social = "primary_identity_type = 'social_profile'"
    handle = "CASE WHEN social_profile.platform <> '' AND social_profile.handle <> '' THEN lower(concat(social_profile.platform, ':', social_profile.handle)) ELSE lower(primary_identity_url) END"
    website = f"CASE WHEN {social} THEN get(filter(social_profile.external_links, l -> startswith(l, 'http')), 0) ELSE url END"
    pick = lambda words: f"get(filter(internal_links, l -> {any_in('lower(l)', words)}), 0)"
    return page.withColumns({
        "canonical_identity": F.expr(f"CASE WHEN {social} THEN {handle} ELSE {urls.domain('primary_identity_url')} END"),
        "website_url": F.expr(website),
        "domain": F.expr(urls.domain(f"coalesce({website}, url)")),
        "contact_page_url": F.expr(f"coalesce({pick(['contact', 'contacto'])}, {pick(['about', 'nosotros', 'equipo'])})"),
    })
