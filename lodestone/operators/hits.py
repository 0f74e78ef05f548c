"""Search hits: classification, ranking, dedupe, directory seeds (all native expressions, one projection)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.plan import barrier
from ..functions.text import any_in, collapse, even, first_in, quoted, starts_any, strings
from ..rules import hits as rules

#: Fixed values of the website score: reason, weight, words in title and snippet.
POSITIVE = [
    ("official_site_hint", 0.35, ["oficial", "official", "sitio oficial"]),
    ("contact_or_services_hint", 0.18, ["contacto", "contact", "servicios", "services", "nosotros", "about"]),
    ("conversion_cta_hint", 0.18, ["reserva", "booking", "agenda", "cotiza", "quote"]),
    ("business_category_hint", 0.12, ["clinica", "clínica", "estudio", "agencia", "tienda", "retail", "consultora"]),
    ("commercial_hint", 0.14, rules.COMMERCIAL),
]
NEGATIVE = [
    ("product_page", -0.35, [*rules.PRODUCT_PATHS, *rules.PRODUCT_WORDS]),
    ("institutional_page", -0.25, rules.INSTITUTIONS),
    ("marketplace_or_listing", -0.25, ["marketplace", "listing", "directory", "directorio"]),
]
BRAND_STOPWORDS = ["http", "https", "www", "site", "oficial", "official", "contacto", "contact"]
NO_HANDLE = ["p", "reel", "reels", "explore", "stories"]


def brand_tokens(value: str) -> str:
    """Distinct words of at least four letters or digits."""
    words = f"split(trim(regexp_replace(lower({value}), '[^\\\\p{{L}}\\\\p{{N}}]+', ' ')), ' ')"
    return f"array_except(filter({words}, t -> length(t) >= 4), {strings(BRAND_STOPWORDS)})"


def domain_brand(url: str) -> str:
    return brand_tokens(f"substring_index(substring_index({urls.host(url)}, ':', 1), '.', 1)")


def classify(hits: DataFrame, allow_social: bool = False, blocked: list[str] = rules.BLOCKED, editorial_titles: list[str] = rules.EDITORIAL_TITLES, positive: list = POSITIVE) -> DataFrame:
    """Adds result_kind, website_result_score, social_profile_score, score, reasons and exclusion_reason to hits(url, title, snippet)."""
    path = urls.path("url_l")
    df = hits.withColumns({"title_": F.expr(collapse("title")), "snippet_": F.expr(collapse("snippet")), "url_l": F.expr("lower(coalesce(url, ''))")})
    df = df.withColumns({"blob": F.expr("lower(concat(title_, ' ', snippet_))"), "path_l": F.expr(path), "host_l": F.expr(urls.netloc("url_l")), "words": F.expr("CASE WHEN title_ = '' THEN 0 ELSE size(split(title_, ' ')) END")})
    handle = "get(segs, 0)"
    instagram = f"contains(host_l, 'instagram.com') AND size(segs) = 1 AND NOT {starts_any(handle, NO_HANDLE)}"
    tiktok = f"NOT contains(host_l, 'instagram.com') AND contains(host_l, 'tiktok.com') AND size(segs) = 1 AND startswith({handle}, '@')"
    df = barrier(df.withColumn("segs", F.expr("filter(split(path_l, '/'), s -> s <> '')")))
    df = df.withColumns({
        "blocked_by": F.expr(first_in("url_l", blocked, "blocked_domain:")),
        "is_reference": F.expr(f"{any_in('host_l', rules.REFERENCE_HOSTS)} OR {any_in('blob', rules.REFERENCE_WORDS)}"),
        "editorial_path": F.expr(any_in("path_l", rules.EDITORIAL_PATHS)),
        "editorial_title": F.expr(any_in("blob", editorial_titles)),
        "is_media": F.expr(f"{any_in('host_l', [*rules.NEWS_HOSTS, *rules.FINANCE_HOSTS])} OR {any_in('blob', rules.ENTERPRISE_WORDS)}"),
        "is_enterprise": F.expr(f"{any_in('host_l', rules.ENTERPRISE_HOSTS)} OR {any_in('blob', rules.ENTERPRISE_WORDS)}"),
        "is_social": F.expr(any_in("url_l", rules.SOCIAL_HOSTS)),
        "is_post": F.expr(any_in("url_l", [*rules.POST_PATHS, *rules.SHARE_MARKS])),
        "is_profile": F.expr(f"coalesce(({instagram}) OR ({tiktok}), false)"),
        "platform": F.expr("CASE WHEN contains(host_l, 'instagram.com') THEN 'instagram' ELSE 'tiktok' END"),
        "has_handle": F.expr(f"coalesce(ltrim('@', {handle}) <> '', false)"),
        "is_seed": F.expr(any_in("url_l", rules.SEED_HOSTS)),
        "is_root": F.expr("path_l IN ('', '/')"),
        "brand": F.expr(f"arrays_overlap({brand_tokens('title_')}, {domain_brand('url_l')})"),
    })

    rated: list[tuple[str, str, str]] = [(reason, f"{w}D", any_in("blob", words)) for reason, w, words in positive]
    rated += [(reason, f"{w}D", f"({any_in('blob', words)} OR {any_in('path_l', words)})") for reason, w, words in NEGATIVE]
    rated += [
        ("shallow_url", "0.12D", "size(segs) <= 1"), ("moderate_depth", "0.04D", "size(segs) = 2"), ("deep_url", "-0.18D", "size(segs) > 2"),
        ("document_like_path", "-0.05D", "(endswith(path_l, '.html') OR endswith(path_l, '.php'))"), ("concise_title", "0.08D", "words BETWEEN 1 AND 10"),
        ("brand_domain_match", "0.22D", "brand"), ("root_domain_url", "0.08D", "is_root"), ("directory_seed_candidate", "-0.2D", "is_seed"),
    ]
    social = [
        ("'social_profile_candidate'", "0.35D", "true"), ("concat('platform:', platform)", "0D", "true"), ("'canonical_handle_detected'", "0.2D", "has_handle"),
        ("'social_commercial_cta_hint'", "0.2D", any_in("blob", rules.PROFILE_HINTS)), ("'social_commercial_niche_hint'", "0.15D", any_in("blob", rules.COMMERCIAL)),
        ("'concise_title'", "0.05D", "words BETWEEN 1 AND 12"),
    ]
    total = lambda rows: " + ".join(f"CASE WHEN {c} THEN {w} ELSE 0D END" for _, w, c in rows)
    listed = lambda rows: "array_compact(array(" + ", ".join(f"CASE WHEN {c} THEN {r} END" for r, _, c in rows) + "))"
    df = df.withColumns({
        "web": F.expr(total(rated)), "web_reasons": F.expr(listed([(quoted(r), w, c) for r, w, c in rated])),
        "soc": F.expr(even(f"least({total(social)}, 1D)", 4)), "soc_reasons": F.expr(listed(social)),
    })

    allowed = "true" if allow_social else "false"
    stage = F.expr(
        "CASE WHEN blocked_by IS NOT NULL THEN 'blocked' WHEN is_reference THEN 'reference' WHEN editorial_path OR editorial_title THEN 'article'"
        " WHEN is_media THEN 'media' WHEN is_enterprise THEN 'enterprise'"
        f" WHEN is_social AND NOT {allowed} THEN 'social_off' WHEN is_social AND is_post THEN 'post' WHEN is_social AND NOT is_profile THEN 'not_profile'"
        " WHEN is_social THEN 'profile' ELSE 'website' END"
    )
    df = barrier(df.withColumn("stage", stage))
    home = "CASE WHEN is_root THEN 'website_home' ELSE 'website_inner_page' END"
    return df.select(
        *hits.columns,
        F.expr(
            f"CASE stage WHEN 'blocked' THEN {home} WHEN 'reference' THEN 'article_or_reference' WHEN 'article' THEN 'article_or_reference' WHEN 'media' THEN 'media_or_news'"
            f" WHEN 'enterprise' THEN 'large_enterprise_noise' WHEN 'social_off' THEN 'social_profile' WHEN 'profile' THEN 'social_profile' WHEN 'website' THEN {home} ELSE 'social_post' END"
        ).alias("result_kind"),
        F.expr(f"CASE stage WHEN 'blocked' THEN -0.5D WHEN 'website' THEN {even('web', 4)} ELSE 0D END").alias("website_result_score"),
        F.expr("CASE stage WHEN 'profile' THEN soc ELSE 0D END").alias("social_profile_score"),
        F.expr(f"CASE stage WHEN 'blocked' THEN -0.5D WHEN 'website' THEN {even('web', 4)} WHEN 'profile' THEN soc ELSE 0D END").alias("score"),
        F.expr(
            "CASE stage WHEN 'blocked' THEN array(blocked_by) WHEN 'reference' THEN array('reference_or_article') WHEN 'article' THEN array(CASE WHEN editorial_path THEN 'editorial_path' ELSE 'editorial_title' END)"
            " WHEN 'media' THEN array('media_or_finance') WHEN 'enterprise' THEN array('large_enterprise_noise') WHEN 'social_off' THEN array('social_profiles_not_allowed')"
            " WHEN 'post' THEN array('social_post_or_share') WHEN 'not_profile' THEN array('non_canonical_social_profile') WHEN 'profile' THEN soc_reasons ELSE web_reasons END"
        ).alias("reasons"),
        F.expr(
            "CASE stage WHEN 'blocked' THEN blocked_by WHEN 'reference' THEN 'excluded_reference_page' WHEN 'article' THEN 'excluded_as_article' WHEN 'media' THEN 'excluded_reference_page'"
            " WHEN 'enterprise' THEN 'excluded_large_enterprise' WHEN 'social_off' THEN 'blocked_domain:social_profile' WHEN 'post' THEN 'excluded_social_post' WHEN 'not_profile' THEN 'excluded_social_post'"
            " WHEN 'website' THEN CASE WHEN array_contains(web_reasons, 'product_page') THEN 'excluded_as_product_page' WHEN web < 0.15D THEN 'low_business_likeness' END END"
        ).alias("exclusion_reason"),
    )


def process(hits: DataFrame, allow_social: bool = False, **options) -> DataFrame:
    """Classified hits with invalid URLs excluded first and the confidence of the discovery."""
    df = classify(hits.withColumn("url", F.trim("url")), allow_social, **options)
    valid = "startswith(url, 'http')"
    blob = f"lower(concat({collapse('title')}, ' ', {collapse('snippet')}))"
    confidence = f"CASE WHEN contains({blob}, 'oficial') OR contains({blob}, 'official') OR result_kind = 'social_profile' OR score >= 0.45D THEN 'high' WHEN score <= 0.2D THEN 'low' ELSE 'medium' END"
    df = df.withColumn("exclusion_reason", F.expr(f"CASE WHEN coalesce({valid}, false) THEN exclusion_reason ELSE 'invalid_url' END"))
    return barrier(df.withColumn("discovery_confidence", F.expr(f"CASE WHEN exclusion_reason IS NULL THEN {confidence} END")))


def rank(hits: DataFrame, partition: list[str], ordinal: str) -> DataFrame:
    """Kept hits with rank: score down, high confidence first, shorter URLs, then arrival."""
    w = Window.partitionBy(*partition).orderBy(F.desc("score"), F.expr("discovery_confidence <> 'high'"), F.length("url"), ordinal)
    return hits.where("exclusion_reason IS NULL").withColumn("rank", F.row_number().over(w))


def dedupe(hits: DataFrame, key: str, order: list[str], partition: list[str] = (), limit: int | None = None) -> DataFrame:
    """First row of each key stays and gets a running position; later ones carry exclusion_reason duplicate_url.

    With a limit, positions beyond it are dropped, as a provider stops at its target.
    """
    first = Window.partitionBy(*partition, key).orderBy(*order)
    seen = hits.withColumn("copy_", F.row_number().over(first))
    place = Window.partitionBy(*partition, F.expr("copy_ = 1")).orderBy(*order)
    out = seen.withColumn("position", F.expr("CASE WHEN copy_ = 1 THEN 1 END") * F.row_number().over(place)).withColumn("exclusion_reason", F.expr("CASE WHEN copy_ > 1 THEN 'duplicate_url' END")).drop("copy_")
    return out if limit is None else out.where(F.col("position").isNull() | (F.col("position") <= limit))


def official_site(anchors: DataFrame) -> DataFrame:
    """Best official site of each directory page out of its anchors(seed_url, ordinal, url, label).

    Outside links score by label, root path, kind and depth; the first of the best wins if it reaches 0.45.
    """
    labels = any_in("lower(label)", rules.OFFICIAL_LABELS)
    listed = any_in("lower(url)", [*rules.SOCIAL_HOSTS, *rules.BLOCKED])
    same = f"coalesce({urls.root_domain('url')} = {urls.root_domain('seed_url')}, false)"
    root = f"{urls.path('url')} IN ('', '/')"
    score = f"CASE WHEN {labels} THEN 0.45D ELSE 0D END + CASE WHEN {root} THEN 0.2D ELSE 0D END + 0.15D + 0.15D + CASE WHEN size(split({urls.path('url')}, '/')) <= 2 THEN 0.05D ELSE 0D END"
    rated = anchors.where(f"startswith(url, 'http') AND NOT {same} AND NOT {listed}").withColumn("score", F.expr(even(score, 4)))
    best = rated.withColumn("n_", F.row_number().over(Window.partitionBy("seed_url").orderBy(F.desc("score"), "ordinal"))).where("n_ = 1 AND score >= 0.45D")
    reasons = f"array_compact(array('directory_seed_resolved', CASE WHEN {labels} THEN 'official_link_label' END, CASE WHEN {root} THEN 'root_domain_candidate' END))"
    return best.select("seed_url", "url", "score", F.expr(reasons).alias("reasons"))


def expand_seeds(hits: DataFrame, anchors: DataFrame, allow_social: bool = False) -> tuple[DataFrame, DataFrame]:
    """Kept hits on directories give way to the official site found on their page, classified anew; each is also an exclusion.

    hits: url, title, snippet, score, reasons, discovery_confidence and any others. Returns (hits, exclusions).
    """
    marked = hits.withColumn("seed_source_type", F.expr(first_in("lower(url)", rules.SEED_HOSTS)))
    seeds = marked.where("seed_source_type IS NOT NULL")
    best = official_site(anchors).selectExpr("seed_url", "url AS found", "reasons AS found_reasons")
    others = [c for c in hits.columns if c not in ("url", "title", "snippet", "score", "reasons", "discovery_confidence")]
    resolved = seeds.join(best, seeds["url"] == best["seed_url"]).selectExpr(*others, "found AS url", "title", "snippet", "url AS seed_source_url", "reasons AS old_reasons", "discovery_confidence AS old_confidence", "found_reasons")
    fresh = [c for c in ("result_kind", "website_result_score", "social_profile_score", "exclusion_reason") if c in others]
    resolved = classify(resolved.drop(*fresh), allow_social).where("exclusion_reason IS NULL")
    resolved = resolved.selectExpr(
        *others, "url", "title", "snippet", "bround(score + 0.15D, 4) AS score", "concat(old_reasons, reasons, found_reasons, array('official_site_from_directory_seed')) AS reasons",
        "CASE WHEN score >= 0.3D THEN 'high' ELSE old_confidence END AS discovery_confidence", "seed_source_url", "'directory_seed' AS seed_source_type",
    )
    plain = marked.where("seed_source_type IS NULL").selectExpr(*others, "url", "title", "snippet", "score", "reasons", "discovery_confidence", "cast(NULL AS string) AS seed_source_url", "seed_source_type")
    gone = seeds.selectExpr("url", "concat('excluded_as_directory_seed:', seed_source_type) AS reason", "title", "snippet")
    return plain.unionByName(resolved), gone


#: What a result keeps of its discovery.
METADATA = ["source_query", "serp_position", "title", "snippet", "discovery_confidence", "business_likeness_score", "website_result_score", "social_profile_score", "result_kind", "discovery_reasons", "seed_source_url", "seed_source_type"]


def discovery_metadata(hits: DataFrame, queries: str = "queries") -> DataFrame:
    """Adds discovery, a struct of a hit's discovery with all queries of its job; fields without a column are null."""
    names = {"source_query": "query", "serp_position": "position", "business_likeness_score": "score", "discovery_reasons": "reasons"}
    have = [(f, names.get(f, f)) for f in METADATA]
    parts = [f"'{f}', {c if c in hits.columns else 'NULL'}" for f, c in have] + [f"'queries', {queries if queries in hits.columns else 'cast(array() AS array<string>)'}"]
    return hits.withColumn("discovery", F.expr(f"named_struct({', '.join(parts)})"))
