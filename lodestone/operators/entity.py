"""Entity classification by tallied rules, and business taxonomy. Native expressions over one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import any_in, fold_trimmed, hits, matched, quoted, strings
from ..rules import entities as rules
from ..rules import taxonomy as taxa

#: Fixed values.
MEDIA_HOSTS = ["news", "revista", "magazine", "journal", "diario", "press"]
DIRECTORY_HOSTS = ["directory", "directorio", "listing", "listings"]
AGENCY_HOSTS = ["agency", "agencia", "studio", "estudio"]
CONSULTANT_HOSTS = ["consult", "advisor", "asesor"]
LISTICLE = r"\b(top|best|mejores)\s+\d+\b"


def _fold(word: str) -> str:
    import unicodedata

    return " ".join(unicodedata.normalize("NFKD", word).encode("ascii", "ignore").decode().lower().split())


def folded(words: list[str]) -> list[str]:
    """Dictionary entries as they are compared; spellings that fold alike stay, for each counts."""
    return [f for w in words if (f := _fold(w))]


def node_types(nodes: str) -> str:
    """Distinct folded types of structured nodes."""
    raw = "get_json_object(j, '$.@type')"
    each = f"CASE WHEN startswith({raw}, '[') THEN from_json({raw}, 'array<string>') ELSE array({raw}) END"
    return f"array_distinct(filter(transform(flatten(transform({nodes}, j -> {each})), t -> {fold_trimmed('t')}), t -> t <> ''))"


def classify(pages: DataFrame, words: dict[str, list[str]] | None = None) -> DataFrame:
    """Adds entity_type_detected, entity_type_confidence, is_target_entity, target_reason, entity_scores and matched_rules.

    pages: columns of parse() with website_url, and discovery_title, discovery_snippet. words replaces keyword lists by type.
    """
    lists = {"agency": rules.AGENCY, "consultant": rules.CONSULTANT, "association": rules.ASSOCIATION, "directory": rules.DIRECTORY, "aggregator": rules.AGGREGATOR, "marketplace": rules.MARKETPLACE, "media": rules.MEDIA} | (words or {})
    points = {"agency": 3, "consultant": 3, "association": 4, "directory": 3, "aggregator": 2, "marketplace": 3, "media": 2}
    site = "coalesce(nullif(website_url, ''), url, '')"
    path = f"CASE WHEN {urls.path(site)} = '' THEN '/' ELSE {urls.path(site)} END"
    summary = "concat_ws(' ', coalesce(title, ''), coalesce(description, ''), coalesce(discovery_title, ''), coalesce(discovery_snippet, ''), array_join(slice(internal_links, 1, 8), ' '), substring(clean_text, 1, 1200))"
    link = lambda ws: f"exists(internal_links, l -> {any_in('lower(l)', ws)})"
    df = pages.withColumns({
        "path_f": F.expr(fold_trimmed(path)), "host_f": F.expr(fold_trimmed(urls.host(site))), "sum_": F.expr(fold_trimmed(summary)), "types_": F.expr(node_types("structured_data")),
        "has_contact": F.expr("size(emails) > 0 OR size(phones) > 0 OR form_detected"), "has_place": F.expr("size(addresses) > 0 OR size(map_links) > 0"),
        "l_service": F.expr(link(["service", "servicio"])), "l_about": F.expr(link(["about", "nosotros", "equipo"])), "l_contact": F.expr(link(["contact", "contacto"])),
        "l_convert": F.expr(link(["pricing", "precio", "precios", "book", "booking", "reserv", "agenda"]) + " OR booking_url IS NOT NULL OR pricing_page_url IS NOT NULL"),
        "social_": F.expr("coalesce(primary_identity_type = 'social_profile', false)"),
    })
    df = df.withColumns({
        "sum_p": F.expr("concat(' ', sum_, ' ')"),
        "business_types": F.expr(f"array_sort(array_intersect(types_, {strings(rules.BUSINESS_NODES)}))"),
        "article_types": F.expr(f"array_sort(array_intersect(types_, {strings(rules.ARTICLE_NODES)}))"), "listing_types": F.expr(f"array_sort(array_intersect(types_, {strings(rules.LISTING_NODES)}))"),
        "listicle": F.expr(f"nullif(regexp_extract(sum_, {quoted(LISTICLE)}, 0), '')"),
    })
    # points and evidence both come from the words found, so each list is looked up once
    df = df.withColumns({f"m_{kind}": F.expr(matched("sum_p", folded(ws))) for kind, ws in lists.items()})
    # (type, points, condition, evidence) in the order in which evidence is listed
    single = [
        ("direct_business", 2, "l_service", "'service_navigation_detected'"), ("direct_business", 1, "l_about", "'about_page_detected'"),
        ("direct_business", 2, "l_contact AND has_contact", "'contact_page_and_channels_detected'"), ("direct_business", 1, "l_contact <> has_contact", "'contact_identity_signal_detected'"),
        ("direct_business", 2, "has_place", "'location_identity_signal_detected'"), ("direct_business", 1, "l_convert", "'commercial_conversion_path_detected'"),
        ("direct_business", 3, "size(business_types) > 0", "concat('business_schema_detected:', get(business_types, 0))"),
        ("direct_business", 2, "social_ AND social_profile.handle <> ''", "'social_handle_detected'"), ("direct_business", 3, "social_ AND size(social_profile.offer_signals) > 0", "'social_offer_signals_detected'"),
        ("direct_business", 2, "social_ AND size(social_profile.platform_ctas) > 0", "'social_cta_detected'"),
    ]
    later = [
        ("blog_post", 5, any_in("path_f", rules.BLOG_PATHS), "concat('editorial_path:', path_f)"), ("directory", 4, any_in("path_f", rules.DIRECTORY_PATHS), "concat('directory_path:', path_f)"),
        ("aggregator", 4, any_in("path_f", rules.AGGREGATOR_PATHS), "concat('aggregator_path:', path_f)"), ("marketplace", 4, any_in("path_f", rules.MARKETPLACE_PATHS), "concat('marketplace_path:', path_f)"),
        ("media", 4, any_in("path_f", rules.MEDIA_PATHS), "concat('media_path:', path_f)"), ("media", 3, any_in("host_f", MEDIA_HOSTS), "concat('media_host:', host_f)"),
        ("directory", 3, any_in("host_f", DIRECTORY_HOSTS), "concat('directory_host:', host_f)"), ("agency", 2, any_in("host_f", AGENCY_HOSTS), "concat('agency_host:', host_f)"),
        ("consultant", 2, any_in("host_f", CONSULTANT_HOSTS), "concat('consultant_host:', host_f)"), ("blog_post", 4, "size(article_types) > 0", "concat('article_schema_detected:', get(article_types, 0))"),
        ("directory", 3, "size(listing_types) > 0", "concat('listing_schema_detected:', get(listing_types, 0))"), ("aggregator", 3, "listicle IS NOT NULL", "concat('listicle_pattern:', listicle)"),
    ]
    score, proof = {}, {}
    for kind in rules.TYPES:
        rows = [r for r in single if r[0] == kind]
        tail = [r for r in later if r[0] == kind]
        terms = [f"CASE WHEN {c} THEN {p} ELSE 0 END" for _, p, c, _ in rows + tail]
        shown = [f"array(CASE WHEN {c} THEN {e} END)" for _, _, c, e in rows]
        if kind in lists:
            terms.append(f"{points[kind]} * size(m_{kind})")
            shown.append(f"transform(m_{kind}, k -> concat('{kind}_keyword:', k))")
        shown += [f"array(CASE WHEN {c} THEN {e} END)" for _, _, c, e in tail]
        score[kind] = F.expr(" + ".join(terms) or "0")
        proof[kind] = F.expr(f"array_compact(concat({', '.join(shown)}))" if shown else "cast(array() AS array<string>)")
    df = df.withColumns({f"s_{k}": v for k, v in score.items()} | {f"e_{k}": v for k, v in proof.items()})
    ranked = [k for k in rules.TYPES if k != "unknown"]
    order = "array_sort(array(" + ", ".join(f"named_struct('s', -s_{k}, 'o', {i}, 'k', '{k}')" for i, k in enumerate(ranked)) + "))"
    df = df.withColumns({
        "order_": F.expr(order), "identity_": F.expr("s_direct_business + greatest(s_agency, s_consultant)"),
        "against_": F.expr("greatest(" + ", ".join(f"s_{k}" for k in rules.NON_TARGETS) + ")"),
    })
    df = df.withColumns({"top0": F.expr("CASE WHEN -order_[0].s > 0 THEN order_[0].k WHEN identity_ >= 3 THEN 'direct_business' ELSE 'unknown' END"), "top0_s": F.expr("CASE WHEN -order_[0].s > 0 THEN -order_[0].s WHEN identity_ >= 3 THEN identity_ ELSE 0 END"), "next_s": F.expr("-order_[1].s")})
    editorial = f"(size(article_types) > 0 OR {any_in('path_f', rules.BLOG_PATHS)}) AND top0 IN ('directory', 'aggregator', 'media') AND s_blog_post >= 4"
    df = df.withColumns({"over1": F.expr(editorial)})
    df = df.withColumns({"top1": F.expr("CASE WHEN over1 THEN 'blog_post' ELSE top0 END"), "top1_s": F.expr("CASE WHEN over1 THEN s_blog_post ELSE top0_s END")})
    refused = ", ".join(quoted(k) for k in rules.NON_TARGETS)
    df = df.withColumns({"over2": F.expr(f"top1 IN ({refused}) AND identity_ >= top1_s + 3")})
    df = df.withColumns({"top": F.expr("CASE WHEN over2 THEN 'direct_business' ELSE top1 END"), "top_s": F.expr("CASE WHEN over2 THEN s_direct_business ELSE top1_s END")})
    targets = ", ".join(quoted(k) for k in rules.TARGETS)
    evidence = "CASE top " + " ".join(f"WHEN '{k}' THEN e_{k}" for k in rules.TYPES) + " END"
    extra = "array_compact(array(CASE WHEN over1 AND top = 'blog_post' THEN 'editorial_evidence_overrides_listing_signals' END, CASE WHEN over2 THEN 'business_identity_overrides_non_target' END))"
    scores = "map_from_entries(transform(filter(order_, x -> x.s < 0), x -> struct(x.k, -x.s)))"
    return df.select(
        *pages.columns, F.col("top").alias("entity_type_detected"),
        F.expr("CASE WHEN top = 'unknown' THEN 'low' WHEN top_s >= 7 AND top_s - next_s >= 2 THEN 'high' WHEN top_s >= 4 THEN 'medium' ELSE 'low' END").alias("entity_type_confidence"),
        F.expr(f"CASE WHEN top IN ({targets}) THEN true WHEN top IN ({refused}) THEN false ELSE identity_ >= 4 AND against_ <= 2 END").alias("is_target_entity"),
        F.expr(f"CASE WHEN top IN ({targets}) THEN concat('target_entity_type:', top) WHEN top IN ({refused}) THEN concat('non_target_entity_type:', top) WHEN identity_ >= 4 AND against_ <= 2 THEN 'fallback_business_identity_target' ELSE 'fallback_unknown_entity_non_target' END").alias("target_reason"),
        F.expr(scores).alias("entity_scores"), F.expr(f"slice(concat({evidence}, {extra}), 1, 8)").alias("matched_rules"),
    )


def taxonomy_scores(text: str, types: str, entity: str, table: list = taxa.TAXONOMY) -> dict[str, str]:
    """Score expression of every type: entity type, schema types, and up to three keywords at two points each."""
    entity = f"coalesce({entity}, '')"
    agency = "CASE " + " ".join(f"WHEN {any_in(text, folded(ws))} THEN '{k}'" for k, ws in taxa.AGENCIES.items()) + " ELSE 'professional_service' END"
    out = {}
    for kind, _, _, _, words, nodes in table:
        if kind == "unknown":
            continue
        terms = [f"CASE WHEN {entity} = {quoted(e)} THEN 10 ELSE 0 END" for e, k in taxa.BY_ENTITY.items() if k == kind]
        if kind in taxa.AGENCIES or kind == "professional_service":
            terms.append(f"CASE WHEN {entity} = 'agency' AND {agency} = '{kind}' THEN 8 ELSE 0 END")
        if kind == "local_business":
            terms.append(f"CASE WHEN {entity} = 'direct_business' THEN 3 ELSE 0 END")
        if nodes:
            terms.append(f"CASE WHEN arrays_overlap({types}, {strings(nodes)}) THEN 7 ELSE 0 END")
        if words:
            terms.append(f"2 * least(3, {hits(text, folded(words))})")
        out[kind] = " + ".join(terms) or "0"
    return out


def taxonomy(pages: DataFrame, entity: str = "entity_type_detected", niche: str = "inferred_niche", table: list = taxa.TAXONOMY) -> DataFrame:
    """Adds taxonomy_top_level, taxonomy_business_type, display_category, taxonomy_niche and taxonomy_score."""
    text = f"concat_ws(' ', coalesce({niche}, ''), '', coalesce(title, ''), coalesce(description, ''), array_join(slice(internal_links, 1, 8), ' '), substring(clean_text, 1, 2400))"
    df = pages.withColumns({"tax_text": F.expr(fold_trimmed(text)), "tax_types": F.expr(node_types("structured_data"))})
    scores = taxonomy_scores("tax_text", "tax_types", entity, table)
    best = "array_min(array(" + ", ".join(f"named_struct('s', -({e}), 'o', {i}, 'k', '{k}')" for i, (k, e) in enumerate(scores.items())) + "))"
    df = df.withColumn("tax_best", F.expr(best)).withColumn("taxonomy_business_type", F.expr("CASE WHEN -tax_best.s < 3 THEN 'unknown' ELSE tax_best.k END"))
    pick = lambda column: "CASE taxonomy_business_type " + " ".join(f"WHEN '{row[0]}' THEN {quoted(row[column])}" for row in table) + " END"
    return df.withColumns({
        "taxonomy_top_level": F.expr(pick(1)), "display_category": F.expr(pick(3)), "taxonomy_score": F.expr("-tax_best.s"),
        "taxonomy_niche": F.expr(f"CASE WHEN taxonomy_business_type <> 'unknown' THEN {pick(2)} ELSE coalesce(nullif(trim({niche}), ''), 'Desconocido') END"),
    }).drop("tax_text", "tax_types", "tax_best")
