"""Queries that run the rule operators with their real dictionaries, on documents and stand-in metadata that make every branch fire.

The SQL twins state points, orders and thresholds anew, so that a slip in an operator doesn't pass on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import entity, extraction, features, quality
from ..rules import entities as entity_rules
from ..rules import features as feature_rules
from ..rules import quality as quality_rules
from ..rules import taxonomy as taxonomy_rules
from ..rules.countries import COUNTRIES
from .page_queries import COLLAPSE, FOLD, _any, _count, _lit, _occ, _t

STRINGS = "cast(array() AS array<string>)"


def _when(k: int, *cases: str, other: str = "''") -> str:
    """CASE doc_id modulo k: cases for 0, 1, 2 and so on."""
    return f"CASE pmod(doc_id, {k}) " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(cases)) + f" ELSE {other} END"


def _list(*items: str) -> str:
    return "array(" + ", ".join(f"'{i}'" for i in items) + ")" if items else STRINGS


SOCIAL = "CASE WHEN pmod(doc_id, 4) = 3 THEN named_struct('platform', 'instagram', 'handle', CASE WHEN pmod(doc_id, 8) = 3 THEN 'acme' END, 'display_name', CASE WHEN pmod(doc_id, 3) = 0 THEN 'Acme' ELSE '' END, 'bio', 'Coach', 'external_links', CASE WHEN pmod(doc_id, 8) = 7 THEN array('https://acme.com') ELSE cast(array() AS array<string>) END, 'platform_ctas', cast(array() AS array<string>), 'offer_signals', CASE WHEN pmod(doc_id, 16) = 3 THEN array('offer') ELSE cast(array() AS array<string>) END, 'activity_signals', CASE WHEN pmod(doc_id, 12) = 11 THEN array('reels') ELSE cast(array() AS array<string>) END, 'audience_signals', cast(array() AS array<string>)) END"


def stand_in_pages(spark, sf_dir) -> DataFrame:
    """Documents with metadata made up from their ids."""
    docs = _t(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    return docs.select(
        "doc_id", F.expr("coalesce(text, '')").alias("clean_text"), F.expr(_when(3, "'Estudio | Web'", "''", other="'Shop (x)'")).alias("title"), F.expr(_when(4, "''", other="'Servicios de marketing'")).alias("description"),
        F.expr(_when(2, _list("a@b.es"), other=STRINGS)).alias("emails"), F.expr(_when(5, _list("+34911223344"), other=STRINGS)).alias("phones"), F.expr("pmod(doc_id, 7) = 0").alias("form_detected"),
        F.expr(_when(6, _list("https://x.es/contacto", "https://x.es/servicios"), _list("https://x.es/about"), _list("https://x.es/pricing", "https://x.es/careers", "https://x.es/contact"), other=STRINGS)).alias("internal_links"),
        F.expr(_when(3, _list("https://instagram.com/x"), other=STRINGS)).alias("social_links"), F.expr(_when(8, _list("https://linktr.ee/x"), other=STRINGS)).alias("external_links"),
        F.expr(_when(9, _list("https://maps.app.goo.gl/1"), other=STRINGS)).alias("map_links"), F.expr(_when(4, STRINGS, _list("Calle 1"), other=STRINGS)).alias("addresses"),
        F.expr("CASE WHEN pmod(doc_id, 11) = 0 THEN 'https://x.es/b' END").alias("booking_url"), F.expr("CASE WHEN pmod(doc_id, 13) = 0 THEN 'https://x.es/p' END").alias("pricing_page_url"), F.expr("CASE WHEN pmod(doc_id, 10) = 0 THEN 'w' END").alias("whatsapp_url"),
        F.expr(_when(5, STRINGS, _list('{"@type": "Dentist"}'), _list('{"@type": ["Article", "Thing"]}'), _list('{"@type": "ItemList"}', '{"email": "x"}'), other=STRINGS)).alias("structured_data"),
        F.expr("CASE WHEN pmod(doc_id, 4) = 3 THEN 'social_profile' ELSE 'website' END").alias("primary_identity_type"), F.expr(SOCIAL).alias("social_profile"),
        F.expr(_when(7, _list("WordPress", "Meta Pixel"), _list("React"), _list("Shopify", "Stripe", "HubSpot"), other=STRINGS)).alias("html_stack"),
        F.expr(_when(3, "' The and '", "'Der die'", other="''")).alias("target_niche"), F.expr(_when(5, "'LA'", other="''")).alias("target_location"), F.expr(_when(2, "'EN '", other="'es'")).alias("target_language"),
        F.expr(_list("instagram activo", "Linktree", "tion")).alias("target_budget_signals"), F.expr(_when(2, _list("Reservas online", "que"), other=STRINGS)).alias("target_pain_points"), F.expr(_list("react", " Shopify ")).alias("user_technologies"),
    )


# ---- heuristic components ----


def heuristic_components(spark, sf_dir):
    df = features.heuristics(stand_in_pages(spark, sf_dir))
    joined = lambda c: F.array_join(c, "|").alias(c)
    lists = ["content_themes", "platform_ctas", "offer_signals", "audience_signals", "activity_signals", "budget_matches", "observed_signals", "inferred_opportunities"]
    evidence = [f"{c}_evidence" for c in features.WEIGHTS]
    return df.select("doc_id", *features.WEIGHTS, "score", "confidence_level", "estimated_revenue_signal", "fit_summary", "inferred_niche", "detected_hint", "hiring_signals", "company_name", *map(joined, lists), *map(joined, evidence))


def _points(name: str, out_of: int, rows: list[tuple[str, int, str]]) -> list[str]:
    total = " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for _, p, c in rows)
    shown = ", ".join(f"CASE WHEN {c} THEN '{e}' END" for e, _, c in rows)
    return [f"round_even(least(({total}) / {out_of}.0::double, 1.0::double), 4) AS {name}", f"concat_ws('|', {shown}) AS {name}_evidence"]


def _heuristics_sql() -> str:
    fold = lambda x: f"' ' || {FOLD.format(x)} || ' '"
    base = f"""SELECT doc_id, coalesce(text, '') AS t, CASE doc_id % 3 WHEN 0 THEN 'Estudio | Web' WHEN 1 THEN '' ELSE 'Shop (x)' END AS title, CASE doc_id % 4 WHEN 0 THEN '' ELSE 'Servicios de marketing' END AS descr,
  doc_id % 4 = 3 AS soc, doc_id % 4 = 3 AND doc_id % 8 = 3 AS handle, doc_id % 16 = 3 AS soffer, doc_id % 4 = 3 AND doc_id % 8 = 7 AS slink, doc_id % 4 = 3 AND doc_id % 12 = 11 AS sact,
  doc_id % 2 = 0 AS em, doc_id % 5 = 0 AS ph, doc_id % 7 = 0 AS form, doc_id % 6 IN (0, 2) AS lc, doc_id % 6 = 1 AS la, doc_id % 6 = 0 AS ls, doc_id % 6 = 2 AS lp, CASE doc_id % 6 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 0 END AS links,
  doc_id % 3 = 0 AS sl, doc_id % 8 = 0 AS tree, doc_id % 9 = 0 OR doc_id % 4 = 1 AS place, doc_id % 11 = 0 OR doc_id % 13 = 0 AS conv, doc_id % 10 = 0 AS wa, doc_id % 5 = 1 AS node,
  CASE doc_id % 7 WHEN 0 THEN ['WordPress', 'Meta Pixel'] WHEN 1 THEN ['React'] WHEN 2 THEN ['Shopify', 'Stripe', 'HubSpot'] ELSE [] END AS stack,
  CASE doc_id % 3 WHEN 0 THEN 'The and' WHEN 1 THEN 'Der die' ELSE '' END AS niche, CASE doc_id % 3 WHEN 0 THEN ['the', 'and'] WHEN 1 THEN ['der', 'die'] ELSE [] END AS words FROM documents WHERE doc_id IS NOT NULL"""
    prof = "t || ' ' || title || ' ' || descr || ' ' || CASE WHEN soc THEN 'Coach' ELSE '' END"
    text = f"SELECT *, {fold('t')} AS f, {fold("t || ' ' || title || ' ' || descr")} AS s, {fold(prof)} AS p, length(trim(t)) AS n FROM b"
    themes = "concat_ws('|', " + ", ".join(f"CASE WHEN {_any('p', ws)} THEN '{k}' END" for k, ws in sorted({
        "video_content": ["reels", "shorts", "ugc", "video", "edicion"], "personal_brand": ["marca personal", "coach", "founder", "creator", "creador"], "ecommerce": ["ecommerce", "tienda online", "shop", "shopify"],
        "agency_services": ["agencia", "estudio", "marketing", "servicios"], "education_info": ["curso", "cursos", "mentoria", "infoproductos"],
    }.items())) + ")"
    hint = {k: _occ("f", ws) for k, ws in {"es": [" de ", " la ", " que ", " en ", " para ", " con ", " clinica ", " nosotros "], "en": [" the ", " and ", " for ", " with ", " services ", " about ", " contact "]}.items()}
    derived = f"""SELECT *, {themes} AS content_themes, {_any('p', ['servicios', 'trabajemos', 'book', 'agenda', 'contacto', 'dm'])} AS cta, {_any('p', ['curso', 'programa', 'coaching', 'agencia', 'edicion', 'marketing', 'shop'])} AS off0, {_any('p', ['clientes', 'marcas', 'negocios', 'founders', 'coaches'])} AS aud,
  CASE WHEN {hint['es']} >= {hint['en']} AND {hint['es']} > 1 THEN 'es' WHEN {hint['en']} > 1 THEN 'en' END AS detected_hint, {_any('lower(t)', ['trabaja con nosotros', 'unete al equipo', 'vacantes', 'careers', 'we are hiring', 'open positions'])} OR lp AS hiring_signals,
  list_contains(stack, 'Meta Pixel') AS ads, len(list_filter(words, lambda w: contains(s, ' ' || w || ' '))) AS hits,
  concat_ws('|', CASE WHEN sl THEN 'instagram activo' END, CASE WHEN tree OR contains(p, 'linktree') THEN 'linktree' END, CASE WHEN contains(p, 'tion') THEN 'tion' END) AS budget_matches FROM x"""
    more = """SELECT *, CASE WHEN niche <> '' AND (contains(s, lower(niche)) OR hits >= 2) THEN niche END AS inferred_niche, off0 OR (soc AND soffer) AS off, cta OR slink OR wa OR em OR ph AS ctas FROM d"""
    rows = [
        ("business_identity", 12, [
            ("owned_contact_channel_visible", 2, "em OR ph"), ("contact_flow_visible", 2, "form AND lc"), ("contact_surface_visible", 1, "form <> lc"), ("owned_location_signal_visible", 2, "place"), ("service_navigation_visible", 2, "ls"), ("about_identity_page_visible", 1, "la"),
            ("conversion_path_visible", 1, "lp OR conv"), ("business_structured_data_visible", 2, "node"), ("social_profile_identity_visible", 2, "handle"), ("social_offer_identity_visible", 2, "soc AND off"), ("social_conversion_path_visible", 1, "soc AND ctas"),
        ]),
        ("contact_availability", 10, [("email_visible", 4, "em"), ("phone_visible", 3, "ph"), ("contact_path_detected", 2, "form OR lc"), ("social_presence_visible", 1, "sl"), ("social_cta_or_link_visible", 2, "ctas")]),
        ("commercial_intent", 10, [
            ("ads_stack_detected", 4, "ads"), ("hiring_signal_detected", 3, "hiring_signals"), ("pricing_keywords_visible", 1, _any("f", feature_rules.PRICING)), ("testimonials_visible", 1, _any("f", feature_rules.TESTIMONIALS)),
            ("portfolio_or_case_studies_visible", 1, _any("f", feature_rules.PORTFOLIO)), ("social_offer_signal_detected", 2, "off"), ("budget_signal_match_detected", 1, "budget_matches <> ''"),
        ]),
        ("digital_maturity", 10, [
            ("title_present", 1, "title <> ''"), ("meta_description_present", 1, "descr <> ''"), ("minimum_content_detected", 1, "n >= 300"), ("substantial_content_detected", 1, "n >= 1200"), ("key_internal_page_detected", 1, "links >= 1"), ("multiple_key_pages_detected", 1, "links >= 2"),
            ("tech_stack_detected", 2, "len(stack) > 0"), ("rich_tech_footprint_detected", 1, "len(stack) >= 3"), ("social_presence_detected", 1, "sl"), ("about_page_detected", 1, "la"), ("social_activity_detected", 2, "sact"), ("external_link_in_profile", 1, "slink"),
        ]),
        ("context_fit", 10, [
            ("target_niche_match", 5, "inferred_niche IS NOT NULL"), ("partial_niche_match", 3, "inferred_niche IS NULL AND niche <> '' AND hits >= 2"), ("target_location_match", 2, "doc_id % 5 = 0 AND contains(s, 'la')"), ("target_language_match", 1, "detected_hint = CASE doc_id % 2 WHEN 0 THEN 'en' ELSE 'es' END"),
            ("budget_signal_keyword_match", 1, "contains(s, 'instagram activo') OR contains(s, 'linktree') OR contains(s, 'tion')"), ("pain_point_keyword_match", 1, "doc_id % 2 = 0 AND (contains(s, 'reservas online') OR contains(s, 'que'))"), ("offer_signal_match", 1, "off"), ("budget_signal_match", 1, "budget_matches <> ''"),
        ]),
        ("stack_fit", 10, [
            ("stack_detected", 2, "len(stack) > 0"), ("seller_stack_matches_prospect_stack", 5, "list_has_any(stack, ['React', 'Shopify'])"), ("cms_or_builder_detected", 2, "list_has_any(stack, ['WordPress', 'WooCommerce', 'Shopify', 'Wix', 'Webflow', 'Elementor'])"),
            ("marketing_or_conversion_stack_detected", 1, "list_has_any(stack, ['Google Analytics', 'Google Tag Manager', 'Meta Pixel', 'HubSpot', 'Stripe'])"),
        ]),
    ]
    comps = ", ".join(x for name, out_of, listed in rows for x in _points(name, out_of, listed))
    weights = {"business_identity": ("0.30", "identidad empresarial"), "contact_availability": ("0.22", "contactabilidad"), "commercial_intent": ("0.18", "intencion comercial"), "digital_maturity": ("0.15", "madurez digital"), "context_fit": ("0.10", "ajuste con el contexto"), "stack_fit": ("0.05", "ajuste de stack")}
    score = " + ".join(f"{k} * {w}::double" for k, (w, _) in weights.items())
    evidence = " + ".join(f"CASE WHEN {k}_evidence = '' THEN 0 ELSE len(string_split({k}_evidence, '|')) END" for k in weights)
    strong = " + ".join(f"({k} >= 0.6)::int" for k in weights)
    ranked = "list_sort(list_filter([" + ", ".join(f"{{'s': -{k}, 'o': {i}, 'l': '{label}'}}" for i, (k, (_, label)) in enumerate(weights.items())) + "], lambda z: z.s <= -0.5))[1:2]"
    direct = "NOT em AND NOT ph AND NOT form"
    signals = [
        ("No muestra contacto directo visible", direct, "reforzar canales de contacto visibles"), ("No se detecta pagina o formulario de contacto", f"NOT ({direct}) AND NOT lc AND NOT form", "habilitar una ruta de contacto mas clara"),
        ("Meta description ausente", "descr = ''", "mejorar metadata publica para captacion organica"), ("Sin redes sociales visibles", "NOT sl", "reforzar presencia social visible"),
        ("Perfil social sin oferta comercial clara", "soc AND NOT off", "aclarar oferta principal y servicios del perfil"), ("Perfil social sin CTA comercial visible", "soc AND NOT ctas", "sumar CTA comercial y link de conversion visible"),
        ("No muestra reservas online visibles", f"doc_id % 2 = 0 AND NOT {_any('f', feature_rules.BOOKING)}", "incorporar reservas online visibles"), ("No muestra prueba social visible", f"n >= 300 AND NOT {_any('f', [*feature_rules.TESTIMONIALS, *feature_rules.PORTFOLIO])}", "destacar testimonios o casos de exito"),
        ("No se detectan herramientas visibles de analitica o marketing", "len(stack) = 0", "mejorar instrumentacion digital visible"),
    ]
    found = lambda part: "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {_lit(part(a, b))} END" for a, c, b in signals) + "], lambda z: z IS NOT NULL)"
    return f"""WITH b AS ({base}), x AS ({text}), d AS ({derived}), e AS ({more}), c AS (SELECT *, {comps} FROM e), r AS (SELECT *, round_even({score}, 4) AS score, {evidence} AS ev, {strong} AS strong FROM c), q AS (SELECT *, {ranked} AS ranked FROM r)
SELECT doc_id, {', '.join(weights)}, score, CASE WHEN (n >= 800 AND ev >= 8 AND strong >= 3) OR (ev >= 12 AND strong >= 4) THEN 'high' WHEN (n >= 250 AND ev >= 4 AND strong >= 1) OR (ev >= 8 AND strong >= 2) THEN 'medium' ELSE 'low' END AS confidence_level,
  CASE WHEN ads AND (hiring_signals OR score >= 0.7 OR commercial_intent >= 0.7) THEN 'high' WHEN ads OR hiring_signals OR score >= 0.45 OR commercial_intent >= 0.45 THEN 'medium' ELSE 'low' END AS estimated_revenue_signal,
  CASE WHEN score >= 0.7 THEN 'Fit heuristico fuerte' WHEN score >= 0.45 THEN 'Fit heuristico moderado' ELSE 'Fit heuristico debil' END || CASE WHEN len(ranked) > 0 THEN '; destacan ' || array_to_string(list_transform(ranked, lambda z: z.l), ', ') || '.' ELSE '; evidencia local limitada.' END AS fit_summary,
  inferred_niche, detected_hint, hiring_signals, CASE WHEN soc AND doc_id % 3 = 0 THEN 'Acme' ELSE trim(string_split(title, '|')[1]) END AS company_name, content_themes,
  concat_ws('|', CASE WHEN cta THEN 'commercial_cta_detected' END, CASE WHEN slink THEN 'external_link_present' END, CASE WHEN em OR ph THEN 'public_contact_present' END, CASE WHEN wa THEN 'whatsapp_cta_present' END) AS platform_ctas,
  concat_ws('|', CASE WHEN soc AND soffer THEN 'offer' END, CASE WHEN off0 THEN 'offer_detected' END) AS offer_signals, CASE WHEN aud THEN 'buyer_audience_detected' ELSE '' END AS audience_signals, CASE WHEN sact THEN 'reels' ELSE '' END AS activity_signals, budget_matches,
  array_to_string(({found(lambda a, b: a)})[1:6], '|') AS observed_signals, array_to_string(({found(lambda a, b: 'Posible oportunidad: ' + b)})[1:5], '|') AS inferred_opportunities, {', '.join(f'{k}_evidence' for k in weights)} FROM q"""


# ---- entity type and taxonomy ----

_SITES = [
    ("https://acme.es/", "acme.es", "/"), ("https://acme.es/blog/x", "acme.es", "/blog/x"), ("https://acme.es/directorio", "acme.es", "/directorio"), ("https://acme.es/best-x", "acme.es", "/best-x"),
    ("https://acme.es/marketplace/y", "acme.es", "/marketplace/y"), ("https://acme.es/newsroom", "acme.es", "/newsroom"), ("https://www.revista.es/", "revista.es", "/"), ("https://listing.io/companies", "listing.io", "/companies"),
    ("https://agencia.es/", "agencia.es", "/"), ("https://consulting.es/", "consulting.es", "/"), ("https://acme.es/posts/1", "acme.es", "/posts/1"),
]
_TITLES = ["Top 10 dentistas", "Asociación de vendors", "Find a consultant", "Best reviews and rankings of the newsroom", "", "Clínica dental y agencia SEO", "la revista diario press"]


def stand_in_entities(spark, sf_dir) -> DataFrame:
    site = "element_at(array(" + ", ".join(f"'{u}'" for u, _, _ in _SITES) + f"), cast(pmod(doc_id, {len(_SITES)}) AS int) + 1)"
    title = "element_at(array(" + ", ".join(f"'{t}'" for t in _TITLES) + f"), cast(pmod(doc_id, {len(_TITLES)}) AS int) + 1)"
    return stand_in_pages(spark, sf_dir).withColumns({"url": F.expr(site), "website_url": F.lit(None).cast("string"), "discovery_title": F.expr(title), "discovery_snippet": F.lit(None).cast("string"), "inferred_niche": F.expr("CASE WHEN pmod(doc_id, 9) = 0 THEN 'clinica dental' END")})


def entity_classify(spark, sf_dir):
    df = entity.classify(stand_in_entities(spark, sf_dir))
    scores = "array_join(transform(map_entries(entity_scores), e -> concat(e.key, ':', e.value)), ',')"
    return df.select("doc_id", "entity_type_detected", "entity_type_confidence", "is_target_entity", "target_reason", F.expr(scores).alias("entity_scores"), F.array_join("matched_rules", "|").alias("matched_rules"))


def entity_taxonomy(spark, sf_dir):
    df = entity.taxonomy(entity.classify(stand_in_entities(spark, sf_dir)))
    return df.select("doc_id", "entity_type_detected", "taxonomy_business_type", "taxonomy_top_level", "display_category", "taxonomy_niche", "taxonomy_score")


def _entity_parts() -> str:
    """Common table expressions up to o (scores by type) and z (the decision)."""
    pick = lambda items, k: "[" + ", ".join(_lit(x) for x in items) + f"][doc_id % {k} + 1]"
    links = "CASE doc_id % 6 WHEN 0 THEN 'https://x.es/contacto https://x.es/servicios' WHEN 1 THEN 'https://x.es/about' WHEN 2 THEN 'https://x.es/pricing https://x.es/careers https://x.es/contact' ELSE '' END"
    base = f"""SELECT doc_id, coalesce(text, '') AS t, {pick([h for _, h, _ in _SITES], len(_SITES))} AS host, {pick([q for _, _, q in _SITES], len(_SITES))} AS path, {pick(_TITLES, len(_TITLES))} AS dt, {links} AS links,
  CASE doc_id % 3 WHEN 0 THEN 'Estudio | Web' WHEN 1 THEN '' ELSE 'Shop (x)' END AS title, CASE doc_id % 4 WHEN 0 THEN '' ELSE 'Servicios de marketing' END AS descr, CASE WHEN doc_id % 9 = 0 THEN 'clinica dental' END AS niche,
  doc_id % 2 = 0 OR doc_id % 5 = 0 OR doc_id % 7 = 0 AS hc, doc_id % 9 = 0 OR doc_id % 4 = 1 AS place, doc_id % 6 = 2 OR doc_id % 11 = 0 OR doc_id % 13 = 0 AS conv,
  doc_id % 6 = 0 AS ls, doc_id % 6 = 1 AS la, doc_id % 6 IN (0, 2) AS lc, doc_id % 4 = 3 AND doc_id % 8 = 3 AS handle, doc_id % 16 = 3 AS soffer, doc_id % 5 AS node FROM documents WHERE doc_id IS NOT NULL"""
    text = f"SELECT *, ' ' || {COLLAPSE.format(FOLD.format("title || ' ' || descr || ' ' || dt || ' ' || links || ' ' || substr(t, 1, 1200)"))} || ' ' AS s FROM b"
    more = "SELECT *, regexp_extract(s, '\\b(top|best|mejores)\\s+\\d+\\b') AS listicle FROM x"
    words = {"agency": (3, entity_rules.AGENCY), "consultant": (3, entity_rules.CONSULTANT), "association": (4, entity_rules.ASSOCIATION), "directory": (3, entity_rules.DIRECTORY), "aggregator": (2, entity_rules.AGGREGATOR), "marketplace": (3, entity_rules.MARKETPLACE), "media": (2, entity_rules.MEDIA)}
    own = [("ls", 2, "'service_navigation_detected'"), ("la", 1, "'about_page_detected'"), ("lc AND hc", 2, "'contact_page_and_channels_detected'"), ("lc <> hc", 1, "'contact_identity_signal_detected'"), ("place", 2, "'location_identity_signal_detected'"), ("conv", 1, "'commercial_conversion_path_detected'"), ("node = 1", 3, "'business_schema_detected:dentist'"), ("handle", 2, "'social_handle_detected'"), ("soffer", 3, "'social_offer_signals_detected'")]
    tail = {
        "blog_post": [(_any("path", entity_rules.BLOG_PATHS), 5, "'editorial_path:' || path"), ("node = 2", 4, "'article_schema_detected:article'")],
        "directory": [(_any("path", entity_rules.DIRECTORY_PATHS), 4, "'directory_path:' || path"), (_any("host", ["directory", "directorio", "listing", "listings"]), 3, "'directory_host:' || host"), ("node = 3", 3, "'listing_schema_detected:itemlist'")],
        "aggregator": [(_any("path", entity_rules.AGGREGATOR_PATHS), 4, "'aggregator_path:' || path"), ("listicle <> ''", 3, "'listicle_pattern:' || listicle")], "marketplace": [(_any("path", entity_rules.MARKETPLACE_PATHS), 4, "'marketplace_path:' || path")],
        "media": [(_any("path", entity_rules.MEDIA_PATHS), 4, "'media_path:' || path"), (_any("host", ["news", "revista", "magazine", "journal", "diario", "press"]), 3, "'media_host:' || host")],
        "agency": [(_any("host", ["agency", "agencia", "studio", "estudio"]), 2, "'agency_host:' || host")], "consultant": [(_any("host", ["consult", "advisor", "asesor"]), 2, "'consultant_host:' || host")], "direct_business": own,
    }
    kinds = ["direct_business", "directory", "aggregator", "marketplace", "media", "blog_post", "association", "agency", "consultant"]
    columns = []
    for k in kinds:
        rows = tail.get(k, [])
        total = [f"CASE WHEN {c} THEN {n} ELSE 0 END" for c, n, _ in rows]
        shown = "[" + ", ".join(f"CASE WHEN {c} THEN {e} END" for c, _, e in rows) + "]::varchar[]"
        if k in words:
            n, listed = words[k]
            listed = entity.folded(listed)
            total.append(f"{n} * {_count('s', listed)}")
            shown = "list_concat([" + ", ".join(f"CASE WHEN contains(s, {_lit(w)}) THEN {_lit(f'{k}_keyword:{w}')} END" for w in listed) + f"], {shown})"
        columns += [f"{' + '.join(total)} AS s_{k}", f"list_filter({shown}, lambda z: z IS NOT NULL) AS e_{k}"]
    order = "list_sort([" + ", ".join(f"{{'s': -s_{k}, 'o': {i}, 'k': '{k}'}}" for i, k in enumerate(kinds)) + "])"
    non = "('directory', 'aggregator', 'marketplace', 'media', 'blog_post', 'association')"
    return f"""WITH b AS ({base}), x AS ({text}), w AS ({more}), c AS (SELECT *, {', '.join(columns)} FROM w), o AS (SELECT *, {order} AS ord, s_direct_business + greatest(s_agency, s_consultant) AS ident, greatest(s_directory, s_aggregator, s_marketplace, s_media, s_blog_post, s_association) AS against FROM c),
t0 AS (SELECT *, CASE WHEN ord[1].s < 0 THEN ord[1].k WHEN ident >= 3 THEN 'direct_business' ELSE 'unknown' END AS k0, CASE WHEN ord[1].s < 0 THEN -ord[1].s WHEN ident >= 3 THEN ident ELSE 0 END AS v0 FROM o),
t1 AS (SELECT *, (node = 2 OR {_any('path', entity_rules.BLOG_PATHS)}) AND k0 IN ('directory', 'aggregator', 'media') AND s_blog_post >= 4 AS over1 FROM t0), t2 AS (SELECT *, CASE WHEN over1 THEN 'blog_post' ELSE k0 END AS k1, CASE WHEN over1 THEN s_blog_post ELSE v0 END AS v1 FROM t1),
t3 AS (SELECT *, k1 IN {non} AND ident >= v1 + 3 AS over2 FROM t2), z AS (SELECT *, CASE WHEN over2 THEN 'direct_business' ELSE k1 END AS k, CASE WHEN over2 THEN s_direct_business ELSE v1 END AS v FROM t3)"""


def _entity_sql() -> str:
    kinds = ["direct_business", "directory", "aggregator", "marketplace", "media", "blog_post", "association", "agency", "consultant"]
    non = "('directory', 'aggregator', 'marketplace', 'media', 'blog_post', 'association')"
    evidence = "CASE k " + " ".join(f"WHEN '{k}' THEN e_{k}" for k in kinds) + " ELSE [] END"
    extra = "list_filter([CASE WHEN over1 AND k = 'blog_post' THEN 'editorial_evidence_overrides_listing_signals' END, CASE WHEN over2 THEN 'business_identity_overrides_non_target' END], lambda z: z IS NOT NULL)"
    return f"""{_entity_parts()} SELECT doc_id, k AS entity_type_detected, CASE WHEN k = 'unknown' THEN 'low' WHEN v >= 7 AND v + ord[2].s >= 2 THEN 'high' WHEN v >= 4 THEN 'medium' ELSE 'low' END AS entity_type_confidence,
  CASE WHEN k IN ('direct_business', 'agency', 'consultant') THEN true WHEN k IN {non} THEN false ELSE ident >= 4 AND against <= 2 END AS is_target_entity,
  CASE WHEN k IN ('direct_business', 'agency', 'consultant') THEN 'target_entity_type:' || k WHEN k IN {non} THEN 'non_target_entity_type:' || k WHEN ident >= 4 AND against <= 2 THEN 'fallback_business_identity_target' ELSE 'fallback_unknown_entity_non_target' END AS target_reason,
  array_to_string(list_transform(list_filter(ord, lambda q: q.s < 0), lambda q: q.k || ':' || (-q.s)), ',') AS entity_scores, array_to_string((list_concat({evidence}, {extra}))[1:8], '|') AS matched_rules FROM z"""


def _entity_taxonomy_sql() -> str:
    agency = "CASE " + " ".join(f"WHEN {_any('tx', entity.folded(ws))} THEN '{k}'" for k, ws in taxonomy_rules.AGENCIES.items()) + " ELSE 'professional_service' END"
    nodes_of = {1: ["dentist"], 2: ["article", "thing"], 3: ["itemlist"]}
    score = {}
    for kind, _, _, _, words, nodes in taxonomy_rules.TAXONOMY:
        if kind == "unknown":
            continue
        terms = [f"(k = '{e}')::int * 10" for e, t in taxonomy_rules.BY_ENTITY.items() if t == kind]
        if kind in taxonomy_rules.AGENCIES or kind == "professional_service":
            terms.append(f"(k = 'agency' AND {agency} = '{kind}')::int * 8")
        if kind == "local_business":
            terms.append("(k = 'direct_business')::int * 3")
        if hit := [n for n, types in nodes_of.items() if set(types) & set(nodes)]:
            terms.append(f"(node IN ({', '.join(map(str, hit))}))::int * 7")
        if words:
            terms.append(f"2 * least(3, {_count('tx', entity.folded(words))})")
        score[kind] = " + ".join(terms) or "0"
    text = COLLAPSE.format(FOLD.format("coalesce(niche, '') || ' ' || title || ' ' || descr || ' ' || links || ' ' || substr(t, 1, 2400)"))
    best = "list_sort([" + ", ".join(f"{{'s': -({e}), 'o': {i}, 'k': '{k}'}}" for i, (k, e) in enumerate(score.items())) + "])[1]"
    pick = lambda c: "CASE tt " + " ".join(f"WHEN '{r[0]}' THEN {_lit(r[c])}" for r in taxonomy_rules.TAXONOMY) + " END"
    return f"""{_entity_parts()}, y AS (SELECT *, {text} AS tx FROM z), g AS (SELECT *, {best} AS best FROM y), h AS (SELECT *, CASE WHEN -best.s < 3 THEN 'unknown' ELSE best.k END AS tt FROM g)
SELECT doc_id, k AS entity_type_detected, tt AS taxonomy_business_type, {pick(1)} AS taxonomy_top_level, {pick(3)} AS display_category, CASE WHEN tt <> 'unknown' THEN {pick(2)} ELSE coalesce(niche, 'Desconocido') END AS taxonomy_niche, -best.s AS taxonomy_score FROM h"""


# ---- payloads of language models ----

#: (JSON fragment or None for a missing field, expected values as SQL) of each field, by part key.
_NICHE = [('"  Dental "', "'Dental'"), ('""', "'Desconocido'"), (None, "NULL"), ('"x"', "'x'"), ('"y"', "'y'")]
_STACK = [('["React", " React ", "", null, "Vue"]', "'React|Vue'"), ("[]", "''"), ('"React"', "NULL"), ('["a"]', "'a'")]
_HIRING = [("true", "true"), ('"Sí"', "true"), ('"no"', "false"), ("0", "false"), ('"maybe"', "NULL"), ("1", "true"), ('" YES "', "true")]
_REVENUE = [('" High "', "'high'"), ('"low"', "'low'"), ('"medium"', "'medium'"), ('"huge"', "NULL")]
_SCORE = [("0.5", "0.5"), ('"1.7"', "1.0"), ("-2", "0.0"), ('"abc"', "NULL"), ("0.25", "0.25"), ("1", "1.0")]
_LEVEL = [('"High"', "'high'"), ("0.85", "'high'"), ('"0.5"', "'medium'"), ("0.1", "'low'"), ('"sure"', "NULL")]
_ATTRIBUTES = [
    ('{"observed_signals": ["- sin web", "Sin web", "2. lento;"], "inferred_opportunities": ["Mejorar web"], "pain_points_detected": ["p"]}', "'sin web|lento'", "'Posible oportunidad: mejorar web'"),
    ('{"observed_signals": [], "inferred_opportunities": [], "pain_points_detected": ["podria crecer", "Otra"]}', "''", "'podria crecer|Posible oportunidad: otra'"), ('{}', "''", "''"), (None, "''", "''"),
]
_FIELDS = [("inferred_niche", _NICHE), ("inferred_tech_stack", _STACK), ("hiring_signals", _HIRING), ("estimated_revenue_signal", _REVENUE), ("score", _SCORE), ("confidence_level", _LEVEL), ("generic_attributes", _ATTRIBUTES)]
#: Divisors that make the cases of the fields meet in all combinations as keys go on.
_STEP = {"inferred_niche": 11, "inferred_tech_stack": 3, "hiring_signals": 2, "estimated_revenue_signal": 5, "score": 7, "confidence_level": 13, "generic_attributes": 17}


def payload_validate(spark, sf_dir):
    case = lambda name, rows: f"element_at(array({', '.join('cast(NULL AS string)' if r[0] is None else _spark_lit(f'\"{name}\": {r[0]}') for r in rows)}), cast(pmod(p_partkey div {_STEP[name]}, {len(rows)}) AS int) + 1)"
    whole = f"concat('{{', concat_ws(', ', {', '.join(case(n, rows) for n, rows in _FIELDS)}), '}}')"
    raw = f"CASE pmod(p_partkey, 19) WHEN 0 THEN NULL WHEN 1 THEN 'not json' WHEN 2 THEN '[1]' ELSE {whole} END"
    rows = _t(spark, sf_dir, "part").selectExpr("p_partkey", f"{raw} AS payload", "cast(pmod(p_partkey, 900) AS bigint) AS prompt_tokens", "cast(CASE WHEN pmod(p_partkey, 4) > 0 THEN pmod(p_partkey, 70) END AS bigint) AS completion_tokens")
    df = extraction.validate(rows)
    joined = lambda c: F.array_join(c, "|").alias(c)
    cost = F.expr(extraction.usage_cost("prompt_tokens", "completion_tokens", 0.14, 0.28)).alias("cost_usd")
    return df.select("p_partkey", "ai_niche", joined("ai_tech_stack"), "ai_hiring", "ai_revenue", "ai_score", "ai_confidence", joined("ai_observed"), joined("ai_opportunities"), "valid", "fallback_reason", cost)


def _spark_lit(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _payload_sql() -> str:
    got = lambda name, rows, k=1: f"CASE WHEN is_json THEN CASE (p_partkey // {_STEP[name]}) % {len(rows)} " + " ".join(f"WHEN {i} THEN {r[k]}" for i, r in enumerate(rows)) + " END END"
    return f"""WITH r AS (SELECT p_partkey, p_partkey % 19 AS m, p_partkey % 19 > 2 AS is_json FROM part), c AS (SELECT p_partkey, m, is_json, {got('inferred_niche', _NICHE)} AS ai_niche, {got('inferred_tech_stack', _STACK)} AS ai_tech_stack, {got('hiring_signals', _HIRING)} AS ai_hiring, {got('estimated_revenue_signal', _REVENUE)} AS ai_revenue,
  ({got('score', _SCORE)})::double AS ai_score, {got('confidence_level', _LEVEL)} AS ai_confidence, coalesce({got('generic_attributes', _ATTRIBUTES)}, '') AS ai_observed, coalesce({got('generic_attributes', _ATTRIBUTES, 2)}, '') AS ai_opportunities, (p_partkey // {_STEP['generic_attributes']}) % {len(_ATTRIBUTES)} < 3 AS attributes FROM r),
v AS (SELECT *, is_json AND attributes AND ai_niche IS NOT NULL AND ai_tech_stack IS NOT NULL AND ai_hiring IS NOT NULL AND ai_revenue IS NOT NULL AND ai_score IS NOT NULL AND ai_confidence IS NOT NULL AS valid FROM c)
SELECT p_partkey, ai_niche, ai_tech_stack, ai_hiring, ai_revenue, ai_score, ai_confidence, ai_observed, ai_opportunities, valid, CASE WHEN m = 0 THEN 'missing_payload' WHEN NOT is_json THEN 'invalid_json' WHEN NOT valid THEN 'invalid_payload' END AS fallback_reason,
  CASE WHEN p_partkey % 4 > 0 THEN round_even(((p_partkey % 900) * 0.14::double + (p_partkey % 70) * 0.28::double) / 1000000.0::double, 8) END AS cost_usd FROM v"""


# ---- location ----

_PLACES = [
    "Calle Mayor 1, 28013 Madrid, España", "es", "Lima", "Ciudad de México 06000", "Hotel Castellana, Madrid", "Santiago; Chile", "tel 600 111 222, Bogotá", "Springfield", "La Paz, Bolivia", "Av. Corrientes 1234 | Buenos Aires | AR", "MADRID", "nowhere in particular",
    "Córdoba, Argentina", "uruguay montevideo", "", "https://a.es/x Sevilla, España", "a@b.es, Cusco, Perú", "12345678, Toledo, Toledo, ES", "Plaza 5, Calle 7", "Valencia , , Valencia",
]


def location_parse(spark, sf_dir):
    """Every document's text read as a location, with places that make each rule fire behind it and alone."""
    fixed = spark.createDataFrame([(-i - 1, p) for i, p in enumerate(_PLACES)], "id bigint, place string")
    place = "concat(coalesce(text, ''), CASE WHEN length(text) < 150 THEN element_at(array(" + ", ".join(_spark_lit(f", {x}") for x in _PLACES) + f"), cast(pmod(doc_id, {len(_PLACES)}) AS int) + 1) ELSE '' END)"
    rows = fixed.unionByName(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.expr(place).alias("place")))
    df = quality.parse_location(rows, "place", "l_")
    return df.select("id", "l_raw", "l_country", "l_postal", "l_city", "l_region", F.expr(quality.format_location("l_city", "l_region", "l_country", "l_postal")).alias("formatted"))


def _location_sql() -> str:
    fold = lambda x: COLLAPSE.format(FOLD.format(x))
    aliases = quality.country_aliases()
    of = lambda f: "coalesce(CASE " + f + " " + " ".join(f"WHEN {_lit(a)} THEN {_lit(n)}" for a, n in aliases) + " END, CASE " + " ".join(f"WHEN contains(' ' || {f} || ' ', {_lit(f' {a} ')}) THEN {_lit(n)}" for a, n in aliases if len(a) > 2) + " END)"
    same = "CASE country " + " ".join(f"WHEN {_lit(name)} THEN bf IN ({', '.join(_lit(quality._fold(x)) for x in [key, name, *targets, *codes])})" for key, name, targets, codes, _, _, _ in COUNTRIES) + " ELSE false END"
    street = _any("' ' || bf || ' '", [f" {h} " for h in quality_rules.STREETS])
    postal = "(?i)\\b[A-Z]{0,2}\\d{4,6}[A-Z]{0,3}\\b"
    values = ", ".join(f"({-i - 1}, {_lit(x)})" for i, x in enumerate(_PLACES))
    tail = "[" + ", ".join(_lit(f", {x}") for x in _PLACES) + f"][doc_id % {len(_PLACES)} + 1]"
    noise = f"(cf = '' OR contains(c, '@') OR regexp_matches(lower(c), '^(https?://|www[.])') OR {_any('cf', quality_rules.LOCATION_NOISE)} OR (length(regexp_replace(c, '[^0-9]', '', 'g')) >= 8 AND NOT regexp_matches(c, '[A-Za-zÁÉÍÓÚáéíóúÑñ]')))"
    return f"""WITH r AS (SELECT * FROM (VALUES {values}) v(id, place) UNION ALL SELECT doc_id, coalesce(text, '') || CASE WHEN length(text) < 150 THEN {tail} ELSE '' END FROM documents),
a AS (SELECT id, nullif(substr(trim(regexp_replace(regexp_replace(regexp_replace(place, '(?i)https?://\\S+', ' ', 'g'), '[\\n\\r\\t|;]+', ', ', 'g'), '\\s+', ' ', 'g'), ' ,.-'), 1, 240), '') AS l_raw FROM r), af AS (SELECT *, {fold("coalesce(l_raw, '')")} AS rf FROM a),
a2 AS (SELECT *, {of('rf')} AS c0, nullif(upper(regexp_extract(l_raw, '{postal}')), '') AS l_postal FROM af),
ch AS (SELECT id, unnest(range(1, len(string_split(l_raw, ',')) + 1)) AS o, unnest(string_split(l_raw, ',')) AS raw FROM a2 WHERE l_raw IS NOT NULL), c1 AS (SELECT id, o, substr(trim(regexp_replace(raw, '\\s+', ' ', 'g')), 1, 120) AS c FROM ch), c2 AS (SELECT *, {fold('c')} AS cf FROM c1),
c3 AS (SELECT *, {of('cf')} AS cc FROM c2 WHERE c <> '' AND NOT {noise}), first AS (SELECT id, arg_min(cc, o) AS c1st FROM c3 WHERE cc IS NOT NULL GROUP BY id), k AS (SELECT a2.*, coalesce(c0, c1st) AS country FROM a2 LEFT JOIN first USING (id)),
b1 AS (SELECT c3.id, o, country, trim(trim(regexp_replace(regexp_replace(c, '{postal}', ' ', 'g'), '\\s+', ' ', 'g')), ' ,.-') AS b FROM c3 JOIN k USING (id)), b2 AS (SELECT *, {fold('b')} AS bf FROM b1 WHERE b <> ''),
b3 AS (SELECT *, {street} AS street FROM b2 WHERE NOT coalesce(country IS NOT NULL AND (bf = {fold('country')} OR {same}), false)), n AS (SELECT id, bool_or(NOT street) AS plain FROM b3 GROUP BY id),
p AS (SELECT id, list(b ORDER BY o) AS pick FROM b3 JOIN n USING (id) WHERE NOT plain OR NOT street GROUP BY id), z AS (SELECT k.id, l_raw, country AS l_country, l_postal, pick[-1] AS l_city, pick[-2] AS reg FROM k LEFT JOIN p USING (id)),
y AS (SELECT *, CASE WHEN {fold('reg')} <> {fold('l_city')} THEN reg END AS l_region, nullif(concat_ws(' ', l_postal, l_city), '') AS spot FROM z), x AS (SELECT *, CASE WHEN {fold("coalesce(l_region, '')")} NOT IN ({fold("coalesce(spot, '')")}, {fold("coalesce(l_country, '')")}) THEN l_region END AS shown FROM y)
SELECT id, l_raw, l_country, l_postal, l_city, l_region, nullif(substr(concat_ws(', ', spot, shown, CASE WHEN {fold("coalesce(l_country, '')")} NOT IN ({fold("coalesce(spot, '')")}, {fold("coalesce(shown, '')")}) THEN l_country END), 1, 160), '') AS formatted FROM x"""


QUERIES = {
    "heuristic_components": (heuristic_components, _heuristics_sql()), "entity_classify": (entity_classify, _entity_sql()), "entity_taxonomy": (entity_taxonomy, _entity_taxonomy_sql()), "payload_validate": (payload_validate, _payload_sql()), "location_parse": (location_parse, _location_sql()),
}
