"""Heuristic features of a page and their weighted score. Native expressions over one row.

Input columns: those of parse() plus html_stack (technologies of the raw HTML) or html itself, and the target's criteria as columns of the job:
target_niche, target_location, target_language, target_pain_points, target_budget_signals, user_technologies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_in, ascii_fold, best_of, collapse, even, first_of_each, fold_padded, let, occurrences, quoted, strings
from ..rules import features as rules

#: Fixed values.
WEIGHTS = {"business_identity": 0.30, "contact_availability": 0.22, "commercial_intent": 0.18, "digital_maturity": 0.15, "context_fit": 0.10, "stack_fit": 0.05}
LABELS = {"business_identity": "identidad empresarial", "contact_availability": "contactabilidad", "commercial_intent": "intencion comercial", "digital_maturity": "madurez digital", "context_fit": "ajuste con el contexto", "stack_fit": "ajuste de stack"}
HIRING_PHRASES = ["trabaja con nosotros", "unete al equipo", "vacantes", "careers", "we are hiring", "open positions"]
HIRING_LINKS = ["career", "trabajo", "empleo", "join-us"]
KEYWORD_STOPWORDS = ["para", "with", "from", "your", "this", "that", "los", "las", "del", "con"]
THEMES = {
    "video_content": ["reels", "shorts", "ugc", "video", "edicion"],
    "personal_brand": ["marca personal", "coach", "founder", "creator", "creador"],
    "ecommerce": ["ecommerce", "tienda online", "shop", "shopify"],
    "agency_services": ["agencia", "estudio", "marketing", "servicios"],
    "education_info": ["curso", "cursos", "mentoria", "infoproductos"],
}
PROFILE_CTAS = ["servicios", "trabajemos", "book", "agenda", "contacto", "dm"]
OFFERS = ["curso", "programa", "coaching", "agencia", "edicion", "marketing", "shop"]
AUDIENCES = ["clientes", "marcas", "negocios", "founders", "coaches"]
BUILDERS = ["WordPress", "WooCommerce", "Shopify", "Wix", "Webflow", "Elementor"]
MARKETING = ["Google Analytics", "Google Tag Manager", "Meta Pixel", "HubSpot", "Stripe"]
CONVERSION_LINKS = ["pricing", "precio", "precios", "book", "booking", "reserv", "agenda"]
ABOUT_LINKS = ["about", "nosotros", "equipo"]
OPPORTUNITIES = {
    "No muestra contacto directo visible": "reforzar canales de contacto visibles",
    "No se detecta pagina o formulario de contacto": "habilitar una ruta de contacto mas clara",
    "Meta description ausente": "mejorar metadata publica para captacion organica",
    "Sin redes sociales visibles": "reforzar presencia social visible",
    "Perfil social sin oferta comercial clara": "aclarar oferta principal y servicios del perfil",
    "Perfil social sin CTA comercial visible": "sumar CTA comercial y link de conversion visible",
    "No muestra reservas online visibles": "incorporar reservas online visibles",
    "No muestra prueba social visible": "destacar testimonios o casos de exito",
    "No se detectan herramientas visibles de analitica o marketing": "mejorar instrumentacion digital visible",
}
CAUTIOUS = "Posible oportunidad: "
CAUTIOUS_MARKERS = ["posible oportunidad:", "oportunidad probable:", "podria ", "podría ", "convendria ", "convendría ", "seria valioso ", "sería valioso "]
MOST_SIGNALS, MOST_OPPORTUNITIES = 6, 5


def technologies(html: str) -> str:
    listed = "array_compact(array(" + ", ".join(f"CASE WHEN {any_in('page_l', signs)} THEN {quoted(name)} END" for name, signs in rules.TECHNOLOGIES.items()) + "))"
    return let("page_l", f"lower({html})", listed)


def hiring(text: str, links: str) -> str:
    return f"({let('text_l', f'lower({text})', any_in('text_l', HIRING_PHRASES))} OR exists({links}, l -> {any_in('lower(l)', HIRING_LINKS)}))"


def language_hint(folded: str, languages: dict[str, list[str]] = rules.LANGUAGES) -> str:
    """Language with most occurrences of its hint words if they are more than one."""
    return let("hint_f", folded, best_of({name: occurrences("hint_f", hints) for name, hints in languages.items()}, "1"))


def keywords(value: str) -> str:
    """Distinct folded words of three or more letters or digits without stop words."""
    return f"array_except(regexp_extract_all({ascii_fold(value)}, '[a-z0-9]{{3,}}', 0), {strings(KEYWORD_STOPWORDS)})"


def clean_list(items: str, most: int) -> str:
    """Items without bullets and outer punctuation, first of each spelling whatever its case, at most so many."""
    edges = "'-*0123456789.)] '"
    strip = f"trim(BOTH ' .,:;' FROM {collapse(f'trim(BOTH {edges} FROM trim(i))')})"
    kept = f"filter(transform(array_compact({items}), i -> {strip}), i -> i <> '')"
    return f"slice({first_of_each(kept, 'lower(x)')}, 1, {most})"


def opportunities(items: str) -> str:
    marked = " OR ".join(f"startswith(lower(o), {quoted(m)})" for m in CAUTIOUS_MARKERS)
    return f"transform({clean_list(items, MOST_OPPORTUNITIES)}, o -> CASE WHEN {marked} THEN o ELSE concat({quoted(CAUTIOUS)}, lower(left(o, 1)), substring(o, 2)) END)"


def _points(rows: list[tuple[str, int, str]], name: str, out_of: int) -> dict:
    """Score and evidence columns of a component out of (evidence, points, condition)."""
    total = " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for _, p, c in rows)
    listed = ", ".join(f"CASE WHEN {c} THEN {quoted(e)} END" for e, _, c in rows)
    return {name: F.expr(even(f"least(({total}) / {out_of}D, 1D)", 4)), f"{name}_evidence": F.expr(f"array_compact(array({listed}))")}


def _context_list(column: str) -> str:
    return f"array_distinct(filter(transform(coalesce({column}, cast(array() AS array<string>)), v -> lower(trim(v))), v -> v <> ''))"


def profile(df: DataFrame) -> DataFrame:
    """Content profile: themes, offers, audiences, calls to action, budget matches (sorted sets)."""
    social = lambda f: f"coalesce(social_profile.{f}, cast(array() AS array<string>))"
    only = lambda c, v: f"CASE WHEN {c} THEN array({quoted(v)}) ELSE cast(array() AS array<string>) END"
    done = lambda *parts: F.expr(f"array_sort(array_distinct(concat({', '.join(parts)})))")
    # folding goes letter by letter, so the page's text is folded once for all three
    df = df.withColumns({"clean_f": F.expr(ascii_fold("clean_text")), "head_f": F.expr(ascii_fold("concat_ws(' ', coalesce(title, ''), coalesce(description, ''))")), "bio_f": F.expr(ascii_fold("social_profile.bio"))})
    joined = lambda *parts: F.expr(f"concat(' ', concat_ws(' ', CASE WHEN clean_text IS NOT NULL THEN clean_f END, {', '.join(parts)}), ' ')")
    df = df.withColumns({"text_f": F.expr("concat(' ', clean_f, ' ')"), "search_f": joined("head_f"), "profile_f": joined("head_f", "bio_f")}).drop("clean_f", "head_f", "bio_f")
    has_link = f"size({social('external_links')}) > 0"
    signal = "contains(profile_f, " + ascii_fold("s") + ") OR (contains(s, 'instagram') AND exists(social_links, l -> contains(l, 'instagram.com'))) OR (contains(s, 'tiktok') AND exists(social_links, l -> contains(l, 'tiktok.com'))) OR (contains(s, 'linktree') AND exists(external_links, l -> contains(l, 'linktr.ee')))"
    return df.withColumns({
        "content_themes": F.expr("array_sort(array_compact(array(" + ", ".join(f"CASE WHEN {any_in('profile_f', words)} THEN {quoted(t)} END" for t, words in THEMES.items()) + ")))"),
        "platform_ctas": done(social("platform_ctas"), only(any_in("profile_f", PROFILE_CTAS), "commercial_cta_detected"), only(has_link, "external_link_present"), only("whatsapp_url IS NOT NULL", "whatsapp_cta_present"), only("size(emails) > 0 OR size(phones) > 0", "public_contact_present")),
        "offer_signals": done(social("offer_signals"), only(any_in("profile_f", OFFERS), "offer_detected")),
        "audience_signals": done(social("audience_signals"), only(any_in("profile_f", AUDIENCES), "buyer_audience_detected")),
        "activity_signals": done(social("activity_signals")),
        "profile_links": F.expr(f"slice({social('external_links')}, 1, 5)"),
        "budget_matches": F.expr(f"array_sort(array_distinct(filter({_context_list('target_budget_signals')}, s -> {signal})))"),
    })


def heuristics(df: DataFrame) -> DataFrame:
    """Adds the six components with evidence, score, confidence_level, revenue signal, fit summary, signals and opportunities."""
    df = profile(df).withColumns({
        "inferred_tech_stack": F.expr("html_stack" if "html_stack" in df.columns else technologies("coalesce(html, '')")), "hiring_signals": F.expr(hiring("clean_text", "internal_links")),
        "detected_hint": F.expr(language_hint("text_f")), "niche_words": F.expr(keywords("target_niche")), "clean_len": F.expr("length(trim(clean_text))"),
    })
    niche = ascii_fold("trim(target_niche)")
    token_hits = "size(filter(niche_words, t -> contains(search_f, concat(' ', t, ' '))))"
    df = df.withColumns({
        "has_active_ads": F.expr("array_contains(inferred_tech_stack, 'Meta Pixel')"),
        "niche_hits": F.expr(token_hits),
        "inferred_niche": F.expr(f"CASE WHEN trim(target_niche) <> '' AND (({niche} <> '' AND contains(search_f, {niche})) OR (size(niche_words) >= 2 AND {token_hits} >= 2)) THEN trim(target_niche) END"),
        "link_contact": F.expr(f"exists(internal_links, l -> {any_in('lower(l)', ['contact', 'contacto'])})"),
        "link_about": F.expr(f"exists(internal_links, l -> {any_in('lower(l)', ABOUT_LINKS)})"),
        "link_service": F.expr(f"exists(internal_links, l -> {any_in('lower(l)', ['service', 'servicio'])})"),
        "conversion": F.expr(f"exists(internal_links, l -> {any_in('lower(l)', CONVERSION_LINKS)}) OR booking_url IS NOT NULL OR pricing_page_url IS NOT NULL"),
        "business_node": F.expr(f"exists(structured_data, j -> {ascii_fold("replace(get_json_object(j, '$.@type'), ' ', '')")} IN ({', '.join(map(quoted, rules.BUSINESS_NODES))}))"),
        "is_social_": F.expr("coalesce(primary_identity_type = 'social_profile', false)"),
        "stack_f": F.expr(f"transform(inferred_tech_stack, t -> {ascii_fold('t')})"),
        "wanted_f": F.expr(f"transform({_context_list('user_technologies')}, t -> trim({ascii_fold('t')}))"),
        # points, evidence and signals ask for these, so each dictionary is looked up once
        "priced_": F.expr(any_in("text_f", rules.PRICING)), "praised_": F.expr(any_in("text_f", rules.TESTIMONIALS)), "shown_": F.expr(any_in("text_f", rules.PORTFOLIO)),
    })
    any_listed = lambda column: f"exists({_context_list(column)}, s -> contains(search_f, trim({ascii_fold('s')})))"
    in_stack = lambda names: f"arrays_overlap(inferred_tech_stack, {strings(names)})"
    # Fixed values down to the opportunities: names of evidence, their points, what a component's points are out of, thresholds, texts.
    components = (
        _points([
            ("owned_contact_channel_visible", 2, "size(emails) > 0 OR size(phones) > 0"), ("contact_flow_visible", 2, "form_detected AND link_contact"), ("contact_surface_visible", 1, "form_detected <> link_contact"),
            ("owned_location_signal_visible", 2, "size(addresses) > 0 OR size(map_links) > 0"), ("service_navigation_visible", 2, "link_service"), ("about_identity_page_visible", 1, "link_about"),
            ("conversion_path_visible", 1, "conversion"), ("business_structured_data_visible", 2, "business_node"), ("social_profile_identity_visible", 2, "is_social_ AND social_profile.handle <> ''"),
            ("social_offer_identity_visible", 2, "is_social_ AND size(offer_signals) > 0"), ("social_conversion_path_visible", 1, "is_social_ AND size(platform_ctas) > 0"),
        ], "business_identity", 12)
        | _points([
            ("email_visible", 4, "size(emails) > 0"), ("phone_visible", 3, "size(phones) > 0"), ("contact_path_detected", 2, "form_detected OR link_contact"), ("social_presence_visible", 1, "size(social_links) > 0"),
            ("social_cta_or_link_visible", 2, "size(platform_ctas) > 0"),
        ], "contact_availability", 10)
        | _points([
            ("ads_stack_detected", 4, "has_active_ads"), ("hiring_signal_detected", 3, "hiring_signals"), ("pricing_keywords_visible", 1, "priced_"), ("testimonials_visible", 1, "praised_"),
            ("portfolio_or_case_studies_visible", 1, "shown_"), ("social_offer_signal_detected", 2, "size(offer_signals) > 0"), ("budget_signal_match_detected", 1, "size(budget_matches) > 0"),
        ], "commercial_intent", 10)
        | _points([
            ("title_present", 1, "title <> ''"), ("meta_description_present", 1, "description <> ''"), ("minimum_content_detected", 1, "clean_len >= 300"), ("substantial_content_detected", 1, "clean_len >= 1200"),
            ("key_internal_page_detected", 1, "size(internal_links) >= 1"), ("multiple_key_pages_detected", 1, "size(internal_links) >= 2"), ("tech_stack_detected", 2, "size(inferred_tech_stack) > 0"),
            ("rich_tech_footprint_detected", 1, "size(inferred_tech_stack) >= 3"), ("social_presence_detected", 1, "size(social_links) > 0"), ("about_page_detected", 1, "link_about"),
            ("social_activity_detected", 2, "is_social_ AND size(activity_signals) > 0"), ("external_link_in_profile", 1, "is_social_ AND size(profile_links) > 0"),
        ], "digital_maturity", 10)
        | _points([
            ("target_niche_match", 5, "inferred_niche IS NOT NULL"), ("partial_niche_match", 3, "inferred_niche IS NULL AND trim(target_niche) <> '' AND niche_hits >= 2"),
            ("target_location_match", 2, f"trim(target_location) <> '' AND contains(search_f, {ascii_fold('trim(target_location)')})"), ("target_language_match", 1, "lower(trim(target_language)) = detected_hint"),
            ("budget_signal_keyword_match", 1, any_listed("target_budget_signals")), ("pain_point_keyword_match", 1, any_listed("target_pain_points")), ("offer_signal_match", 1, "size(offer_signals) > 0"), ("budget_signal_match", 1, "size(budget_matches) > 0"),
        ], "context_fit", 10)
        | _points([
            ("stack_detected", 2, "size(inferred_tech_stack) > 0"), ("seller_stack_matches_prospect_stack", 5, "arrays_overlap(wanted_f, stack_f)"), ("cms_or_builder_detected", 2, in_stack(BUILDERS)),
            ("marketing_or_conversion_stack_detected", 1, in_stack(MARKETING)),
        ], "stack_fit", 10)
    )
    df = df.withColumns(components)
    weighted = " + ".join(f"{name} * {w}D" for name, w in WEIGHTS.items())
    evidence = " + ".join(f"size({name}_evidence)" for name in WEIGHTS)
    strong = " + ".join(f"cast({name} >= 0.6D AS int)" for name in WEIGHTS)
    df = df.withColumns({"score": F.expr(even(weighted, 4)), "evidence_": F.expr(evidence), "strong_": F.expr(strong)})
    ranked = "slice(filter(array_sort(array(" + ", ".join(f"named_struct('s', -{name}, 'o', {i}, 'l', {quoted(LABELS[name])})" for i, name in enumerate(WEIGHTS)) + ")), x -> x.s <= -0.5D), 1, 2)"
    prefix = "CASE WHEN score >= 0.7D THEN 'Fit heuristico fuerte' WHEN score >= 0.45D THEN 'Fit heuristico moderado' ELSE 'Fit heuristico debil' END"
    booking = " OR ".join(f"contains(p, {quoted(h)})" for h in rules.BOOKING_PAINS)
    contactless = "size(emails) = 0 AND size(phones) = 0 AND NOT form_detected"
    signals = [
        ("No muestra contacto directo visible", contactless), ("No se detecta pagina o formulario de contacto", f"NOT ({contactless}) AND NOT link_contact AND NOT form_detected"),
        ("Meta description ausente", "coalesce(description, '') = ''"), ("Sin redes sociales visibles", "size(social_links) = 0"),
        ("Perfil social sin oferta comercial clara", "is_social_ AND size(offer_signals) = 0"), ("Perfil social sin CTA comercial visible", "is_social_ AND size(platform_ctas) = 0"),
        ("No muestra reservas online visibles", f"exists({_context_list('target_pain_points')}, p -> {booking}) AND NOT {any_in('text_f', rules.BOOKING)}"),
        ("No muestra prueba social visible", "clean_len >= 300 AND NOT (praised_ OR shown_)"),
        ("No se detectan herramientas visibles de analitica o marketing", "size(inferred_tech_stack) = 0"),
    ]
    df = df.withColumns({
        "confidence_level": F.expr(
            "CASE WHEN (clean_len >= 800 AND evidence_ >= 8 AND strong_ >= 3) OR (evidence_ >= 12 AND strong_ >= 4) THEN 'high'"
            " WHEN (clean_len >= 250 AND evidence_ >= 4 AND strong_ >= 1) OR (evidence_ >= 8 AND strong_ >= 2) THEN 'medium' ELSE 'low' END"),
        "estimated_revenue_signal": F.expr(
            "CASE WHEN has_active_ads AND (hiring_signals OR score >= 0.7D OR commercial_intent >= 0.7D) THEN 'high'"
            " WHEN has_active_ads OR hiring_signals OR score >= 0.45D OR commercial_intent >= 0.45D THEN 'medium' ELSE 'low' END"),
        "fit_summary": F.expr(f"CASE WHEN size({ranked}) > 0 THEN concat({prefix}, '; destacan ', array_join(transform({ranked}, x -> x.l), ', '), '.') ELSE concat({prefix}, '; evidencia local limitada.') END"),
        "observed_signals": F.expr("slice(array_compact(array(" + ", ".join(f"CASE WHEN {c} THEN {quoted(s)} END" for s, c in signals) + f")), 1, {MOST_SIGNALS})"),
    })
    lookup = "map(" + ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in OPPORTUNITIES.items()) + ")"
    df = df.withColumn("inferred_opportunities", F.expr(opportunities(f"transform(observed_signals, s -> element_at({lookup}, s))")))
    company = "coalesce(nullif(social_profile.display_name, ''), trim(substring_index(title, '|', 1)))"
    return df.withColumn("company_name", F.expr(company)).drop("evidence_", "strong_", "wanted_f", "stack_f", "niche_words", "niche_hits", "priced_", "praised_", "shown_", "text_f", "search_f", "profile_f")
