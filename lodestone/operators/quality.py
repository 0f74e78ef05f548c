"""Quality gate: language, geography, contact quality, size, business model, and the two decisions. Native expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import any_in, best_of, even, fold_trimmed, let, lower_padded, occurrences, quoted, strings
from ..rules import countries as geo
from ..rules import quality as rules

#: Fixed values.
POSTAL = r"(?i)\b[A-Z]{0,2}\d{4,6}[A-Z]{0,3}\b"
SPECIFIC = [" argentina", " madrid", " mexico", " méxico", " españa", " spain", " buenos aires", " valencia", " barcelona", " cdmx", " ciudad de mexico", " ciudad de méxico", " paris", " jal", " calle ", " avenida ", " av. ", " street ", " road ", " rd. ", " plaza ", " paseo ", " carrera ", " camino "]
DIRECTORIES, MEDIA, ARTICLES = ["directory", "aggregator", "marketplace"], ["media", "association"], ["blog_post"]


# ---- language ----


def detect_language(text: str, html_lang: str = "cast(NULL AS string)", locale: str = "cast(NULL AS string)", languages: dict = rules.LANGUAGES) -> str:
    """Declared language, else locale, else the language with most hint words if more than one. Accents count."""
    counted = let("padded", lower_padded(text), best_of({name: occurrences("padded", hints) for name, hints in languages.items()}, "1"))
    declared = f"nullif(lower(trim({html_lang})), '')"
    local = f"nullif(lower(trim({locale})), '')"
    return f"coalesce(split({declared}, '-')[0], split(split({local}, '_')[0], '-')[0], {counted})"


def language_match(target: str, detected: str) -> str:
    return f"CASE WHEN coalesce(lower(trim({target})), '') = '' OR coalesce(lower(trim({detected})), '') = '' THEN 'unknown' WHEN lower(trim({target})) = lower(trim({detected})) THEN 'match' ELSE 'mismatch' END"


# ---- geography ----


def _fold(word: str) -> str:
    import unicodedata

    return " ".join(unicodedata.normalize("NFKD", word).encode("ascii", "ignore").decode().lower().split())


def country_aliases() -> list[tuple[str, str]]:
    """(alias, display name), later rows winning, longest alias first."""
    found: dict[str, str] = {}
    for key, name, targets, codes, matches, _, _ in geo.COUNTRIES:
        for alias in [key, name, *targets, *matches, *codes]:
            if folded := _fold(alias):
                found[folded] = name
    return sorted(found.items(), key=lambda x: -len(x[0]))


def _looked_up(keys: list[str], values: list[str], key: str) -> str:
    """The value beside the first entry of keys that equals key, else null."""
    return f"get({strings(values)}, cast(array_position({strings(keys)}, {key}) AS int) - 1)"


def country_of(text: str) -> str:
    """Country named by a text: the whole text as alias or code, else the longest alias inside it."""
    aliases = country_aliases()
    keys, names = [a for a, _ in aliases], [n for _, n in aliases]
    inside = f"get(filter({strings(a for a in keys if len(a) > 2)}, a_ -> contains(concat(' ', place, ' '), concat(' ', a_, ' '))), 0)"
    return let("place", fold_trimmed(text), f"coalesce({_looked_up(keys, names, 'place')}, {let('found_', inside, _looked_up(keys, names, 'found_'))})")


def country_rule(target: str) -> str:
    """Key of the country that a target names, by alias or code."""
    words = [(_fold(a), key) for key, _, targets, codes, *_ in geo.COUNTRIES for a in [*targets, *codes]]
    return let("target_f", fold_trimmed(target), _looked_up([w for w, _ in words], [k for _, k in words], "target_f"))


def same_country(text: str, country: str) -> str:
    """Whether a text is a name or code of the country."""
    pairs = [f"{_fold(name)}|{_fold(a)}" for key, name, targets, codes, *_ in geo.COUNTRIES for a in [key, name, *targets, *codes]]
    return f"coalesce(array_contains({strings(pairs)}, concat({fold_trimmed(country)}, '|', {fold_trimmed(text)})), false)"


def sanitize(text: str) -> str:
    """Location text without URLs, separators as commas, at most 240 characters; null if nothing is left."""
    plain = f"regexp_replace(regexp_replace({text}, '(?i)https?://\\\\S+', ' '), '[\\\\n\\\\r\\\\t|;]+', ', ')"
    return f"nullif(substring(trim(BOTH ' ,.-' FROM regexp_replace({plain}, '\\\\s+', ' ')), 1, 240), '')"


def postal(text: str) -> str:
    return f"nullif(upper(regexp_extract({text}, {quoted(POSTAL)}, 0)), '')"


def _noise(c: str) -> str:
    f = "noise_f"
    letters = f"{c} rlike '[A-Za-zÁÉÍÓÚáéíóúÑñ]'"
    tests = f"({f} = '' OR contains({c}, '@') OR startswith(lower({c}), 'http://') OR startswith(lower({c}), 'https://') OR startswith(lower({c}), 'www.') OR {any_in(f, rules.LOCATION_NOISE)} OR (length(regexp_replace({c}, '[^0-9]', '')) >= 8 AND NOT {letters}))"
    return let("noise_f", fold_trimmed(c), tests)


def _street(c: str) -> str:
    return let("street_f", f"concat(' ', {fold_trimmed(c)}, ' ')", any_in("street_f", [f" {h} " for h in rules.STREETS]))


def parse_location(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """Adds prefix + raw, country, postal, city, region out of a free text."""
    raw, country = f"{prefix}raw", f"{prefix}country"
    df = df.withColumn(raw, F.expr(sanitize(text))).withColumns({country: F.expr(country_of(raw)), f"{prefix}postal": F.expr(postal(raw))})
    short = lambda x: f"substring(trim(regexp_replace({x}, '\\\\s+', ' ')), 1, 120)"
    chunks = f"filter(transform(split({raw}, '[,\\\\n]'), c -> {short('c')}), c -> c <> '' AND NOT {_noise('c')})"
    df = df.withColumn("chunks_", F.expr(f"coalesce({chunks}, cast(array() AS array<string>))"))
    df = df.withColumn(country, F.expr(f"coalesce({country}, get(array_compact(transform(chunks_, c -> {country_of('c')})), 0))"))
    bare = f"trim(BOTH ' ,.-' FROM trim(regexp_replace(regexp_replace(c, {quoted(POSTAL)}, ' '), '\\\\s+', ' ')))"
    own = f"{country} IS NOT NULL AND ({fold_trimmed('c')} = {fold_trimmed(country)} OR {same_country('c', country)})"
    df = df.withColumn("places_", F.expr(f"filter(filter(transform(chunks_, c -> {bare}), c -> c <> ''), c -> NOT coalesce({own}, false))"))
    df = df.withColumn("pick_", F.expr(f"CASE WHEN exists(places_, c -> NOT {_street('c')}) THEN filter(places_, c -> NOT {_street('c')}) ELSE places_ END"))
    city, region = "try_element_at(pick_, -1)", "try_element_at(pick_, -2)"
    return df.withColumns({f"{prefix}city": F.expr(city), f"{prefix}region": F.expr(f"CASE WHEN {fold_trimmed(region)} <> {fold_trimmed(city)} THEN {region} END")}).drop("chunks_", "places_", "pick_")


def format_location(city: str, region: str, country: str, code: str) -> str:
    """postal city, region, country without repeats, at most 160 characters; null if empty."""
    f = fold_trimmed
    place = f"nullif(concat_ws(' ', {code}, {city}), '')"
    shown_region = f"CASE WHEN {f(region)} NOT IN ({f(f'coalesce({place}, {quoted(chr(0))})')}, {f(f'coalesce({country}, {quoted(chr(0))})')}) THEN {region} END"
    shown_country = f"CASE WHEN {f(country)} NOT IN ({f(f'coalesce({place}, {quoted(chr(0))})')}, coalesce({f(shown_region)}, '')) THEN {country} END"
    return f"nullif(substring(concat_ws(', ', {place}, {shown_region}, {shown_country}), 1, 160), '')"


def geo_evidence(df: DataFrame) -> DataFrame:
    """Adds geo_evidence, an ordered array of (source, value), and country_key of the target."""
    listed = lambda column, source: f"transform(coalesce({column}, cast(array() AS array<string>)), v -> named_struct('source', '{source}', 'value', v))"
    one = lambda value, source: f"CASE WHEN {value} <> '' THEN array(named_struct('source', '{source}', 'value', {value})) ELSE cast(array() AS array<struct<source:string,value:string>>) END"
    df = df.withColumn("country_key", F.expr(country_rule("target_location")))
    name = "CASE country_key " + " ".join(f"WHEN {quoted(k)} THEN {quoted(n)}" for k, n, *_ in geo.COUNTRIES) + " END"
    site = urls.host("coalesce(website_url, '')")
    tld = "CASE country_key " + " ".join(f"WHEN {quoted(k)} THEN {' OR '.join(f'endswith({site}, {quoted(t)})' for t in tlds)}" for k, _, _, _, _, tlds, _ in geo.COUNTRIES) + " END"
    call = "CASE country_key " + " ".join(f"WHEN {quoted(k)} THEN {' OR '.join(f'startswith(p, {quoted(t)})' for t in prefixes)}" for k, *_, prefixes in geo.COUNTRIES) + " END"
    raw_country = "get_json_object(j, '$.address.addressCountry')"
    countries = f"transform(filter(structured_data, j -> {raw_country} <> ''), j -> coalesce({country_of(raw_country)}, {fold_trimmed(raw_country)}))"
    return df.withColumn("geo_evidence", F.expr(
        f"concat({listed('addresses', 'address')}, {listed('map_links', 'map')}, {listed('area_served', 'area_served')}, {listed(countries, 'postal_address_country')},"
        f" CASE WHEN coalesce({tld}, false) THEN array(named_struct('source', 'tld', 'value', {name})) ELSE cast(array() AS array<struct<source:string,value:string>>) END,"
        f" transform(filter(phones, p -> coalesce({call}, false)), p -> named_struct('source', 'phone_prefix', 'value', {name})),"
        f" {one('title', 'title')}, {one('description', 'description')}, {one('discovery_title', 'discovery_title')}, {one('discovery_snippet', 'discovery_snippet')})"
    ))


def assess_location(df: DataFrame) -> DataFrame:
    """Adds location, its parts, validated_location, location_match_status and location_confidence."""
    df = geo_evidence(df)
    strong, medium = strings(rules.STRONG_SOURCES), strings(rules.MEDIUM_SOURCES)
    raw = "coalesce(get(addresses, 0), get(filter(geo_evidence, e -> e.source IN ('address', 'area_served', 'postal_address_country')), 0).value)"
    df = parse_location(df.withColumn("raw_in", F.expr(raw)), "raw_in", "r_")
    hint = "get(filter(geo_evidence, e -> e.source IN ('area_served', 'postal_address_country', 'tld', 'phone_prefix')), 0).value"
    df = parse_location(df.withColumn("hint_in", F.expr(hint)), "hint_in", "h_")
    node = "get(filter(structured_data, j -> startswith(get_json_object(j, '$.address'), '{')), 0)"
    part = lambda k: f"nullif(trim(get_json_object({node}, '$.address.{k}')), '')"
    df = df.withColumns({
        "city": F.expr(f"coalesce({part('addressLocality')}, r_city, h_city)"), "region": F.expr(f"coalesce({part('addressRegion')}, r_region, h_region)"),
        "country": F.expr(f"coalesce({country_of(part('addressCountry'))}, {part('addressCountry')}, r_country, h_country)"), "postal_code": F.expr(f"coalesce({postal(part('postalCode'))}, r_postal, h_postal)"),
        "raw_location_text": F.col("r_raw"),
    })
    df = df.withColumn("location", F.expr(format_location("city", "region", "country", "postal_code")))
    target = fold_trimmed("target_location")
    aliases = "CASE country_key " + " ".join(f"WHEN {quoted(k)} THEN {strings(dict.fromkeys(_fold(a) for a in [*matches, *targets]))}" for k, _, targets, _, matches, _, _ in geo.COUNTRIES) + " ELSE cast(array() AS array<string>) END"
    value = fold_trimmed("e.value")
    matches = f"(({target} <> '' AND contains(concat(' ', {value}, ' '), concat(' ', {target}, ' '))) OR exists({aliases}, a -> contains(concat(' ', {value}, ' '), concat(' ', a, ' '))))"
    df = df.withColumn("hit_", F.expr(f"get(filter(geo_evidence, e -> {matches}), 0)"))
    long = "trim(regexp_replace(e.value, '\\\\s+', ' '))"
    specific = f"length({long}) BETWEEN 6 AND 180 AND ({long} rlike '[0-9]' OR {any_in(f'concat({quoted(chr(32))}, lower({long}), {quoted(chr(32))})', SPECIFIC)})"
    best = f"CASE WHEN exists(geo_evidence, e -> array_contains({strong}, e.source)) THEN 'high' WHEN exists(geo_evidence, e -> array_contains({medium}, e.source)) OR location IS NOT NULL THEN 'medium' ELSE 'low' END"
    wanted = "coalesce(target_location, '') <> ''"
    df = df.withColumn("located_", F.expr(f"exists(geo_evidence, e -> array_contains({strong}, e.source) AND {specific})"))
    return df.withColumns({
        "location_match_status": F.expr(f"CASE WHEN NOT ({wanted}) THEN 'unknown' WHEN hit_ IS NOT NULL THEN 'match' WHEN located_ THEN 'mismatch' ELSE 'unknown' END"),
        "location_confidence": F.expr(f"CASE WHEN {wanted} AND hit_ IS NOT NULL THEN CASE WHEN array_contains({strong}, hit_.source) THEN 'high' ELSE 'medium' END ELSE {best} END"),
        "validated_location": F.expr(f"CASE WHEN {wanted} AND hit_ IS NOT NULL THEN coalesce(location, substring(hit_.value, 1, 160)) WHEN {wanted} AND located_ THEN location END"),
    }).drop("raw_in", "hint_in", "hit_", "located_", *(f"{p}{c}" for p in ("r_", "h_") for c in ("raw", "country", "postal", "city", "region")))


# ---- contacts ----


def contact_quality(df: DataFrame) -> DataFrame:
    """Primary email and phone, their confidence, consistency with the site and a score, out of ordered contact_channels.

    A set form of a first-wins loop: the primary email is the first of the highest rank, where rank is 3 on the site's own
    domain, 2 on a generic one or without a site, 1 elsewhere; the phone is the first of the highest confidence.
    """
    site = urls.registered(urls.host("coalesce(website_url, '')"), rules.SECOND_LEVEL)
    base = "CASE lower(trim(c.source)) " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in rules.SOURCE_CONFIDENCE.items()) + " ELSE 'medium' END"
    df = df.withColumn("site_root", F.expr(site))
    mail = "lower(substring_index(trim(c.value), '@', -1))"
    mail = f"CASE WHEN contains(c.value, '@') THEN {mail} ELSE '' END"
    own = f"({mail} <> '' AND ({mail} = site_root OR endswith({mail}, concat('.', site_root))))"
    relation = f"CASE WHEN site_root = '' THEN 'unknown_site_domain' WHEN {own} THEN 'same_business_domain' WHEN {mail} IN ({', '.join(map(quoted, rules.GENERIC_MAIL))}) THEN 'generic_domain' ELSE 'external_domain' END"
    mails = f"transform(filter(contact_channels, c -> c.type = 'email' AND trim(c.value) <> ''), c -> named_struct('value', trim(c.value), 'source', lower(c.source), 'base', {base}, 'relation', {relation}))"
    rank = "CASE m.relation WHEN 'same_business_domain' THEN 3 WHEN 'external_domain' THEN 1 ELSE 2 END"
    conf = "CASE m.relation WHEN 'same_business_domain' THEN CASE WHEN m.base = 'medium' THEN 'high' ELSE m.base END WHEN 'external_domain' THEN 'low' ELSE m.base END"
    df = df.withColumn("mails_", F.expr(f"transform({mails}, (m, i) -> named_struct('rank', {rank}, 'i', -i, 'value', m.value, 'source', m.source, 'relation', m.relation, 'confidence', {conf}))"))
    phone_conf = f"CASE WHEN startswith(trim(c.value), '+') AND {base} = 'medium' THEN 'high' ELSE {base} END"
    level = "CASE {x} WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"
    df = df.withColumn("phones_", F.expr(f"transform(filter(contact_channels, c -> c.type = 'phone' AND trim(c.value) <> ''), (c, i) -> named_struct('level', {level.format(x=phone_conf)}, 'i', -i, 'value', trim(c.value), 'source', lower(c.source), 'confidence', {phone_conf}))"))
    df = df.withColumns({"mail_": F.expr("array_max(mails_)"), "phone_": F.expr("array_max(filter(phones_, p -> p.level > 1))")})
    # what gave the first way to get in touch, in channel order; an email of a higher rank takes over
    other = (
        "get(filter(contact_channels, c -> trim(c.value) <> '' AND (c.type IN ('contact_form', 'whatsapp', 'booking')"
        f" OR (c.type = 'phone' AND {level.format(x=phone_conf)} > 1))), 0)"
    )
    named = "concat(CASE o.type WHEN 'contact_form' THEN 'form' ELSE o.type END, ':', lower(o.source))"
    value = lambda c: f"CASE {c} WHEN 'high' THEN 0.9D WHEN 'medium' THEN 0.65D ELSE 0.35D END"
    df = df.withColumns({
        "primary_email": F.expr("CASE WHEN mail_.relation <> 'external_domain' THEN mail_.value END"), "primary_phone": F.expr("phone_.value"),
        "primary_email_confidence": F.expr("CASE WHEN mail_.relation <> 'external_domain' THEN mail_.confidence ELSE 'low' END"), "primary_phone_confidence": F.expr("coalesce(phone_.confidence, 'low')"),
        "contact_consistency_status": F.expr("CASE mail_.relation WHEN 'same_business_domain' THEN 'consistent' WHEN 'external_domain' THEN 'inconsistent' ELSE 'unknown' END"),
        "other_": F.expr(f"get(transform(array_compact(array({other})), o -> {named}), 0)"),
    })
    score = (
        f"CASE WHEN primary_email IS NOT NULL THEN 0.35D * {value('primary_email_confidence')} ELSE 0D END + CASE WHEN primary_phone IS NOT NULL THEN 0.25D * {value('primary_phone_confidence')} ELSE 0D END"
        " + CASE WHEN form_detected THEN 0.15D ELSE 0D END + CASE WHEN whatsapp_url <> '' THEN 0.1D ELSE 0D END + CASE WHEN booking_url <> '' THEN 0.1D ELSE 0D END + CASE WHEN size(social_profile.external_links) > 0 THEN 0.1D ELSE 0D END"
    )
    return df.withColumns({
        "contact_quality_score": F.expr(even(f"least({score}, 1D)", 4)),
        "primary_contact_source": F.expr("CASE WHEN primary_email IS NOT NULL THEN concat('email:', mail_.source) ELSE other_ END"),
    }).drop("site_root", "mails_", "phones_", "mail_", "phone_", "other_")


def company_size(hiring: str = "hiring_signals", score: str = "score") -> str:
    team = f"exists(internal_links, l -> {any_in('lower(l)', ['equipo', 'team'])})"
    return f"CASE WHEN coalesce({hiring}, false) OR size(addresses) >= 2 THEN 'medium' WHEN {team} OR size(social_links) >= 2 THEN 'small' WHEN coalesce({score}, 0D) <= 0.25D AND NOT form_detected AND size(social_links) <= 1 THEN 'solo' ELSE 'unknown' END"


def service_keywords(rows: DataFrame, key: str, text: str, most: int = 5, stopwords: list[str] = rules.STOPWORDS) -> DataFrame:
    """(key, rank, token, n): the most frequent words of four letters or more, ties by spelling. Counted before the shuffle."""
    from pyspark.sql import Window

    word = "[a-zA-ZáéíóúñÁÉÍÓÚÑ]{4,}"
    tokens = rows.select(key, F.explode(F.expr(f"regexp_extract_all(lower({text}), '{word}', 0)")).alias("token")).where(~F.col("token").isin(stopwords))
    counted = tokens.groupBy(key, "token").agg(F.count("*").alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "token"))).where(F.col("rank") <= most).select(key, "rank", "token", "n")


def keywords_of(text: str, most: int = 5, stopwords: list[str] = rules.STOPWORDS) -> str:
    """The same as one array per row, without a shuffle."""
    # IN looks a word up in a set, and sort_array, unlike array_sort, compares without an expression
    tokens = f"filter(regexp_extract_all(lower({text}), '[a-zA-ZáéíóúñÁÉÍÓÚÑ]{{4,}}', 0), t -> {f"NOT t IN ({', '.join(map(quoted, stopwords))})" if stopwords else 'true'})"
    # equal words stand together once sorted, so the distances between the ends of runs are counts
    ends = "filter(sequence(0, size(words) - 1), i -> i = size(words) - 1 OR words[i] <> words[i + 1])"
    counted = "sort_array(transform(ends, (x, k) -> named_struct('n', CASE WHEN k = 0 THEN -1 ELSE ends[k - 1] END - x, 't', words[x])))"
    top = f"transform(slice({counted}, 1, {most}), c -> c.t)"
    return let("words", f"sort_array({tokens})", f"CASE WHEN size(words) = 0 THEN cast(array() AS array<string>) ELSE {let('ends', ends, top)} END")


# ---- business model and decisions ----


def target_models(niche: str, focus: str) -> str:
    text = f"lower(concat_ws(' ', coalesce({niche}, ''), coalesce({focus}, '')))"
    return f"array_compact(array(CASE WHEN {any_in(text, rules.TARGET_ECOMMERCE)} THEN 'ecommerce_business' END, CASE WHEN {any_in(text, rules.TARGET_EDUCATION)} THEN 'education_business' END))"


def observed_model(text: str, entity: str, provider: list = rules.SERVICE_PROVIDER, product: list = rules.PRODUCT_PAGE, education: list = rules.EDUCATION, shop: list = rules.ECOMMERCE) -> str:
    return f"CASE WHEN lower(trim({entity})) IN ('consultant', 'agency') OR {any_in(text, provider)} THEN 'service_provider' WHEN {any_in(text, product)} THEN 'product_page' WHEN {any_in(text, education)} THEN 'education_business' WHEN {any_in(text, shop)} THEN 'ecommerce_business' END"


def model_fit(targets: str, observed: str) -> str:
    return f"CASE WHEN size({targets}) = 0 THEN 'unknown' WHEN array_contains({targets}, {observed}) THEN 'match' WHEN {observed} IN ('service_provider', 'product_page') THEN 'mismatch' ELSE 'unknown' END"


def gate(df: DataFrame) -> DataFrame:
    """Adds quality_status, rejection_reason, quality_flag and technical_multiplier: ordered gates, the first that applies.

    Input: has_target_location, score, confidence_level, location_match_status, language_match_status, contact_quality_score,
    contact_consistency_status, primary_email_confidence, primary_phone_confidence, primary_identity_type, social_evidence.
    """
    social = "lower(trim(coalesce(primary_identity_type, ''))) = 'social_profile'"
    weak = "primary_email_confidence = 'low' AND primary_phone_confidence = 'low' AND contact_quality_score < 0.3D"
    gates = [
        ("has_target_location AND location_match_status = 'mismatch'", "rejected", "geo_mismatch", "geo_mismatch", 0.35),
        ("has_target_location AND location_match_status = 'unknown' AND score < 0.45D", "rejected", "geo_unknown_low_score", "geo_unknown", 0.8),
        ("has_target_location AND location_match_status = 'unknown'", "needs_review", "geo_unknown", "geo_unknown", 0.9),
        ("language_match_status = 'mismatch' AND score < 0.6D", "rejected", "language_mismatch", "language_mismatch", 0.75),
        ("language_match_status = 'mismatch'", "needs_review", "language_mismatch", "language_mismatch", 0.75),
        ("contact_consistency_status = 'inconsistent' AND primary_phone_confidence = 'low' AND contact_quality_score < 0.15D", "rejected", "contact_inconsistent", "contact_inconsistent", 0.55),
        ("contact_consistency_status = 'inconsistent'", "needs_review", "contact_inconsistent", "contact_inconsistent", 0.75),
        (f"{social} AND social_evidence < 2", "needs_review", "rejected_social_low_evidence", "weak_social_business_evidence", 0.75),
        (f"{weak} AND {social}", "accepted", None, "social_first_low_direct_contact", 0.9),
        (weak, "rejected", "low_contact_quality", "weak_primary_contact", 0.7),
        ("contact_quality_score < 0.25D AND confidence_level = 'low'", "rejected", "low_contact_quality", "weak_contactability", 0.75),
    ]
    text = lambda v: "cast(NULL AS string)" if v is None else quoted(v)
    whens = " ".join(f"WHEN {c} THEN named_struct('status', {text(s)}, 'reason', {text(r)}, 'flag', {text(f)}, 'mult', {m}D)" for c, s, r, f, m in gates)
    verdict = f"CASE {whens} ELSE named_struct('status', 'accepted', 'reason', cast(NULL AS string), 'flag', cast(NULL AS string), 'mult', 1D) END"
    df = df.withColumn("gate_", F.expr(verdict))
    return df.withColumns({"quality_status": F.expr("gate_.status"), "rejection_reason": F.expr("gate_.reason"), "quality_flag": F.expr("gate_.flag"), "technical_multiplier": F.expr("gate_.mult")}).drop("gate_")


def decide(df: DataFrame) -> DataFrame:
    """Adds acceptance_decision, commercial_multiplier and score_cap.

    Input: quality_status, rejection_reason, entity_type_detected, entity_type_confidence, is_target_entity, score, target_niche,
    context_fit, business_model_fit_status, primary_identity_type, social_evidence.
    """
    kind = "lower(trim(coalesce(entity_type_detected, 'unknown')))"
    listed = lambda xs: ", ".join(map(quoted, xs))
    social = "lower(trim(coalesce(primary_identity_type, ''))) = 'social_profile'"
    niche, clash = "coalesce(trim(target_niche), '') <> ''", "lower(trim(coalesce(business_model_fit_status, 'unknown'))) = 'mismatch'"
    fit = "greatest(0D, least(coalesce(context_fit, 0D), 1D))"
    good, target = "quality_status = 'accepted'", "coalesce(is_target_entity, false)"
    known = "lower(trim(coalesce(entity_type_confidence, 'low'))) IN ('medium', 'high')"
    steps = [
        (f"{kind} IN ({listed(DIRECTORIES)})", "rejected_directory", 0.2, 0.25), (f"{kind} IN ({listed(MEDIA)})", "rejected_media", 0.25, 0.3), (f"{kind} IN ({listed(ARTICLES)})", "rejected_article", 0.15, 0.2),
        (f"{social} AND {good} AND {target} AND social_evidence >= 2 AND {niche} AND {clash}", "accepted_related", 0.55, 0.6), (f"{social} AND {good} AND {target} AND social_evidence >= 2", "accepted_target", 1.0, None),
        (f"{social} AND quality_status = 'needs_review'", "rejected_low_confidence", 0.5, 0.5), (f"{good} AND {target} AND {niche} AND {clash}", "accepted_related", 0.5, 0.55),
        (f"{good} AND {target} AND {niche} AND {fit} < 0.3D", "accepted_related", 0.65, 0.65), (f"{good} AND {target}", "accepted_target", 1.0, None),
        (f"{good} AND {kind} = 'unknown' AND score >= 0.55D AND {known}", "accepted_related", 0.75, 0.7), (f"{good} AND {kind} = 'unknown'", "rejected_low_confidence", 0.45, 0.45),
        (good, "accepted_related", 0.7, 0.65), ("rejection_reason = 'low_contact_quality'", "rejected_low_confidence", 0.5, 0.45), ("quality_status = 'needs_review'", "rejected_low_confidence", 0.55, 0.5),
    ]
    cap = lambda c: "cast(NULL AS double)" if c is None else f"{c}D"
    whens = " ".join(f"WHEN {c} THEN named_struct('d', '{d}', 'm', {m}D, 'c', {cap(k)})" for c, d, m, k in steps)
    df = df.withColumn("step_", F.expr(f"CASE {whens} ELSE named_struct('d', 'rejected_low_confidence', 'm', 0.45D, 'c', 0.4D) END"))
    return df.withColumns({"acceptance_decision": F.expr("step_.d"), "commercial_multiplier": F.expr("step_.m"), "score_cap": F.expr("step_.c")}).drop("step_")


def needs_model(score: str = "score", confidence: str = "confidence_level") -> str:
    """Why a page is or isn't sent to the language model; ai_required if it is."""
    return (
        "CASE WHEN quality_status = 'rejected' THEN 'quality_rejected' WHEN startswith(lower(acceptance_decision), 'rejected_') THEN 'commercial_rejected'"
        f" WHEN lower(acceptance_decision) = 'accepted_related' THEN 'commercial_related_only' WHEN {confidence} = 'high' AND quality_status = 'accepted' AND {score} >= 0.7D THEN 'heuristic_high_confidence'"
        f" WHEN {confidence} = 'high' AND {score} <= 0.2D THEN 'low_value_heuristic' ELSE 'ai_required' END"
    )


def signature(domain: str, text: str, version: str) -> str:
    return f"sha2(concat_ws('|', {domain}, {version}, {text}), 256)"


def social_evidence() -> str:
    return (
        "cast(size(offer_signals) > 0 AS int) + cast(size(platform_ctas) > 0 OR size(profile_links) > 0 AS int) + cast(whatsapp_url IS NOT NULL OR size(emails) > 0 OR size(phones) > 0 AS int)"
        " + cast(location_match_status = 'match' OR language_match_status = 'match' AS int) + cast(size(audience_signals) > 0 OR size(activity_signals) > 0 AS int)"
    )


def evaluate(df: DataFrame) -> DataFrame:
    """The whole gate over pages with metadata, features and entity columns."""
    df = assess_location(contact_quality(df))
    text = "lower(concat_ws(' ', substring(clean_text, 1, 2400), coalesce(title, ''), coalesce(description, ''), array_join(slice(internal_links, 1, 8), ' '), coalesce(website_url, '')))"
    df = df.withColumns({
        "detected_language": F.expr(detect_language("clean_text", "html_lang", "meta_locale")), "company_size_signal": F.expr(company_size()), "service_keywords": F.expr(keywords_of("clean_text")),
        "target_business_models": F.expr(target_models("target_niche", "user_target_offer_focus")), "observed_business_model": F.expr(let("model_text", text, observed_model("model_text", "entity_type_detected"))),
        "has_target_location": F.expr("coalesce(trim(target_location), '') <> ''"),
    })
    df = df.withColumns({"language_match_status": F.expr(language_match("target_language", "detected_language")), "business_model_fit_status": F.expr(model_fit("target_business_models", "observed_business_model"))})
    df = decide(gate(df.withColumn("social_evidence", F.expr(social_evidence()))))
    return df.withColumns({
        "score_multiplier": F.expr(even("technical_multiplier * commercial_multiplier", 4)), "ai_gate": F.expr(needs_model()),
        "quality_flags": F.expr("array_compact(array(quality_flag, CASE WHEN is_target_entity = false THEN 'non_target_entity' END))"),
    }).drop("quality_flag")
