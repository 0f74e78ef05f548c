"""Page metadata out of the raw parts: links, contacts, calls to action, structured data, social profiles.

Native expressions over arrays; nothing leaves the row, so there is no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import contacts, urls
from ..functions.text import any_in, collapse, first_of_each, quoted
from ..rules import pages as rules

#: Fixed values. The street pattern without look-behind, so that it reads the same in other engines.
ADDRESS = r"(?i)(?:^|[^a-z])((?:calle|av(?:\.|enida)?|street|st\.|road|rd\.|plaza|paseo|carrera|camino)\s+[^|]{8,120})"
NODE_SCHEMA = "array<struct<`@type`:string,address:string,areaServed:string,telephone:string,phone:string,email:string,openingHours:string,openingHoursSpecification:string>>"
MOST_ADDRESSES, MOST_HOURS, MOST_LINKS = 5, 7, 5


def page_kind(url: str) -> str:
    return urls.page_kind(url, urls.PARSED_KINDS)


def call_to_action(blob: str) -> str:
    """First kind, in order of the dictionary, whose words the text contains."""
    whens = " ".join(f"WHEN {any_in(blob, words)} THEN {quoted(kind)}" for kind, words in rules.CALLS_TO_ACTION.items())
    return f"CASE {whens} END"


def platform(url: str) -> str:
    whens = " ".join(f"WHEN {any_in(f'lower({url})', hosts)} THEN {quoted(name)}" for name, hosts in rules.PLATFORMS.items())
    return f"CASE {whens} END"


def handle(url: str) -> str:
    """Handle of a social URL: its first path segment, with the platforms' own rules."""
    first = f"get({urls.segments(url)}, 0)"
    plain = f"CASE WHEN {first} rlike '^@?[A-Za-z0-9._]{{2,64}}$' THEN ltrim('@', {first}) END"
    return (
        f"CASE {platform(url)} WHEN 'tiktok' THEN CASE WHEN startswith({first}, '@') AND substring({first}, 2) rlike '^@?[A-Za-z0-9._]{{2,64}}$' THEN ltrim('@', {first}) END"
        f" WHEN 'instagram' THEN CASE WHEN {first} NOT IN ('p', 'reel', 'reels', 'explore') THEN {plain} END ELSE CASE WHEN {platform(url)} IS NOT NULL THEN {plain} END END"
    )


def social_profile(url: str, primary: str) -> str:
    h = handle(url)
    return (
        f"CASE WHEN {platform(url)} IS NOT NULL THEN named_struct('platform', {platform(url)}, 'url', {url}, 'handle', {h}, 'is_primary', {primary},"
        f" 'profile_kind', CASE WHEN {h} IS NULL THEN 'other' ELSE 'profile' END, 'contact_signals', cast(array() AS array<string>),"
        f" 'activity_signals', cast(array() AS array<string>), 'confidence', CASE WHEN {h} IS NULL THEN 'low' ELSE 'high' END) END"
    )


def unique(values: str, limit: int) -> str:
    """Collapsed, non-empty, distinct, in order, at most limit."""
    return f"slice(array_distinct(filter(transform(array_compact({values}), v -> {collapse('v')}), v -> v <> '')), 1, {limit})"


def addresses_in(text: str) -> str:
    places = any_in("lower(m)", rules.ADDRESS_PLACES)
    return f"filter(transform(regexp_extract_all({text}, {quoted(ADDRESS)}, 1), m -> {collapse('m')}), m -> m rlike '[0-9]' OR {places})"


def _nodes(df: DataFrame) -> DataFrame:
    """Structured nodes, kept by keys and type."""
    kept = " OR ".join(f"get_json_object(j, '$.{k}') IS NOT NULL" for k in ("@type", "address", "areaServed", "telephone", "email"))
    kind = "lower(coalesce(get_json_object(j, '$.@type'), ''))"
    types = ", ".join(quoted(t) for t in rules.NODE_TYPES)
    return df.withColumn("structured_data", F.expr(f"filter(json_ld, j -> ({kept}) AND ({kind} = '' OR {kind} IN ({types})))"))


def parse(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Metadata of pages out of read_pages(): one row per page, with the columns to keep."""
    ref = any_in("lower(concat(coalesce(url, ''), ' ', title, ' ', description))", rules.REFERENCE_PAGES)
    df = _nodes(raw).withColumns({"reference": F.expr(ref), "primary_profile": F.expr(social_profile("url", "true"))})
    field = lambda k: f"get_json_object(j, '$.{k}')"
    parts = ", ".join(f"nullif(trim({field('address.' + k)}), '')" for k in ("streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry"))
    address = f"CASE WHEN startswith({field('address')}, '{{') THEN nullif(concat_ws(', ', {parts}), '') ELSE {field('address')} END"
    names = lambda x: f"CASE WHEN startswith({x}, '{{') THEN get_json_object({x}, '$.name') ELSE {x} END"
    served = f"CASE WHEN startswith({field('areaServed')}, '[') THEN transform(from_json({field('areaServed')}, 'array<string>'), s -> {names('s')}) ELSE array({names(field('areaServed'))}) END"
    hours = f"coalesce({field('openingHours')}, {field('openingHoursSpecification')})"
    hours = f"CASE WHEN startswith({hours}, '[') THEN from_json({hours}, 'array<string>') ELSE array({hours}) END"
    df = df.withColumns({
        "area_served": F.expr(f"array_compact(flatten(transform(structured_data, j -> {served})))"),
        "node_addresses": F.expr(unique(f"flatten(transform(structured_data, j -> concat(array({address}), {served})))", MOST_ADDRESSES)),
        "opening_hours": F.expr(unique(f"flatten(transform(structured_data, j -> {hours}))", MOST_HOURS)),
        "node_phones": F.expr(contacts.judged_phones(f"array_compact(flatten(transform(structured_data, j -> array({field('telephone')}, {field('phone')}))))")),
        "node_emails": F.expr(f"array_distinct(array_compact(transform(structured_data, j -> {contacts.email(field('email'))})))"),
        # links by kind; mail and phone links go no further, social links neither after the messenger test
        "mail_links": F.expr(f"filter(transform(filter(anchors, a -> startswith(lower(a.href), 'mailto:')), a -> named_struct('i', a.ordinal, 'v', {contacts.email("substring_index(substring(a.href, 8), '?', 1)")})), x -> x.v IS NOT NULL)"),
        "tel_links": F.expr(f"zip_with(filter(anchors, a -> startswith(lower(a.href), 'tel:')), {contacts.judged_phones("transform(filter(anchors, a -> startswith(lower(a.href), 'tel:')), a -> substring(a.href, 5))")}, (a, p) -> named_struct('i', a.ordinal, 'n', p.n, 'reason', p.reason))"),
        "rest": F.expr("filter(anchors, a -> NOT startswith(lower(a.href), 'mailto:') AND NOT startswith(lower(a.href), 'tel:'))"),
    })
    social_hosts = [h for hosts in rules.PLATFORMS.values() for h in hosts]
    df = df.withColumns({
        "messengers": F.expr("transform(filter(rest, a -> contains(lower(a.href), 'wa.me') OR contains(lower(a.href), 'whatsapp')), a -> named_struct('i', a.ordinal, 'v', coalesce(a.url, a.href)))"),
        "social": F.expr(f"filter(rest, a -> {any_in('lower(a.href)', social_hosts)} AND a.url IS NOT NULL)"),
        "plain": F.expr(f"filter(rest, a -> NOT {any_in('lower(a.href)', social_hosts)} AND a.url IS NOT NULL)"),
    })
    same = f"({urls.host('url')} <> '' AND {urls.host('a.url')} = {urls.host('url')})"
    df = df.withColumns({
        "map_links": F.expr(f"array_sort(array_distinct(transform(filter(plain, a -> {any_in('lower(a.href)', ['google.com/maps', 'maps.app.goo.gl', 'goo.gl/maps'])}), a -> a.url)))"),
        "inner": F.expr(f"transform(filter(plain, a -> {same}), a -> named_struct('url', a.url, 'kind', {page_kind('a.url')}, 'key', {any_in('lower(a.label)', rules.KEY_LINKS)} OR {any_in('lower(a.href)', rules.KEY_LINKS)}))"),
        "external_links": F.expr(f"array_sort(array_distinct(transform(filter(plain, a -> NOT {same} AND startswith(a.url, 'http')), a -> a.url)))"),
    })
    first = lambda kind, extra="true": f"get(filter(inner, l -> l.kind = '{kind}' AND {extra}), 0).url"
    ctas = f"array_distinct(array_compact(transform(concat(transform(anchors, a -> named_struct('label', a.label, 'href', a.href)), buttons), b -> {call_to_action("lower(concat(b.label, ' ', b.href))")})))"
    df = df.withColumns({
        "internal_links": F.expr("array_sort(array_distinct(transform(filter(inner, l -> l.kind <> 'other' OR l.key), l -> l.url)))"),
        "booking_url": F.expr(f"CASE WHEN NOT reference THEN {first('booking')} END"), "pricing_page_url": F.expr(first("pricing")), "service_page_url": F.expr(first("services")),
        "whatsapp_url": F.expr("try_element_at(messengers, -1).v"),
        "social_links": F.expr("array_sort(array_distinct(transform(social, a -> a.url)))"),
        "cta_candidates": F.expr(f"filter({ctas}, c -> NOT (reference AND c = 'booking'))"),
        "seen_phones": F.expr(contacts.judged_phones(contacts.extract_phones("clean_text"))),
        "seen_emails": F.expr(f"array_compact(transform({contacts.extract_emails('clean_text')}, e -> {contacts.email('e')}))"),
    })
    good = lambda c: f"transform(filter({c}, p -> p.reason IS NULL), p -> p.n)"
    reasons = "concat(transform(node_phones, p -> p.reason), transform(tel_links, p -> p.reason), transform(seen_phones, p -> p.reason))"
    df = df.withColumns({
        "emails": F.expr("array_sort(array_distinct(concat(node_emails, transform(mail_links, m -> m.v), seen_emails)))"),
        "phones": F.expr(f"array_sort(array_distinct(concat({good('node_phones')}, {good('tel_links')}, {good('seen_phones')})))"),
        "addresses": F.expr(unique(f"concat(node_addresses, {addresses_in('clean_text')})", MOST_ADDRESSES)),
        "reasons_": F.expr(reasons),
        "primary_cta": F.expr("get(cta_candidates, 0)"),
    })
    channel = lambda kind, value, source: f"named_struct('type', '{kind}', 'value', {value}, 'source', '{source}')"
    linked = "array_sort(concat(" + ", ".join([
        "transform(mail_links, m -> named_struct('i', m.i, 'type', 'email', 'value', m.v, 'source', 'mailto_link'))",
        "transform(filter(tel_links, t -> t.reason IS NULL), t -> named_struct('i', t.i, 'type', 'phone', 'value', t.n, 'source', 'tel_link'))",
        "transform(messengers, m -> named_struct('i', m.i, 'type', 'whatsapp', 'value', m.v, 'source', 'whatsapp_link'))",
    ]) + "))"
    channels = "concat(" + ", ".join([
        f"transform(array_distinct({good('node_phones')}), v -> {channel('phone', 'v', 'structured_data')})", f"transform(node_emails, v -> {channel('email', 'v', 'structured_data')})",
        f"transform({linked}, l -> named_struct('type', l.type, 'value', {collapse('l.value')}, 'source', l.source))",
        f"transform(phones, v -> {channel('phone', 'v', 'visible_text')})", f"transform(emails, v -> {channel('email', 'v', 'visible_text')})",
        f"CASE WHEN form_detected THEN array({channel('contact_form', 'url', 'html_form')}) ELSE cast(array() AS array<struct<type:string,value:string,source:string>>) END",
        f"CASE WHEN booking_url IS NOT NULL THEN array({channel('booking', 'booking_url', 'booking_link')}) ELSE cast(array() AS array<struct<type:string,value:string,source:string>>) END",
    ]) + ")"
    df = df.withColumn("all_channels", F.expr(channels))
    firsts = first_of_each("all_channels", "named_struct('t', x.type, 'v', x.value)")
    profiles = f"array_compact(concat(array(primary_profile), transform(social, a -> {social_profile('a.url', 'false')})))"
    df = df.withColumns({
        "contact_channels": F.expr(firsts), "profiles": F.expr(profiles),
        "structured_data_evidence": F.expr("array_compact(array(CASE WHEN size(structured_data) > 0 THEN 'json_ld_detected' END, CASE WHEN size(node_addresses) > 0 THEN 'structured_address_detected' END))"),
    })
    low = "lower(clean_text)"
    flag = lambda words, name: f"CASE WHEN {any_in(low, words)} THEN array('{name}') ELSE cast(array() AS array<string>) END"
    outward = f"slice(array_distinct(transform(filter(anchors, a -> startswith(a.url, 'http') AND {platform('a.url')} IS NULL), a -> a.url)), 1, {MOST_LINKS})"
    display = "coalesce(nullif(trim(substring_index(substring_index(title, '|', 1), '(', 1)), ''), CASE WHEN title = '' THEN coalesce(primary_profile.handle, primary_profile.platform) ELSE coalesce(site_name, primary_profile.handle) END)"
    df = df.withColumn("social_profile", F.expr(
        "CASE WHEN primary_profile.platform IN ('instagram', 'tiktok') THEN named_struct('platform', primary_profile.platform, 'handle', primary_profile.handle,"
        f" 'display_name', {display}, 'bio', description, 'external_links', {outward},"
        f" 'platform_ctas', {flag(['link in bio', 'linktree', 'agenda', 'dm', 'mensaje'], 'profile_cta_visible')},"
        f" 'offer_signals', {flag(['curso', 'coaching', 'servicios', 'editor', 'filmmaker', 'agencia', 'ecommerce', 'shop'], 'commercial_offer_detected')},"
        f" 'activity_signals', {flag(['reels', 'shorts', 'contenido', 'videos', 'ugc'], 'content_format_visible')},"
        f" 'audience_signals', {flag(['clientes', 'marcas', 'founder', 'ceo', 'coach'], 'buyer_audience_visible')}, 'content_text', substring(clean_text, 1, 1500)) END"
    ))
    signals = "array_compact(array(CASE WHEN size(emails) > 0 THEN 'public_email' END, CASE WHEN size(phones) > 0 THEN 'public_phone' END, CASE WHEN whatsapp_url IS NOT NULL THEN 'whatsapp' END, CASE WHEN size(social_profile.external_links) > 0 THEN 'external_link' END))"
    kept = first_of_each("profiles", "named_struct('p', x.platform, 'u', x.url)")
    own = f"CASE WHEN social_profile IS NOT NULL AND p.url = url THEN named_struct('platform', p.platform, 'url', p.url, 'handle', p.handle, 'is_primary', p.is_primary, 'profile_kind', p.profile_kind, 'contact_signals', {signals}, 'activity_signals', social_profile.activity_signals, 'confidence', p.confidence) ELSE p END"
    return df.select(
        *keep, "page_id", "url", "title", "description", "html_lang", "meta_locale", "clean_text", "form_detected", "anchors", "emails", "phones", "addresses", "opening_hours", "area_served",
        "social_links", "internal_links", "external_links", "map_links", "whatsapp_url", "booking_url", "pricing_page_url", "service_page_url", "cta_candidates", "primary_cta",
        "structured_data", "structured_data_evidence", "contact_channels", "social_profile",
        F.expr(f"transform({kept}, p -> {own})").alias("social_profiles"), F.expr("size(social_links)").alias("social_links_count"),
        F.expr("CASE WHEN primary_profile IS NULL THEN 'website' ELSE 'social_profile' END").alias("primary_identity_type"), F.col("url").alias("primary_identity_url"),
        F.expr(contacts.tally("reasons_")).alias("phone_validation_rejections"), F.expr("size(array_compact(reasons_))").alias("invalid_phone_candidates_count"),
    )
