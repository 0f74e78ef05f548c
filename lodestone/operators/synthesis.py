"""Query synthesis: families of search queries for each job, their batches and budgets. Native array expressions over job rows.

Jobs: search_query, user_profession, user_technologies, target_niche, target_location, target_language, user_service_offers,
user_service_constraints, user_target_offer_focus, target_budget_signals, ai_dork_queries, ai_negative_terms. Text columns may be
null, lists too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.plan import barrier
from ..functions.text import any_in, collapse, first_of_each, let, quoted, strings
from ..rules import queries as rules

#: Fixed values.
MOST_QUERIES, QUERY_BATCH = 16, 2
SOCIAL_ROLES = ["video", "editor", "community", "social", "creador", "diseño", "designer"]
CREATIVE_ROLES = ["video", "editor", "community", "social", "creador", "diseñador", "designer", "web", "desarrollador", "developer", "seo", "cro"]
VISUAL_NEGATIVES = ["-pinterest", "-linkedin", "-instagram", "-tiktok", "-youtube"]
ONLINE_NICHES = ["ecommerce", "tienda online", "shopify", "academia online", "cursos online", "productos digitales", "infoproductos"]
BUDGET_RULES = [
    (["instagram", "tiktok"], ["instagram", "tiktok"]), (["linktree", "tienda oficial", "tienda"], ["link in bio", "linktree", "tienda online"]), (["curso", "infoproducto"], ["curso", "infoproductos"]),
    (["anuncio", "ads"], ["anuncios", "meta ads"]), (["seguidores"], ["creador", "marca personal"]),
]
BUDGET_ORDER = ["link in bio", "linktree", "tienda online", "curso", "infoproductos", "instagram", "tiktok", "meta ads", "anuncios", "creador", "marca personal"]
FRAGMENTS = r"(?i)\s*(?:,|/|&|\by\b|\be\b)\s*"

LISTS = ["user_technologies", "user_service_offers", "user_service_constraints", "target_budget_signals", "ai_dork_queries", "ai_negative_terms"]
TEXTS = ["search_query", "user_profession", "target_niche", "target_location", "target_language", "user_target_offer_focus"]
EMPTY = "cast(array() AS array<string>)"


def context_list(column: str) -> str:
    """Collapsed items, first of each spelling whatever its case."""
    kept = f"filter(transform(array_compact(coalesce({column}, {EMPTY})), v -> {collapse('v')}), v -> v <> '')"
    return first_of_each(kept, "lower(x)")


def has_phrase(query: str, phrase: str) -> str:
    return f"({phrase} <> '' AND contains(concat(' ', lower({query}), ' '), concat(' ', lower({phrase}), ' ')))"


def negated(queries: str) -> str:
    """Each of an array of collapsed queries with the negative terms that it doesn't hold already.

    Reads terms_ (low, out), all_terms_ (all out) and firsts_, the first characters of all low: a query with none of these holds no term.
    """
    missing = "filter(terms_, t_ -> NOT contains(low_, t_.low))"
    some = let("low_", "lower(q_)", f"concat_ws(' ', q_, nullif(array_join(transform({missing}, t_ -> t_.out), ' '), ''))")
    held = let("all_", "lower(array_join(qs_, ' '))", "exists(firsts_, c_ -> contains(all_, c_))")
    plain = "concat_ws(' ', q_, nullif(all_terms_, ''))"
    return let("qs_", f"filter({queries}, q_ -> q_ <> '')", f"CASE WHEN {held} THEN transform(qs_, q_ -> {some}) ELSE transform(qs_, q_ -> {plain}) END")


def variants(fragment: str) -> str:
    """Variants of every key inside a fragment in order of the dictionary, without repeats; else the fragment."""
    table = "array(" + ", ".join(f"named_struct('key', {quoted(k)}, 'all', {strings(vs)})" for k, vs in rules.VARIANTS.items()) + ")"
    found = let("low_", f"lower({fragment})", f"filter({table}, v_ -> contains(low_, v_.key))")
    return let("found_", found, f"CASE WHEN size(found_) > 0 THEN array_distinct(flatten(transform(found_, v_ -> v_.all))) ELSE array({fragment}) END")


def _fragments(value: str) -> str:
    """Fragments of a niche or query without its location and generic prefix."""
    place = f"concat('(?iU)\\\\b', regexp_replace(target_location, '([^A-Za-z0-9 ])', '\\\\\\\\$1'), '\\\\b')"
    placed = f"CASE WHEN target_location = '' THEN {value} ELSE {collapse(f'regexp_replace({value}, {place}, {quoted(chr(32))})')} END"
    prefix = "CASE " + " ".join(f"WHEN startswith(lower(x), {quoted(p)}) THEN {collapse(f'substring(x, {len(p) + 1})')}" for p in rules.PREFIXES) + " ELSE x END"
    # cut at line ends, of which a collapsed text has none: a pattern that a replacement reads is compiled once, that of a split each time
    cut = f"split(regexp_replace(bare_, {quoted(FRAGMENTS)}, '\\n'), '\\n')"
    parts = f"filter(transform({cut}, f -> {collapse('f')}), f -> f <> '')"
    whole = let("parts_", parts, "CASE WHEN size(parts_) = 0 THEN array(bare_) ELSE parts_ END")
    return let("bare_", let("x", placed, prefix), f"CASE WHEN bare_ = '' THEN {EMPTY} ELSE {whole} END")


def _interleaved(groups: str) -> str:
    """The first of each group, then the second, and so on, without repeats."""
    ranks = f"sequence(0, greatest(array_max(transform({groups}, g -> size(g))), 1) - 1)"
    return f"CASE WHEN forall({groups}, g -> size(g) = 1) THEN array_distinct(flatten({groups})) ELSE array_distinct(array_compact(flatten(transform({ranks}, i -> transform({groups}, g -> get(g, i)))))) END"


def intents(df: DataFrame) -> DataFrame:
    """Adds seeds: variants of all fragments of niche and base_, interleaved; and seeds_retry, those of the niche and the query as given."""
    groups = lambda value: F.expr(f"transform({_fragments(value)}, f -> {variants('f')})")
    df = barrier(df.withColumns({"niche_": groups("target_niche"), "groups_": groups("base_")}))
    df = barrier(df.withColumn("groups_", F.concat("niche_", "groups_")).withColumn("seeds", F.expr(_interleaved("groups_"))))
    # base_ is the query wherever there is one
    return df.withColumn("seeds_retry", F.expr(f"CASE WHEN search_query <> '' THEN seeds ELSE {_interleaved('niche_')} END")).drop("groups_", "niche_")


def budget_keywords(signals: str) -> str:
    """Keywords that budget signals stand for, in order of priority."""
    listed = ", ".join(f"CASE WHEN exists({signals}, s -> {any_in('lower(s)', words)}) THEN {strings(keys)} ELSE {EMPTY} END" for words, keys in BUDGET_RULES)
    return let("listed_", f"concat({listed})", f"filter({strings(BUDGET_ORDER)}, k -> array_contains(listed_, k))")


def negatives(df: DataFrame) -> str:
    """Negative terms (low: as queries are searched for it, out: collapsed): the dictionary's, the job's own, and those against providers; each once, without blank ones."""
    text = f"lower(concat_ws(' ', target_niche, user_target_offer_focus, array_join({context_list('user_service_offers')}, ' '), array_join({context_list('user_service_constraints')}, ' ')))"
    own = f"filter(transform(own_, t -> named_struct('low', lower(t), 'out', {collapse('t')})), t -> t.out <> '')"

    def listed(barred: list[str]) -> str:
        # the dictionaries are lower case and collapsed, and literals
        terms = lambda words: "array(" + ", ".join(f"named_struct('low', {quoted(w)}, 'out', {quoted(w)})" for w in words if w not in barred) + ")"
        against = f"filter({terms(w for w in rules.PROVIDER_NEGATIVES if w not in rules.NEGATIVES)}, t -> NOT array_contains(own_, t.low))"
        found = f"concat({terms(rules.NEGATIVES)}, {own}, CASE WHEN online_ THEN {against} ELSE cast(array() AS array<struct<low: string, out: string>>) END)"
        return let("own_", f"array_except(array_compact(ai_negative_terms), {strings([*rules.NEGATIVES, *barred])})", found)

    both = f"CASE WHEN {any_in('lower(user_profession)', CREATIVE_ROLES)} THEN {listed(VISUAL_NEGATIVES)} ELSE {listed([])} END"
    return let("online_", any_in(text, ONLINE_NICHES), both)


def _hint(key: str) -> str:
    default = rules.LANGUAGE_HINTS["es"]
    value = lambda v: strings(v) if isinstance(v, list) else quoted(v)
    whens = " ".join(f"WHEN {quoted(lang)} THEN {value(h[key])}" for lang, h in rules.LANGUAGE_HINTS.items())
    return f"CASE lang_ {whens} ELSE {value(default[key])} END"


def build_queries(jobs: DataFrame, most: int = MOST_QUERIES) -> DataFrame:
    """Adds queries (canonical, at most `most`), retry_queries and query_batches (chunks of two: canonical, then new retries)."""
    df = jobs.withColumns({c: F.coalesce(c, F.expr(EMPTY)) for c in LISTS} | {c: F.expr(collapse(c)) for c in TEXTS})
    df = df.withColumn("lang_", F.lower("target_language")).withColumn("base_", F.expr("CASE WHEN search_query <> '' THEN search_query ELSE trim(concat_ws(' ', nullif(target_niche, ''), nullif(target_location, ''))) END"))
    df = barrier(intents(df)).withColumns({
        "terms_": F.expr(negatives(df)), "budget_": F.expr(budget_keywords("target_budget_signals")), "here_": F.expr("CASE WHEN target_location = '' THEN '' ELSE concat(' ', target_location) END"),
        "niche_place": F.expr("trim(concat_ws(' ', nullif(target_niche, ''), nullif(target_location, '')))"), "social_": F.expr(any_in("lower(user_profession)", SOCIAL_ROLES)), "tech_": F.expr(f"lower(array_join({context_list('user_technologies')}, ' '))"),
        "h_official": F.expr(_hint("official")), "h_contact": F.expr(_hint("contact")), "h_services": F.expr(_hint("services")), "h_commercial": F.expr(_hint("commercial")), "h_locations": F.expr(_hint("locations")),
    })
    df = barrier(df).withColumns({
        "geo_": F.expr(f"CASE WHEN target_location <> '' AND NOT {has_phrase('base_', 'target_location')} THEN concat(base_, ' ', target_location) ELSE base_ END"),
        "placed": F.expr("transform(seeds, s -> concat(s, here_))"), "placed_r": F.expr("transform(slice(seeds_retry, 1, 4), s -> concat(s, here_))"),
        "all_terms_": F.expr("array_join(terms_.out, ' ')"), "firsts_": F.expr("array_distinct(transform(terms_, t -> left(t.low, 1)))"),
        # retries start from the query as given, without the niche in its place
        "stem_": F.expr("coalesce(nullif(niche_place, ''), nullif(trim(concat(search_query, here_)), ''), search_query)"),
    })
    df = barrier(barrier(df).withColumn("main_", F.expr("coalesce(nullif(niche_place, ''), nullif(geo_, ''), base_)")))
    # all that the texts below are put together from is collapsed, but for the dorks
    with_hints = lambda stem, hints: f"transform({hints}, h -> concat({stem}, ' ', h))"
    sites = lambda stems: f"flatten(transform(concat({stems}), s -> array(concat(s, ' site:instagram.com'), concat(s, ' site:tiktok.com'))))"
    social_hints = f"slice(concat(slice(budget_, 1, 3), {strings(rules.COMMERCIAL_HINTS[:4])}), 1, 3)"
    near = f"flatten(transform(slice(placed, 1, 2), s -> concat(array(s), {with_hints('s', social_hints)})))"
    main_hints = f"concat(slice(budget_, 1, 2), {strings(rules.PLATFORM_HINTS[:2])})"
    social = f"CASE WHEN social_ THEN {sites(f'{near}, array(main_), {with_hints("main_", main_hints)}')} ELSE {EMPTY} END"
    powered = ", ".join(f"CASE WHEN contains(tech_, '{t}') THEN array(concat(main_, ' \"{by} {t}\"')) ELSE {EMPTY} END" for t, by in (("shopify", "powered by"), ("wordpress", "creado con")))
    families = [
        negated(f"transform(ai_dork_queries, q -> {collapse('q')})"), "array(base_, niche_place, geo_)", "slice(placed, 1, 3)",
        negated(f"concat({social}, {powered}, {with_hints('main_', 'array(h_official, h_contact, h_services)')}, flatten(transform(slice(placed, 1, 2), s -> {with_hints('s', 'array(h_official, h_contact)')})))"),
        f"CASE WHEN size(placed) > 3 THEN slice(placed, 4, size(placed)) ELSE {EMPTY} END",
        negated(f"CASE WHEN target_niche <> '' AND NOT {has_phrase('base_', 'target_niche')} THEN array(concat(base_, ' ', target_niche)) ELSE {EMPTY} END"),
    ]
    retry_hints = f"concat(slice(budget_, 1, 2), {strings(['marca personal', 'coach', 'link in bio'])})"
    retries = [
        with_hints("stem_", "h_commercial"), f"CASE WHEN social_ THEN {sites(f'array(stem_), {with_hints("stem_", retry_hints)}')} ELSE {EMPTY} END",
        with_hints("stem_", "h_locations"), f"flatten(transform(placed_r, s -> {with_hints('s', 'h_commercial')}))",
        f"CASE WHEN target_niche <> '' AND search_query <> '' AND NOT {has_phrase('search_query', 'target_niche')} THEN {with_hints('concat(target_niche, here_)', 'array(h_official, h_contact)')} ELSE {EMPTY} END",
        f"CASE WHEN target_location <> '' AND search_query <> '' AND NOT {has_phrase('search_query', 'target_location')} THEN array(concat(search_query, here_)) ELSE {EMPTY} END",
    ]
    distinct = lambda queries: f"array_distinct(filter({queries}, q -> q <> ''))"
    df = barrier(df.withColumns({
        "queries": F.expr(f"CASE WHEN base_ = '' THEN {EMPTY} ELSE slice({distinct(f'concat({", ".join(families)})')}, 1, {most}) END"),
        "retry_queries": F.expr(f"CASE WHEN stem_ = '' THEN {EMPTY} ELSE {distinct(negated(f'array_distinct(concat({", ".join(retries)}))'))} END"),
    }))
    df = barrier(df.withColumn("retry_new", F.array_except("retry_queries", "queries")))
    others = [c for c in jobs.columns if c not in (*LISTS, *TEXTS)]
    return df.select(*others, *(c for c in jobs.columns if c in (*LISTS, *TEXTS)), "queries", "retry_queries", F.expr(f"concat({chunks('queries')}, {chunks('retry_new')})").alias("query_batches"))


def chunks(items: str, size: int = QUERY_BATCH) -> str:
    """An array in chunks."""
    return f"CASE WHEN size({items}) = 0 THEN cast(array() AS array<array<string>>) ELSE transform(sequence(0, size({items}) - 1, {size}), i -> slice({items}, i + 1, {size})) END"


def flatten_batches(batches: str) -> str:
    """All queries of batches in order, without repeats."""
    return f"array_distinct(flatten({batches}))"


# ---- budgets ----


def candidate_cap(target: str) -> str:
    return f"greatest(5, 4 * greatest(coalesce({target}, 1), 1))"


def batch_size(target: str, cap: str) -> str:
    return f"CASE WHEN {cap} <= 0 THEN 0 ELSE least({cap}, greatest(3, least(5, coalesce(nullif({target}, 0), 1) + 1))) END"


def discovery_budget(target: str, cap: str, remaining: str) -> str:
    return f"CASE WHEN {remaining} <= 0 OR {cap} <= 0 THEN 0 ELSE least({remaining}, greatest(5, 2 * ({batch_size(target, cap)}))) END"


def capture_target(legacy: str, target: str) -> str:
    return f"coalesce(nullif({target}, 0), nullif({legacy}, 0), 1)"


def capture_cap(legacy: str, target: str, asked: str, seeds: str) -> str:
    goal = capture_target(legacy, target)
    cap = f"CASE WHEN {asked} IS NOT NULL THEN {asked} WHEN {seeds} > 0 THEN {seeds} ELSE {candidate_cap(goal)} END"
    return f"greatest({cap}, CASE WHEN {seeds} > 0 THEN least({seeds}, {goal}) ELSE {goal} END)"
