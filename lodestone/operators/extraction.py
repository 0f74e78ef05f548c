"""Payloads of language models: coercion and validation of their JSON, usage and cost, prompts' cache keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import quoted
from .features import clean_list, opportunities

#: Fixed values.
TRUE, FALSE = ["true", "1", "yes", "si", "sí"], ["false", "0", "no"]
LEVELS = ["low", "medium", "high"]
MOST_STACK = 10
TEXT_LIMIT, PACK_LIMIT, LEAST_TEXT = 10_000, 4_000, 100
REQUIRED = ["inferred_niche", "inferred_tech_stack", "generic_attributes", "hiring_signals", "estimated_revenue_signal", "score", "confidence_level"]


def string_list(items: str, most: int = MOST_STACK) -> str:
    return f"slice(array_distinct(filter(transform(array_compact({items}), i -> trim(i)), i -> i <> '')), 1, {most})"


def boolean(value: str) -> str:
    v = f"lower(trim({value}))"
    return f"CASE WHEN {v} IN ({', '.join(map(quoted, [*TRUE, '1.0']))}) THEN true WHEN {v} IN ({', '.join(map(quoted, [*FALSE, '0.0']))}) THEN false END"


def level(value: str) -> str:
    """low, medium, high by name, or by number at 0.8 and 0.5."""
    n = f"try_cast({value} AS double)"
    return f"CASE WHEN lower(trim({value})) IN ('low', 'medium', 'high') THEN lower(trim({value})) WHEN {n} >= 0.8D THEN 'high' WHEN {n} >= 0.5D THEN 'medium' WHEN {n} IS NOT NULL THEN 'low' END"


def validate(payloads: DataFrame, raw: str = "payload") -> DataFrame:
    """Adds the seven coerced fields, valid and fallback_reason. A field that is missing or can't be coerced makes the payload invalid."""
    j = lambda k: f"get_json_object({raw}, '$.{k}')"
    array = lambda k: f"from_json({j(k)}, 'array<string>')"
    attributes = "generic_attributes."
    df = payloads.withColumns({
        "is_json_": F.expr(f"coalesce(try_parse_json({raw}) IS NOT NULL AND startswith(ltrim({raw}), '{{'), false)"),
        "ai_niche": F.expr(f"CASE WHEN {j('inferred_niche')} IS NOT NULL THEN coalesce(nullif(trim({j('inferred_niche')}), ''), 'Desconocido') END"),
        "ai_tech_stack": F.expr(f"CASE WHEN startswith({j('inferred_tech_stack')}, '[') THEN {string_list(array('inferred_tech_stack'))} END"),
        "ai_hiring": F.expr(boolean(j("hiring_signals"))),
        "ai_revenue": F.expr(f"CASE WHEN lower(trim({j('estimated_revenue_signal')})) IN ('low', 'medium', 'high') THEN lower(trim({j('estimated_revenue_signal')})) END"),
        "ai_score": F.expr(f"CASE WHEN try_cast({j('score')} AS double) IS NULL THEN NULL WHEN isnan(try_cast({j('score')} AS double)) THEN 1D ELSE greatest(0D, least(1D, try_cast({j('score')} AS double))) END"), "ai_confidence": F.expr(level(j("confidence_level"))),
        "ai_observed": F.expr(clean_list(f"coalesce({array(attributes + 'observed_signals')}, cast(array() AS array<string>))", 6)),
        "opp_": F.expr(opportunities(f"coalesce({array(attributes + 'inferred_opportunities')}, cast(array() AS array<string>))")),
        "pain_": F.expr(opportunities(f"coalesce({array(attributes + 'pain_points_detected')}, cast(array() AS array<string>))")),
        "has_attributes_": F.expr(f"coalesce(startswith({j('generic_attributes')}, '{{'), false)"),
    })
    whole = "is_json_ AND has_attributes_ AND ai_niche IS NOT NULL AND ai_tech_stack IS NOT NULL AND ai_hiring IS NOT NULL AND ai_revenue IS NOT NULL AND ai_score IS NOT NULL AND ai_confidence IS NOT NULL"
    return df.withColumns({
        "ai_opportunities": F.expr("CASE WHEN size(opp_) > 0 THEN opp_ ELSE pain_ END"), "valid": F.expr(whole),
        "fallback_reason": F.expr(f"CASE WHEN {raw} IS NULL THEN 'missing_payload' WHEN NOT is_json_ THEN 'invalid_json' WHEN NOT ({whole}) THEN 'invalid_payload' END"),
    }).drop("is_json_", "has_attributes_", "opp_", "pain_")


def usage_cost(prompt: str, completion: str, rate_in: float, rate_out: float) -> str:
    """Cost in dollars, or null without both counts or without any rate."""
    if rate_in <= 0 and rate_out <= 0:
        return "cast(NULL AS double)"
    return f"bround(({prompt} * {max(rate_in, 0.0)}D + {completion} * {max(rate_out, 0.0)}D) / 1000000D, 8)"


def with_payloads(pages: DataFrame, payloads: DataFrame) -> DataFrame:
    """Joins a table of payloads (signature, payload, usage) to pages that passed the gate; all others keep the heuristic.

    pages: signature, ai_gate, clean_text. The gate is applied before the join, so only gated pages meet the table.
    """
    asked = pages.where("ai_gate = 'ai_required'").select("signature").distinct()
    # of several payloads for a signature the least counts, so pages aren't multiplied
    others = [c for c in payloads.columns if c != "signature"]
    one = payloads.groupBy("signature").agg(F.min(F.struct(*others)).alias("r")).select("signature", *(F.col(f"r.{c}").alias(c) for c in others))
    found = validate(asked.join(one, "signature"))
    df = pages.join(found, "signature", "left")
    reason = f"CASE WHEN ai_gate <> 'ai_required' THEN ai_gate WHEN length(clean_text) < {LEAST_TEXT} THEN 'insufficient_text' WHEN valid IS NULL THEN 'missing_payload' ELSE fallback_reason END"
    return df.withColumn("fallback_reason", F.expr(reason)).withColumn("selected_method", F.expr("CASE WHEN fallback_reason IS NULL THEN 'ai' ELSE 'heuristic' END"))


def plan_key(*columns: str) -> str:
    """Cache key of a search plan."""
    return "lower(concat_ws('|', " + ", ".join(f"coalesce({c}, '')" for c in columns) + "))"


#: A signature with more rows than this, and more than a thousandth of all, is dealt over several tasks.
HOT_ROWS, HOT_SHARE = 100_000, 1000


def payloads_as_of(rows: DataFrame, payloads: DataFrame, clock: str = "run_at", hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows with payload, payload_at: the newest payload of a row's signature and prompt version that isn't later than its clock; else null.

    rows: signature, prompt_version, the clock, anything else. payloads: signature, prompt_version, created_at, sequence, payload; of equal times the
    greater sequence is newer. One pass over both sides sorted by time, no join. Signatures with very many rows (fewer than HOT_SHARE of them) are dealt
    over several tasks, each with the signature's payloads. Null signatures, versions or clocks meet nothing.
    """
    keys = ["signature", "prompt_version"]
    given = (F.col("signature").isNotNull() & F.col("prompt_version").isNotNull() & F.col(clock).isNotNull())
    counts = rows.where(given).groupBy(*keys).agg(F.count("*").alias("n_"))
    least = max(hot_rows, (rows.count() or 0) // HOT_SHARE)
    hot = F.broadcast(counts.where(F.col("n_") > least).select(*keys, F.ceil(F.col("n_") / least).cast("int").alias("salts_")))
    row = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
    kind = "struct<payload:string,created_at:timestamp,sequence:bigint>"
    asked = rows.where(given).select(row.alias("row_"), *keys, F.col(clock).cast("timestamp").alias("at_")).join(hot, keys, "left")
    asked = asked.select(*keys, F.pmod(F.xxhash64(F.to_json("row_")), F.coalesce("salts_", F.lit(1))).cast("int").alias("salt_"), "at_", F.lit(1).alias("side_"), F.lit(None).cast(kind).alias("p_"), "row_")
    known = payloads.where("created_at IS NOT NULL AND signature IS NOT NULL AND prompt_version IS NOT NULL").join(hot, keys, "left")
    known = known.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.coalesce("salts_", F.lit(1)) - 1)))
    known = known.select(*keys, "salt_", F.col("created_at").cast("timestamp").alias("at_"), F.lit(0).alias("side_"), F.struct("payload", F.col("created_at").cast("timestamp").alias("created_at"), F.col("sequence").cast("bigint").alias("sequence")).cast(kind).alias("p_"), F.lit(None).cast(asked.schema["row_"].dataType).alias("row_"))
    so_far = Window.partitionBy(*keys, "salt_").orderBy("at_", "side_", "p_.sequence").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = known.unionByName(asked).withColumn("last_", F.last("p_", ignorenulls=True).over(so_far)).where("side_ = 1")
    met = met.select("row_.*", F.col("last_.payload").alias("payload"), F.col("last_.created_at").alias("payload_at"))
    return met.unionByName(rows.where(~given).withColumns({"payload": F.lit(None).cast("string"), "payload_at": F.lit(None).cast("timestamp")}))


def search_plan(payloads: DataFrame, raw: str = "payload") -> DataFrame:
    """Adds the four lists of a search plan; an absent or broken plan has empty lists."""
    empty = "cast(array() AS array<string>)"
    lists = ["optimal_dork_queries", "dynamic_negative_terms", "target_entity_hints", "exclusion_entity_hints"]
    return payloads.withColumns({c: F.expr(f"coalesce({string_list(f"from_json(get_json_object({raw}, '$.{c}'), 'array<string>')", 50)}, {empty})") for c in lists})


def extraction_prompt(persona: str, pack: str, text: str) -> str:
    """Prompt text of one page: persona, then the evidence pack cut to its limit, else the text cut to its own."""
    return f"concat({quoted('Perfil: ')}, {persona}, '\\n', CASE WHEN {pack} IS NOT NULL THEN substring({pack}, 1, {PACK_LIMIT}) ELSE substring({text}, 1, {TEXT_LIMIT}) END)"



#: Fields of the evidence pack that a model is shown beside the domain and the summary text.
EVIDENCE = [
    "title", "description", "location", "raw_location_text", "city", "region", "country", "postal_code", "validated_location", "location_match_status", "detected_language", "language_match_status", "primary_identity_type",
    "primary_identity_url", "primary_cta", "booking_url", "pricing_page_url", "social_profiles", "social_profile", "contact_channels", "contact_consistency_status", "primary_email_confidence", "primary_phone_confidence",
    "primary_contact_source", "heuristic_score", "heuristic_confidence", "observed_signals", "inferred_opportunities", "inferred_tech_stack", "inferred_niche", "taxonomy_top_level", "taxonomy_business_type", "entity_type_detected",
    "entity_type_confidence", "is_target_entity", "acceptance_decision", "observed_business_model", "business_model_fit_status", "service_keywords",
]
PACK_TEXT = 1800


def evidence_pack(df: DataFrame) -> DataFrame:
    """Adds evidence_pack, JSON of the fields at hand; null fields stay in it as null."""
    have = [c for c in EVIDENCE if c in df.columns]
    text = f"substring(trim(regexp_replace(clean_text, '\\\\s+', ' ')), 1, {PACK_TEXT})"
    parts = ["'domain', domain", f"'summary_text', {text}", *(f"'{c}', {c}" for c in have)]
    return df.withColumn("evidence_pack", F.expr(f"to_json(named_struct({', '.join(parts)}), map('ignoreNullFields', 'false'))"))


def trace(df: DataFrame, provider: str, version: str) -> DataFrame:
    """Adds ai_trace: which method scored a page and why, with usage where columns for it are there. Pages the gate held back are skipped."""
    usage = {"latency_ms": "bigint", "prompt_tokens": "bigint", "completion_tokens": "bigint", "total_tokens": "bigint", "estimated_cost_usd": "double", "cache_hit": "boolean", "error_type": "string", "retryable": "boolean", "message": "string"}
    kept = [f"'{c}', {c if c in df.columns else f'cast(NULL AS {t})'}" for c, t in usage.items()]
    status = "CASE WHEN ai_gate <> 'ai_required' THEN 'skipped' WHEN selected_method = 'ai' THEN 'success' ELSE 'fallback' END"
    method = "CASE WHEN selected_method = 'ai' THEN 'model' ELSE 'heuristic' END"
    return df.withColumn("ai_trace", F.expr(f"named_struct('provider', {quoted(provider)}, 'prompt_version', {quoted(version)}, 'status', {status}, 'selected_method', selected_method, 'evaluation_method', {method}, 'fallback_reason', fallback_reason, {', '.join(kept)})"))
