"""Result pages, logs and metrics over job tables.

Every summary is one grouped aggregate for all jobs at once, with partial aggregation before the shuffle; a single job is a
filter on the result. Histograms are maps out of a second grouped count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
QUALITY = ["accepted", "needs_review", "rejected"]
NON_TARGET_DECISIONS = ["rejected_directory", "rejected_media", "rejected_article"]
FINAL_MESSAGE = "Job finalizado"
EXCLUSION_MESSAGES = ["Job creado y encolado", "Discovery incremental registro exclusiones tempranas"]


def ratio(part: str, whole: str, digits: int = 4) -> str:
    """Ratio rounded half to even; 0 of nothing."""
    return f"CASE WHEN {whole} <> 0 THEN bround(({part}) / cast({whole} AS double), {digits}) ELSE 0D END"


def quality_filter(value: str | None) -> list[str]:
    """Statuses asked for, in order, without repeats; raises ValueError on unknown ones."""
    text = (value or "accepted").strip().lower()
    if text == "all":
        return list(QUALITY)
    parts = [p.strip() for p in text.split(",") if p.strip()]
    if not parts or any(p not in QUALITY for p in parts):
        raise ValueError("quality must be accepted, needs_review, rejected or all")
    return list(dict.fromkeys(parts))


def histogram(rows: DataFrame, key: str, reason: str, name: str) -> DataFrame:
    """(key, name: map of reason -> count, sorted by reason) of rows with a non-empty reason."""
    counted = rows.where(F.col(reason) != "").groupBy(key, reason).agg(F.count("*").alias("n_"))
    return counted.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(reason, "n_")))).alias(name))


def results_page(job_prospects: DataFrame, prospects: DataFrame, quality: str | None = None, offset: int = 0, limit: int = 50, job_id=None, ties: list[str] = ()) -> DataFrame:
    """A page of a job's results: inner join, filter, order by rank, then newest; job values first, canonical ones where they are missing.

    Columns of both sides that share a name fall back from job to canonical if empty; match_score does if null.
    """
    rows = job_prospects.where(F.col("quality_status").isin(quality_filter(quality)))
    if job_id is not None:
        rows = rows.where(F.col("job_id") == job_id)
    j, p = rows.alias("j"), prospects.alias("p")
    joined = j.join(p, F.col("j.prospect_id") == F.col("p.id"))
    shared = [c for c in prospects.columns if c in job_prospects.columns]
    kinds = dict(prospects.dtypes)

    def value(c: str):
        job, canonical = F.col(f"j.{c}"), F.col(f"p.{c}")
        if kinds[c] == "string":
            return F.coalesce(F.when(job != "", job), canonical).alias(c)
        if kinds[c].startswith("array"):
            return F.when(F.size(job) > 0, job).otherwise(canonical).alias(c)
        return F.coalesce(job, canonical).alias(c)

    columns = [value(c) if c in shared else F.col(f"p.{c}") for c in prospects.columns] + [F.col(f"j.{c}") for c in job_prospects.columns if c not in shared]
    if {"match_score"} <= set(job_prospects.columns) and "score" in prospects.columns:
        columns = [c for c in columns if c._jc.toString() != "p.score"] + [F.coalesce("j.match_score", "p.score").alias("score")]
    order = [F.asc_nulls_last("j.rank_position"), F.desc_nulls_first("j.created_at"), *(F.col(f"j.{t}") for t in ties)]
    return joined.orderBy(*order).select(*columns).offset(offset).limit(limit)


def logs_page(logs: DataFrame, job_id=None, level: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    rows = logs if job_id is None else logs.where(F.col("job_id") == job_id)
    rows = rows if level is None else rows.where(F.col("level") == level)
    return rows.orderBy(F.desc_nulls_first("created_at"), F.desc("id")).offset(offset).limit(limit)


def logs_total(logs: DataFrame, level: str | None = None) -> DataFrame:
    """Rows of each job that its log pages are out of."""
    rows = logs if level is None else logs.where(F.col("level") == level)
    return rows.groupBy("job_id").agg(F.count("*").alias("total"))


def recent_errors(logs: DataFrame, most: int = 3) -> DataFrame:
    w = Window.partitionBy("job_id").orderBy(F.desc_nulls_first("created_at"), F.desc("id"))
    return logs.where("level = 'ERROR'").withColumn("error_rank", F.row_number().over(w)).where(F.col("error_rank") <= most)


def last_log(logs: DataFrame, message: str | None = FINAL_MESSAGE) -> DataFrame:
    """Latest log of each job, of one message or of any; later id wins at the same time."""
    rows = logs if message is None else logs.where(F.col("message") == message)
    others = [c for c in logs.columns if c not in ("job_id", "created_at", "id")]
    top = rows.groupBy("job_id").agg(F.max(F.struct("created_at", "id", *others)).alias("l"))
    return top.select("job_id", *(F.col(f"l.{c}").alias(c) for c in ("created_at", "id", *others)))


def ai_usage(rows: DataFrame) -> DataFrame:
    """Per job over rows(job_id, ai_trace as JSON): attempts, outcomes, tokens, latency, cost, reasons of fallbacks.

    Rows without a trace, or whose status is skipped, don't count.
    """
    get = lambda k: F.get_json_object("ai_trace", f"$.{k}")
    number = lambda k: F.expr(f"coalesce(try_cast(get_json_object(ai_trace, '$.{k}') AS bigint), 0)")
    seen = rows.where(F.col("ai_trace").startswith("{") & (F.coalesce(get("status"), F.lit("")) != "skipped"))
    seen = seen.select("job_id", get("selected_method").alias("m"), get("fallback_reason").alias("r"), F.expr("try_cast(get_json_object(ai_trace, '$.estimated_cost_usd') AS double)").alias("cost"), *(number(k).alias(k) for k in ("prompt_tokens", "completion_tokens", "total_tokens", "latency_ms")))
    back = F.coalesce(F.col("m") == "heuristic", F.lit(False))
    agg = seen.groupBy("job_id").agg(
        F.count("*").alias("attempts"), F.count_if(~back).alias("successes"), F.count_if(back).alias("fallbacks"), F.sum("prompt_tokens").alias("total_prompt_tokens"),
        F.sum("completion_tokens").alias("total_completion_tokens"), F.sum("total_tokens").alias("total_tokens"), F.sum("latency_ms").alias("total_latency_ms"), F.expr("bround(sum(cost), 8)").alias("estimated_cost_usd"),
    )
    agg = agg.withColumns({"fallback_ratio": F.expr(ratio("fallbacks", "attempts")), "average_latency_ms": F.expr(ratio("total_latency_ms", "attempts", 2))})
    return agg.join(histogram(seen.where(back), "job_id", "r", "fallback_reasons"), "job_id", "left")


def quality_summary(rows: DataFrame, key: str = "job_id") -> DataFrame:
    counts = rows.groupBy(key).agg(*(F.count_if(F.coalesce(F.col("quality_status") == s, F.lit(False))).alias(s) for s in QUALITY))
    return counts.join(histogram(rows, key, "rejection_reason", "rejection_reasons"), key, "left")


def dropoff_reason() -> str:
    decision = "lower(trim(coalesce(acceptance_decision, '')))"
    return f"CASE WHEN startswith({decision}, 'rejected_') THEN {decision} ELSE nullif(rejection_reason, '') END"


def capture_summary(jobs: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per job, jobs without results included.

    jobs: job_id, status, total_processed, total_found, total_failed, total_skipped. rows: job_id, quality_status,
    rejection_reason, acceptance_decision.
    """
    counts = rows.groupBy("job_id").agg(
        F.count_if(F.expr("coalesce(acceptance_decision = 'accepted_target', false)")).alias("accepted_count"),
        F.count_if(F.expr("coalesce(quality_status = 'needs_review', false)")).alias("needs_review_count"), F.count_if(F.expr("coalesce(quality_status = 'rejected', false)")).alias("rejected_count"),
    )
    reasons = histogram(rows.withColumn("r_", F.expr(dropoff_reason())), "job_id", "r_", "m_")
    df = jobs.join(counts, "job_id", "left").join(reasons, "job_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    df = df.withColumns({c: zero(F.col(c)) for c in ("accepted_count", "needs_review_count", "rejected_count", "total_processed", "total_found", "total_failed", "total_skipped")})
    extra = "map_filter(map('processing_failed', total_failed, 'processing_skipped', total_skipped), (k, v) -> v > 0)"
    return df.select(
        "job_id", "status", "accepted_count", "needs_review_count", "rejected_count", F.col("total_processed").alias("candidates_processed"), F.col("total_found").alias("candidates_discovered"),
        F.expr(ratio("accepted_count", "total_processed")).alias("acceptance_rate"), F.expr(f"map_concat(coalesce(m_, map_filter(map('', 0L), (k, v) -> false)), {extra})").alias("candidate_dropoff_by_reason"),
    )


def exclusion_counts(logs: DataFrame) -> DataFrame:
    """(job_id, reason, n) out of the maps in the two log messages that carry exclusions."""
    maps = logs.where(F.col("message").isin(EXCLUSION_MESSAGES)).select("job_id", F.explode(F.from_json(F.get_json_object("context", "$.excluded_reason_counts"), "map<string,bigint>")).alias("reason", "n"))
    return maps.groupBy("job_id", "reason").agg(F.sum("n").alias("n"))


def operational_summary(captures: DataFrame, exclusions: DataFrame) -> DataFrame:
    """captures: result of capture_summary; exclusions: job_id, reason, n."""
    reason = F.lower(F.trim("reason"))
    noise = exclusions.groupBy("job_id").agg(F.sum(F.when(reason.startswith("excluded_as_article"), F.col("n")).otherwise(0)).alias("a_"), F.sum(F.when(reason.startswith("excluded_as_directory"), F.col("n")).otherwise(0)).alias("d_"))
    df = captures.join(noise, "job_id", "left").withColumns({"a_": F.coalesce("a_", F.lit(0)), "d_": F.coalesce("d_", F.lit(0))})
    return df.select(
        *captures.columns, (F.expr("status = 'completed' AND accepted_count = 0")).alias("completed_with_zero_accepted"),
        F.expr("CASE WHEN accepted_count > 0 THEN bround(candidates_processed / cast(accepted_count AS double), 4) END").alias("candidates_per_accepted"),
        F.col("a_").cast("bigint").alias("article_exclusion_count"), F.col("d_").cast("bigint").alias("directory_exclusion_count"),
        F.expr(ratio("a_ + d_", "(candidates_discovered + a_ + d_)")).alias("article_directory_exclusion_ratio"),
    )


def newest(jobs: DataFrame, most: int = 100, order: list[str] = ("created_at", "job_id")) -> DataFrame:
    if not 1 <= most <= 500:
        raise ValueError("the window is 1 to 500 jobs")
    return jobs.orderBy(*(F.desc(c) for c in order)).limit(most)


def operational_metrics(summaries: DataFrame) -> DataFrame:
    """One row over all jobs given. Rates are means of the jobs' rounded rates over completed jobs; the noise ratio over all."""
    done = "status = 'completed'"
    df = summaries.agg(
        F.count("*").alias("total_jobs"), F.expr(f"count_if({done})").alias("completed_jobs"), F.expr("count_if(completed_with_zero_accepted)").alias("completed_jobs_with_zero_accepted"),
        F.expr(f"coalesce(bround(avg(CASE WHEN {done} THEN acceptance_rate END), 4), 0D)").alias("average_acceptance_rate"),
        F.expr(f"coalesce(bround(avg(CASE WHEN {done} THEN candidates_per_accepted END), 4), 0D)").alias("average_candidates_per_accepted"),
        F.expr("coalesce(bround(avg(article_directory_exclusion_ratio), 4), 0D)").alias("average_article_directory_exclusion_ratio"),
        *(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(n) for c, n in (("candidates_processed", "total_candidates_processed"), ("accepted_count", "total_accepted"), ("article_exclusion_count", "total_article_exclusions"), ("directory_exclusion_count", "total_directory_exclusions"))),
    )
    return df.withColumn("completed_jobs_with_zero_accepted_ratio", F.expr(ratio("completed_jobs_with_zero_accepted", "completed_jobs")))


def false_phones(raw: str) -> str:
    """Phones filtered out by validation: the explicit count, else the sum of the counts by reason."""
    explicit = f"try_cast(get_json_object({raw}, '$.invalid_phone_candidates_count') AS bigint)"
    counts = f"map_values(from_json(get_json_object({raw}, '$.phone_validation_rejections'), 'map<string,bigint>'))"
    return f"coalesce({explicit}, aggregate({counts}, 0L, (a, v) -> a + coalesce(v, 0L)), 0L)"


def commercial_summary(rows: DataFrame, key: str = "job_id") -> DataFrame:
    """rows: key, acceptance_decision, contact_consistency_status, raw_extraction (JSON)."""
    decision, contact = F.lower(F.trim(F.coalesce("acceptance_decision", F.lit("")))), F.lower(F.trim(F.coalesce("contact_consistency_status", F.lit(""))))
    df = rows.groupBy(key).agg(
        F.count_if(decision == "accepted_target").alias("accepted_target_count"), F.count_if(decision == "accepted_related").alias("accepted_related_count"), F.count_if(decision.isin(NON_TARGET_DECISIONS)).alias("rejected_non_target_count"),
        F.count_if(contact == "inconsistent").alias("inconsistent_contact_count"), F.sum(F.expr(false_phones("raw_extraction"))).alias("false_phone_filtered_count"),
    )
    return df.withColumn("accepted_target_precision", F.expr(ratio("accepted_target_count", "(accepted_target_count + accepted_related_count)")))


def commercial_metrics(jobs: DataFrame, summaries: DataFrame) -> DataFrame:
    """One row over jobs(job_id, total_processed), those without results included."""
    df = jobs.select("job_id", "total_processed").join(summaries, "job_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    df = df.agg(
        F.count("*").alias("total_jobs"), total("total_processed").alias("total_results_processed"), total("accepted_target_count").alias("total_accepted_target"), total("accepted_related_count").alias("total_accepted_related"),
        total("rejected_non_target_count").alias("total_rejected_non_target"), total("inconsistent_contact_count").alias("inconsistent_contact_count"), total("false_phone_filtered_count").alias("false_phone_filtered_count"),
    )
    whole = "total_results_processed"
    return df.withColumns({
        "accepted_non_target_rate": F.expr(ratio("total_accepted_related", whole)), "inconsistent_contact_rate": F.expr(ratio("inconsistent_contact_count", whole)), "false_phone_filtered_rate": F.expr(ratio("false_phone_filtered_count", whole)),
        "accepted_target_precision": F.expr(ratio("total_accepted_target", "(total_accepted_target + total_accepted_related)")),
    })


def capture_prefix(rows: DataFrame, order: list, target: int, cap: int, accepted: str) -> DataFrame:
    """Candidates that a capture loop processes: by rank, until the target of accepted ones or the cap is reached."""
    w = Window.partitionBy("job_id").orderBy(*order)
    before = F.coalesce(F.sum(F.expr(f"cast({accepted} AS int)")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumns({"processed_order": F.row_number().over(w), "accepted_before": before}).where((F.col("accepted_before") < target) & (F.col("processed_order") <= cap))


def stop_reason(accepted: str, target: str, processed: str, cap: str, discovered: str) -> str:
    return f"CASE WHEN {target} > 0 AND {accepted} >= {target} THEN 'target_reached' WHEN {processed} >= {cap} AND {discovered} >= {cap} THEN 'candidate_cap_reached' ELSE 'discovery_exhausted' END"


def next_unseen_batch(batches: DataFrame, seen: DataFrame, budget: int) -> DataFrame:
    """Per job the first batch with URLs not seen before, its new URLs in order up to the budget.

    batches: job_id, batch, ordinal, url. seen: job_id, url.
    """
    fresh = batches.join(seen.select("job_id", "url").distinct(), ["job_id", "url"], "left_anti")
    fresh = fresh.groupBy("job_id", "url").agg(F.min(F.struct("batch", "ordinal")).alias("k")).select("job_id", "url", "k.batch", "k.ordinal")
    first = fresh.groupBy("job_id").agg(F.min("batch").alias("batch"))
    w = Window.partitionBy("job_id").orderBy("ordinal", "url")
    return fresh.join(first, ["job_id", "batch"]).withColumn("position", F.row_number().over(w)).where(F.col("position") <= budget)


def status_message(status: str = "status") -> str:
    """What a job says of itself, out of its counters, times and error."""
    counts = "concat('Procesadas: ', total_processed, ', guardadas: ', total_saved, ', omitidas: ', total_skipped, ', fallidas: ', total_failed)"
    return (
        f"CASE {status} WHEN 'completed' THEN concat('Completado en ', finished_at, ' | ', {counts}) WHEN 'failed' THEN concat('Falló en ', finished_at, ' | ', coalesce(nullif(error_message, ''), 'Error no especificado'))"
        f" WHEN 'running' THEN concat('En ejecución desde ', started_at, ' | ', {counts}) ELSE 'Pendiente' END"
    )


def job_status(jobs: DataFrame, errors: DataFrame, **summaries: DataFrame) -> DataFrame:
    """One row per job with its message, its summaries (a struct each, by name, null if there is none) and last errors in order.

    jobs: job_id, status, the four totals, started_at, finished_at and error_message as texts. errors: recent_errors().
    """
    last = errors.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("error_rank", "created_at", "message", "context"))).alias("recent_errors"))
    df = jobs.withColumn("message", F.expr(status_message())).join(last, "job_id", "left")
    for name, summary in summaries.items():
        df = df.join(summary.select("job_id", F.struct(*(c for c in summary.columns if c != "job_id")).alias(name)), "job_id", "left")
    return df
