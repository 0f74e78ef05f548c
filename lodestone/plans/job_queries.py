"""Queries over job tables: result pages, logs, summaries, metrics, capture, upserts; each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kpi, scoring, synthesis, upsert
from .adapters import adapter, with_sql

#: Pseudo traces of model calls out of events, in Spark and SQL.
TRACES = """SELECT user_id AS job_id, concat('{"status": "', CASE WHEN event_type = 'view' THEN 'skipped' ELSE 'done' END, '", "selected_method": "', CASE WHEN event_type IN ('error', 'click') THEN 'heuristic' ELSE 'ai' END,
 '", "fallback_reason": "', CASE WHEN event_type = 'error' THEN 'provider_error' ELSE 'timeout' END, '", "prompt_tokens": ', cast(event_id % 100 AS {s}), ', "completion_tokens": ', cast(event_id % 7 AS {s}),
 ', "total_tokens": ', cast(event_id % 100 + event_id % 7 AS {s}), ', "latency_ms": ', cast(event_id % 900 AS {s}), CASE WHEN event_id % 3 = 0 THEN ', "estimated_cost_usd": 0.25' ELSE '' END, '}') AS ai_trace FROM {events}"""


def _listed(column: str) -> str:
    return f"array_join(transform(map_entries({column}), e -> concat(e.key, ':', e.value)), ',')"


def job_results_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapter(spark, sf_dir, "job_prospects")
    page = kpi.results_page(rows, adapter(spark, sf_dir, "prospects"), "accepted,needs_review", 20, 100, ties=["job_id", "prospect_id", "part_id", "price", "quantity", "tax"])
    return page.select("job_id", "rank_position", F.col("id").alias("prospect_id"), "company_name", "country", "quality_status", "score", "contact_consistency_status", "created_at")


JOB_RESULTS_PAGE = with_sql("job_prospects", "prospects") + """SELECT job_id, rank_position, id AS prospect_id, company_name, country, quality_status, coalesce(match_score, score) AS score,
  coalesce(nullif(j.contact_consistency_status, ''), p.contact_consistency_status) AS contact_consistency_status, created_at
FROM job_prospects j JOIN prospects p ON j.prospect_id = p.id WHERE quality_status IN ('accepted', 'needs_review')
ORDER BY rank_position ASC NULLS LAST, created_at DESC NULLS FIRST, job_id, prospect_id, part_id, price, quantity, tax LIMIT 100 OFFSET 20"""


def job_logs_page(spark, sf_dir):
    page = kpi.logs_page(adapter(spark, sf_dir, "logs"), level="INFO", offset=10, limit=50)
    return page.select("id", "job_id", "level", "message", "created_at", F.expr("cast(get_json_object(context, '$.k') AS bigint)").alias("k"))


JOB_LOGS_PAGE = with_sql("logs") + """SELECT id, job_id, level, message, created_at, cast(json_extract_string(context, '$.k') AS bigint) AS k FROM logs WHERE level = 'INFO'
ORDER BY created_at DESC NULLS FIRST, id DESC LIMIT 50 OFFSET 10"""


def recent_errors_top3(spark, sf_dir):
    return kpi.recent_errors(adapter(spark, sf_dir, "logs")).select("job_id", "id", "created_at", F.col("error_rank").cast("bigint").alias("error_rank"))


RECENT_ERRORS = with_sql("logs") + """SELECT job_id, id, created_at, error_rank FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, id DESC) AS error_rank FROM logs WHERE level = 'ERROR') WHERE error_rank <= 3"""


def last_event_per_job(spark, sf_dir):
    return kpi.last_log(adapter(spark, sf_dir, "logs"), None).select("job_id", "id", "message", F.expr("cast(get_json_object(context, '$.k') AS bigint)").alias("k"))


LAST_EVENT = with_sql("logs") + """SELECT job_id, id, message, cast(json_extract_string(context, '$.k') AS bigint) AS k FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, id DESC) AS n FROM logs) WHERE n = 1"""


def quality_summary(spark, sf_dir):
    df = kpi.quality_summary(adapter(spark, sf_dir, "job_prospects"))
    return df.select("job_id", "accepted", "needs_review", "rejected", F.coalesce(F.expr(_listed("rejection_reasons")), F.lit("")).alias("rejection_reasons"))


QUALITY_SUMMARY = with_sql("job_prospects") + """, r AS (SELECT job_id, string_agg(rejection_reason || ':' || n, ',' ORDER BY rejection_reason) AS rejection_reasons FROM
  (SELECT job_id, rejection_reason, count(*) AS n FROM job_prospects WHERE rejection_reason <> '' GROUP BY ALL) GROUP BY job_id)
SELECT q.job_id, accepted, needs_review, rejected, coalesce(rejection_reasons, '') AS rejection_reasons FROM (SELECT job_id, count(*) FILTER (quality_status = 'accepted') AS accepted,
  count(*) FILTER (quality_status = 'needs_review') AS needs_review, count(*) FILTER (quality_status = 'rejected') AS rejected FROM job_prospects GROUP BY job_id) q LEFT JOIN r ON q.job_id = r.job_id"""


def rejection_histogram(spark, sf_dir):
    rows = adapter(spark, sf_dir, "job_prospects").withColumn("reason", F.expr(kpi.dropoff_reason())).where("reason <> ''")
    return rows.groupBy("reason").agg(F.count("*").alias("n"), F.countDistinct("job_id").alias("jobs"))


REJECTIONS = with_sql("job_prospects") + """SELECT reason, count(*) AS n, count(DISTINCT job_id) AS jobs FROM (SELECT job_id, CASE WHEN starts_with(lower(trim(coalesce(acceptance_decision, ''))), 'rejected_')
  THEN lower(trim(acceptance_decision)) ELSE nullif(rejection_reason, '') END AS reason FROM job_prospects) WHERE reason <> '' GROUP BY reason"""

_CAPTURE = """, c AS (SELECT t.job_id, t.status, t.created_at, t.total_processed, t.total_found, t.total_failed, t.total_skipped, count(*) FILTER (p.acceptance_decision = 'accepted_target') AS accepted_count,
  count(*) FILTER (p.quality_status = 'needs_review') AS needs_review_count, count(*) FILTER (p.quality_status = 'rejected') AS rejected_count FROM totals t LEFT JOIN job_prospects p ON t.job_id = p.job_id GROUP BY ALL),
s AS (SELECT *, CASE WHEN total_processed <> 0 THEN round_even(accepted_count / total_processed::double, 4) ELSE 0.0 END AS acceptance_rate FROM c)"""


def capture_summary(spark, sf_dir):
    df = kpi.capture_summary(adapter(spark, sf_dir, "totals"), adapter(spark, sf_dir, "job_prospects"))
    reasons = "array_join(array_sort(transform(map_entries(candidate_dropoff_by_reason), e -> concat(e.key, ':', e.value))), ',')"
    return df.select("job_id", "accepted_count", "needs_review_count", "rejected_count", "candidates_processed", "candidates_discovered", "acceptance_rate", F.expr(reasons).alias("dropoff"))


CAPTURE_SUMMARY = with_sql("jobs", "job_prospects", "totals") + _CAPTURE + """, d AS (SELECT job_id, string_agg(reason || ':' || n, ',' ORDER BY reason || ':' || n) AS dropoff FROM (
  SELECT job_id, reason, count(*) AS n FROM (SELECT job_id, CASE WHEN starts_with(acceptance_decision, 'rejected_') THEN acceptance_decision ELSE nullif(rejection_reason, '') END AS reason FROM job_prospects) WHERE reason IS NOT NULL GROUP BY job_id, reason
  UNION ALL SELECT job_id, 'processing_failed', total_failed FROM totals WHERE total_failed > 0 UNION ALL SELECT job_id, 'processing_skipped', total_skipped FROM totals WHERE total_skipped > 0) GROUP BY job_id)
SELECT s.job_id, accepted_count, needs_review_count, rejected_count, total_processed AS candidates_processed, total_found AS candidates_discovered, acceptance_rate, coalesce(dropoff, '') AS dropoff FROM s LEFT JOIN d ON s.job_id = d.job_id"""


def _exclusions(spark, sf_dir):
    """Exclusion counts that stand in for those in log messages: clicks and views of a user by kind."""
    logs = adapter(spark, sf_dir, "logs")
    reason = F.when(F.col("message") == "click", "excluded_as_article").when(F.col("message") == "view", "excluded_as_directory_seed:x").otherwise("blocked_domain:x")
    return logs.groupBy("job_id", reason.alias("reason")).agg(F.count("*").alias("n"))


_OPERATIONAL = _CAPTURE + """, x AS (SELECT job_id, count(*) FILTER (message = 'click') AS a, count(*) FILTER (message = 'view') AS d FROM logs GROUP BY job_id),
o AS (SELECT s.*, coalesce(a, 0) AS a, coalesce(d, 0) AS d, status = 'completed' AND accepted_count = 0 AS zero, CASE WHEN accepted_count > 0 THEN round_even(total_processed / accepted_count::double, 4) END AS per_accepted,
  CASE WHEN total_found + coalesce(a, 0) + coalesce(d, 0) <> 0 THEN round_even((coalesce(a, 0) + coalesce(d, 0)) / (total_found + coalesce(a, 0) + coalesce(d, 0))::double, 4) ELSE 0.0 END AS noise FROM s LEFT JOIN x ON s.job_id = x.job_id)"""


def operational_summary(spark, sf_dir):
    captures = kpi.capture_summary(adapter(spark, sf_dir, "totals"), adapter(spark, sf_dir, "job_prospects"))
    df = kpi.operational_summary(captures, _exclusions(spark, sf_dir))
    return df.select("job_id", "completed_with_zero_accepted", "candidates_per_accepted", "article_exclusion_count", "directory_exclusion_count", "article_directory_exclusion_ratio")


OPERATIONAL_SUMMARY = with_sql("jobs", "job_prospects", "totals", "logs") + _OPERATIONAL + """ SELECT job_id, zero AS completed_with_zero_accepted, per_accepted AS candidates_per_accepted, a AS article_exclusion_count, d AS directory_exclusion_count, noise AS article_directory_exclusion_ratio FROM o"""


def operational_metrics(spark, sf_dir):
    jobs = kpi.newest(adapter(spark, sf_dir, "totals"), 500)
    rows = adapter(spark, sf_dir, "job_prospects").join(jobs.select("job_id"), "job_id", "left_semi")
    return kpi.operational_metrics(kpi.operational_summary(kpi.capture_summary(jobs, rows), _exclusions(spark, sf_dir)))


OPERATIONAL_METRICS = with_sql("jobs", "job_prospects", "totals", "logs") + _OPERATIONAL + """, m AS (SELECT * FROM o ORDER BY created_at DESC, job_id DESC LIMIT 500)
SELECT count(*) AS total_jobs, count(*) FILTER (status = 'completed') AS completed_jobs, count(*) FILTER (zero) AS completed_jobs_with_zero_accepted,
  coalesce(round_even(avg(acceptance_rate) FILTER (status = 'completed'), 4), 0.0) AS average_acceptance_rate, coalesce(round_even(avg(per_accepted) FILTER (status = 'completed'), 4), 0.0) AS average_candidates_per_accepted,
  coalesce(round_even(avg(noise), 4), 0.0) AS average_article_directory_exclusion_ratio, cast(sum(total_processed) AS bigint) AS total_candidates_processed, cast(sum(accepted_count) AS bigint) AS total_accepted,
  cast(sum(a) AS bigint) AS total_article_exclusions, cast(sum(d) AS bigint) AS total_directory_exclusions,
  CASE WHEN count(*) FILTER (status = 'completed') <> 0 THEN round_even(count(*) FILTER (zero) / (count(*) FILTER (status = 'completed'))::double, 4) ELSE 0.0 END AS completed_jobs_with_zero_accepted_ratio FROM m"""

_COMMERCIAL = """, cs AS (SELECT job_id, count(*) FILTER (acceptance_decision = 'accepted_target') AS t, count(*) FILTER (acceptance_decision = 'accepted_related') AS r,
  count(*) FILTER (acceptance_decision IN ('rejected_directory', 'rejected_media', 'rejected_article')) AS x, count(*) FILTER (contact_consistency_status = 'inconsistent') AS i,
  cast(sum(coalesce(cast(json_extract_string(raw_extraction, '$.invalid_phone_candidates_count') AS bigint),
    cast(json_extract_string(raw_extraction, '$.phone_validation_rejections.date_like') AS bigint) + cast(json_extract_string(raw_extraction, '$.phone_validation_rejections.invalid_length') AS bigint), 0)) AS bigint) AS f FROM job_prospects GROUP BY job_id)"""


def commercial_summary(spark, sf_dir):
    return kpi.commercial_summary(adapter(spark, sf_dir, "job_prospects"))


COMMERCIAL_SUMMARY = with_sql("job_prospects") + _COMMERCIAL + """ SELECT job_id, t AS accepted_target_count, r AS accepted_related_count, x AS rejected_non_target_count, i AS inconsistent_contact_count, f AS false_phone_filtered_count,
  CASE WHEN t + r <> 0 THEN round_even(t / (t + r)::double, 4) ELSE 0.0 END AS accepted_target_precision FROM cs"""


def commercial_metrics(spark, sf_dir):
    return kpi.commercial_metrics(adapter(spark, sf_dir, "totals"), kpi.commercial_summary(adapter(spark, sf_dir, "job_prospects")))


COMMERCIAL_METRICS = with_sql("jobs", "job_prospects", "totals") + _COMMERCIAL + """, m AS (SELECT count(*) AS n, sum(total_processed) AS p, sum(t) AS t, sum(r) AS r, sum(x) AS x, sum(i) AS i, sum(f) AS f FROM totals LEFT JOIN cs ON totals.job_id = cs.job_id)
SELECT n AS total_jobs, cast(p AS bigint) AS total_results_processed, cast(t AS bigint) AS total_accepted_target, cast(r AS bigint) AS total_accepted_related, cast(x AS bigint) AS total_rejected_non_target, cast(i AS bigint) AS inconsistent_contact_count,
  cast(f AS bigint) AS false_phone_filtered_count, round_even(r::double / p::double, 4) AS accepted_non_target_rate, round_even(i::double / p::double, 4) AS inconsistent_contact_rate, round_even(f::double / p::double, 4) AS false_phone_filtered_rate,
  round_even(t::double / (t + r)::double, 4) AS accepted_target_precision FROM m"""


def ai_usage_summary(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    traces = _traces(spark, events)
    df = kpi.ai_usage(traces)
    return df.withColumn("fallback_reasons", F.coalesce(F.expr(_listed("fallback_reasons")), F.lit("")))


def _traces(spark, events):
    events.createOrReplaceTempView("lodestone_events")
    return spark.sql(TRACES.replace("{s}", "string").replace("{events}", "lodestone_events"))


AI_USAGE = "WITH r AS (" + TRACES.replace("{s}", "varchar").replace("{events}", "events") + """), t AS (SELECT job_id, json_extract_string(ai_trace, '$.selected_method') = 'heuristic' AS back, json_extract_string(ai_trace, '$.fallback_reason') AS reason,
  cast(json_extract_string(ai_trace, '$.prompt_tokens') AS bigint) AS p, cast(json_extract_string(ai_trace, '$.completion_tokens') AS bigint) AS c, cast(json_extract_string(ai_trace, '$.total_tokens') AS bigint) AS tt,
  cast(json_extract_string(ai_trace, '$.latency_ms') AS bigint) AS l, cast(json_extract_string(ai_trace, '$.estimated_cost_usd') AS double) AS cost FROM r WHERE json_extract_string(ai_trace, '$.status') <> 'skipped'),
h AS (SELECT job_id, string_agg(reason || ':' || n, ',' ORDER BY reason) AS fallback_reasons FROM (SELECT job_id, reason, count(*) AS n FROM t WHERE back GROUP BY ALL) GROUP BY job_id),
a AS (SELECT job_id, count(*) AS attempts, count(*) FILTER (NOT back) AS successes, count(*) FILTER (back) AS fallbacks, cast(sum(p) AS bigint) AS total_prompt_tokens, cast(sum(c) AS bigint) AS total_completion_tokens, cast(sum(tt) AS bigint) AS total_tokens,
  cast(sum(l) AS bigint) AS total_latency_ms, round_even(sum(cost), 8) AS estimated_cost_usd FROM t GROUP BY job_id)
SELECT a.*, round_even(fallbacks / attempts::double, 4) AS fallback_ratio, round_even(total_latency_ms / attempts::double, 2) AS average_latency_ms, coalesce(fallback_reasons, '') AS fallback_reasons FROM a LEFT JOIN h ON a.job_id = h.job_id"""

_ORDER = ["rank_position", "prospect_id", "part_id", "price", "quantity", "tax", "match_score", "created_at"]


def capture_prefix_stop(spark, sf_dir):
    rows = kpi.capture_prefix(adapter(spark, sf_dir, "job_prospects"), _ORDER, 2, 5, "acceptance_decision IN ('accepted_target', 'accepted_related')")
    df = rows.groupBy("job_id").agg(F.count("*").alias("processed"), F.count_if(F.expr("acceptance_decision IN ('accepted_target', 'accepted_related')")).alias("accepted"), F.max("price").alias("max_price"))
    found = adapter(spark, sf_dir, "job_prospects").groupBy("job_id").agg(F.count("*").alias("discovered"))
    return df.join(found, "job_id").select("*", F.expr(kpi.stop_reason("accepted", "2", "processed", "5", "discovered")).alias("stopped_reason"))


CAPTURE_PREFIX = with_sql("job_prospects") + """, w AS (SELECT *, CASE WHEN acceptance_decision IN ('accepted_target', 'accepted_related') THEN 1 ELSE 0 END AS acc FROM job_prospects),
x AS (SELECT *, row_number() OVER o AS rn, coalesce(sum(acc) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w WINDOW o AS (PARTITION BY job_id ORDER BY rank_position, prospect_id, part_id, price, quantity, tax, match_score, created_at)),
p AS (SELECT job_id, count(*) AS processed, cast(sum(acc) AS bigint) AS accepted, max(price) AS max_price FROM x WHERE before < 2 AND rn <= 5 GROUP BY job_id), d AS (SELECT job_id, count(*) AS discovered FROM w GROUP BY job_id)
SELECT p.*, discovered, CASE WHEN accepted >= 2 THEN 'target_reached' WHEN processed >= 5 AND discovered >= 5 THEN 'candidate_cap_reached' ELSE 'discovery_exhausted' END AS stopped_reason FROM p JOIN d ON p.job_id = d.job_id"""


def incremental_unseen(spark, sf_dir):
    rows = adapter(spark, sf_dir, "job_prospects")
    batches = rows.select("job_id", F.expr("(rank_position + 1) div 2").alias("batch"), F.expr("rank_position * 100000 + prospect_id").alias("ordinal"), F.concat(F.lit("u"), "prospect_id").alias("url"))
    seen = rows.where("rank_position = 1").select("job_id", F.concat(F.lit("u"), "prospect_id").alias("url"))
    return kpi.next_unseen_batch(batches, seen, 2).select("job_id", "batch", "url", F.col("position").cast("bigint").alias("position"))


INCREMENTAL = with_sql("job_prospects") + """, f AS (SELECT job_id, 'u' || prospect_id AS url, min((rank_position + 1) // 2) AS batch, arg_min(rank_position * 100000 + prospect_id, struct_pack(a := (rank_position + 1) // 2, b := rank_position * 100000 + prospect_id)) AS ordinal
  FROM job_prospects WHERE (job_id, 'u' || prospect_id) NOT IN (SELECT (job_id, 'u' || prospect_id) FROM job_prospects WHERE rank_position = 1) GROUP BY job_id, prospect_id)
SELECT job_id, batch, url, position FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ordinal, url) AS position FROM f WHERE (job_id, batch) IN (SELECT (job_id, min(batch)) FROM f GROUP BY job_id)) WHERE position <= 2"""


def upsert_latest(spark, sf_dir):
    rows = adapter(spark, sf_dir, "job_prospects").select("job_id", "prospect_id", "created_at", "rank_position", "price", "quality_status")
    old, new = rows.where("rank_position % 2 = 1"), rows.where("rank_position % 2 = 0")
    return upsert.upsert(old, new, ["job_id", "prospect_id"], ["rank_position", "price", "created_at"])


UPSERT_LATEST = with_sql("job_prospects") + """, t AS (SELECT *, 1 - rank_position % 2 AS new FROM job_prospects), l AS (SELECT *, row_number() OVER (PARTITION BY job_id, prospect_id ORDER BY new DESC, rank_position DESC, price DESC, created_at DESC) AS n,
  first_value(created_at) OVER (PARTITION BY job_id, prospect_id ORDER BY new, rank_position, price, created_at) AS first_at FROM t)
SELECT job_id, prospect_id, first_at AS created_at, rank_position, price, quality_status FROM l WHERE n = 1"""


def patch_present(spark, sf_dir):
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    old = customers.where("c_custkey % 3 <> 0 OR c_custkey % 2 <> 0").selectExpr("c_custkey AS id", "c_name AS name", "c_mktsegment AS segment", "c_acctbal AS balance")
    new = customers.where("c_custkey % 2 = 0").selectExpr("c_custkey AS id", "upper(c_name) AS name", "cast(NULL AS string) AS segment", "c_acctbal + 1 AS balance", "CASE WHEN c_custkey % 4 = 0 THEN array('name', 'segment') ELSE array('balance') END AS present")
    return upsert.patch(old, new, ["id"], "present")


PATCH = """WITH o AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, c_acctbal AS balance FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 <> 0), n AS (SELECT c_custkey AS id, upper(c_name) AS name, c_acctbal + 1 AS balance FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id % 4 = 0 THEN n.name ELSE o.name END AS name, CASE WHEN n.id % 4 = 0 THEN NULL ELSE o.segment END AS segment, CASE WHEN n.id % 4 <> 0 THEN n.balance ELSE o.balance END AS balance FROM o FULL JOIN n ON o.id = n.id"""


def backfill_anti_join(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_totalprice > 450000").selectExpr("o_custkey AS id")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS id", "c_name AS name", "c_mktsegment AS segment")
    return upsert.backfill(orders, customers, ["id"])


BACKFILL = "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)"


def contacts_unpivot(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr(
        "s_suppkey AS prospect_id", "CASE WHEN s_suppkey % 2 = 0 THEN concat(lower(s_name), '@mail.test') END AS email", "CASE WHEN s_suppkey % 3 = 0 THEN concat('+34', cast(600000000 + s_suppkey AS string)) END AS phone",
        "CASE WHEN s_acctbal > 5000 THEN concat('https://wa.me/', s_suppkey) END AS whatsapp_url", "CASE WHEN s_acctbal < 0 THEN '' ELSE concat('https://book.test/', s_suppkey) END AS booking_url", "concat('https://linkedin.test/', s_suppkey) AS linkedin_url",
        "s_suppkey % 5 = 0 AS form_detected", "CASE WHEN s_suppkey % 10 = 0 THEN '' ELSE 'https://c.test/contact' END AS contact_page_url", "'https://c.test/' AS website_url")
    return upsert.contacts(rows)


CONTACTS = """WITH p AS (SELECT s_suppkey AS prospect_id, CASE WHEN s_suppkey % 2 = 0 THEN lower(s_name) || '@mail.test' END AS email, CASE WHEN s_suppkey % 3 = 0 THEN '+34' || (600000000 + s_suppkey)::varchar END AS phone,
  CASE WHEN s_acctbal > 5000 THEN 'https://wa.me/' || s_suppkey END AS whatsapp, CASE WHEN s_acctbal < 0 THEN '' ELSE 'https://book.test/' || s_suppkey END AS booking, 'https://linkedin.test/' || s_suppkey AS linkedin,
  CASE WHEN s_suppkey % 5 = 0 THEN CASE WHEN s_suppkey % 10 = 0 THEN 'https://c.test/' ELSE 'https://c.test/contact' END END AS form FROM supplier)
SELECT prospect_id, contact_type, contact_value, CASE contact_type WHEN 'email' THEN 'primary_email' WHEN 'phone' THEN 'primary_phone' WHEN 'whatsapp' THEN 'whatsapp' WHEN 'booking' THEN 'booking_link' WHEN 'linkedin' THEN 'linkedin_profile' ELSE 'contact_form' END AS label,
  contact_type IN ('email', 'phone') AS is_primary, true AS is_public, 0.5::double AS confidence FROM (UNPIVOT p ON email, phone, whatsapp, booking, linkedin, form INTO NAME contact_type VALUE contact_value) WHERE contact_value <> ''"""


def source_normalize(spark, sf_dir):
    raw = "CASE pmod(doc_id, 9) WHEN 0 THEN 'ddg' WHEN 1 THEN 'brave' WHEN 2 THEN 'mock' WHEN 3 THEN 'verification' WHEN 4 THEN 'url_list' WHEN 5 THEN 'google_search' WHEN 6 THEN '' WHEN 7 THEN 'enrichment' ELSE source END"
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.expr(raw).alias("raw"))
    return rows.groupBy("raw", F.expr(upsert.source_type("raw")).alias("source_type"), F.expr(upsert.discovery_method("raw")).alias("discovery_method")).agg(F.count("*").alias("n"))


SOURCE_NORMALIZE = """SELECT raw, CASE raw WHEN 'ddg' THEN 'duckduckgo_search' WHEN 'brave' THEN 'brave_search' WHEN 'mock' THEN 'mock_search' WHEN 'verification' THEN 'manual' WHEN 'url_list' THEN 'seed_url' WHEN 'enrichment' THEN 'enrichment' END AS source_type,
  CASE raw WHEN 'ddg' THEN 'search_query' WHEN 'verification' THEN 'manual' WHEN 'url_list' THEN 'seed_url' WHEN 'enrichment' THEN 'enrichment' END AS discovery_method, count(*) AS n
FROM (SELECT CASE doc_id % 9 WHEN 0 THEN 'ddg' WHEN 1 THEN 'brave' WHEN 2 THEN 'mock' WHEN 3 THEN 'verification' WHEN 4 THEN 'url_list' WHEN 5 THEN 'google_search' WHEN 6 THEN '' WHEN 7 THEN 'enrichment' ELSE source END AS raw FROM documents) GROUP BY ALL"""


def final_score_blend(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "CASE WHEN l_linestatus = 'F' THEN 'ai' ELSE 'heuristic' END AS selected_method", "l_quantity / 50D AS ai_score", "CASE l_returnflag WHEN 'A' THEN 'high' WHEN 'N' THEN 'medium' ELSE 'low' END AS ai_confidence",
        "l_discount * 10D AS heuristic_score", "CASE WHEN l_tax > 0.05D THEN 'high' WHEN l_tax > 0.02D THEN 'medium' ELSE 'low' END AS heuristic_confidence", "cast(NULL AS string) AS heuristic_summary",
        "CASE WHEN l_linenumber = 1 THEN 0D ELSE 1D - l_tax * 0.1237D END AS score_multiplier", "CASE WHEN l_suppkey % 2 = 0 THEN 0.55D END AS score_cap")
    df = scoring.final_score(rows)
    return df.select("l_orderkey", "l_partkey", "l_suppkey", F.expr("cast(bround(final_score * 10000, 0) AS bigint)").alias("final_points"), "final_confidence", "strategy", F.expr("bround(ai_weight, 2)").alias("ai_weight"), "agreement_band")


FINAL_SCORE = """WITH r AS (SELECT *, l_linestatus = 'F' AS ai, l_quantity / 50.0::double AS a, l_discount * 10.0::double AS h, CASE l_returnflag WHEN 'A' THEN 0.75::double WHEN 'N' THEN 0.6::double ELSE 0.45::double END AS w0,
  CASE l_returnflag WHEN 'A' THEN 0.85::double WHEN 'N' THEN 0.6::double ELSE 0.35::double END AS ac, CASE WHEN l_tax > 0.05 THEN 'high' WHEN l_tax > 0.02 THEN 'medium' ELSE 'low' END AS hc, CASE WHEN l_linenumber = 1 THEN 1.0::double ELSE 1.0::double - l_tax * 0.1237::double END AS m, CASE WHEN l_suppkey % 2 = 0 THEN 0.55::double END AS cap FROM lineitem),
d AS (SELECT *, abs(a - h) AS delta FROM r), w AS (SELECT *, least(greatest(w0 + CASE WHEN delta <= 0.15::double THEN 0.1::double WHEN delta >= 0.4::double THEN -0.15::double ELSE 0.0::double END, 0.35::double), 0.85::double) AS aw FROM d), b AS (SELECT *, round_even(1.0::double - aw, 4) AS hw FROM w),
f AS (SELECT *, CASE WHEN ai THEN a * aw + h * hw ELSE h END * m AS base, CASE hc WHEN 'high' THEN 0.85::double WHEN 'medium' THEN 0.6::double ELSE 0.35::double END AS hcn FROM b), g AS (SELECT *, ac * aw + hcn * hw AS mixed0 FROM f), k AS (SELECT *, CASE WHEN delta > 0.3::double THEN least(mixed0, 0.68::double) ELSE mixed0 END AS mixed FROM g)
SELECT l_orderkey, l_partkey, l_suppkey, cast(round_even(round_even(CASE WHEN cap IS NULL THEN base ELSE least(base, cap) END, 4) * 10000, 0) AS bigint) AS final_points, CASE WHEN NOT ai THEN hc WHEN mixed >= 0.78::double THEN 'high' WHEN mixed >= 0.5::double THEN 'medium' ELSE 'low' END AS final_confidence,
  CASE WHEN ai THEN 'hybrid' ELSE 'heuristic_only' END AS strategy, CASE WHEN ai THEN round_even(round_even(aw, 4), 2) ELSE 0.0::double END AS ai_weight, CASE WHEN ai THEN CASE WHEN delta <= 0.15::double THEN 'high' WHEN delta <= 0.3::double THEN 'medium' ELSE 'low' END END AS agreement_band FROM k"""


def budget_targets(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS job_id", "cast(o_orderkey % 13 AS int) AS target", "cast(o_custkey % 7 AS int) AS legacy", "CASE WHEN o_orderkey % 4 = 0 THEN cast(o_orderkey % 30 AS int) END AS asked", "cast(o_custkey % 4 AS int) AS seeds")
    df = rows.withColumns({"goal": F.expr(synthesis.capture_target("legacy", "target")), "cap": F.expr(synthesis.capture_cap("legacy", "target", "asked", "seeds"))})
    return df.select("job_id", F.col("goal").cast("bigint").alias("goal"), F.col("cap").cast("bigint").alias("cap"), F.expr(f"cast({synthesis.batch_size('goal', 'cap')} AS bigint)").alias("batch"), F.expr(f"cast({synthesis.discovery_budget('goal', 'cap', 'cap - seeds')} AS bigint)").alias("budget"))


BUDGET = """WITH r AS (SELECT o_orderkey AS job_id, o_orderkey % 13 AS target, o_custkey % 7 AS legacy, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 30 END AS asked, o_custkey % 4 AS seeds FROM orders), g AS (SELECT *, coalesce(nullif(target, 0), nullif(legacy, 0), 1) AS goal FROM r),
c AS (SELECT *, greatest(CASE WHEN asked IS NOT NULL THEN asked WHEN seeds > 0 THEN seeds ELSE greatest(5, 4 * goal) END, CASE WHEN seeds > 0 THEN least(seeds, goal) ELSE goal END) AS cap FROM g), b AS (SELECT *, CASE WHEN cap <= 0 THEN 0 ELSE least(cap, greatest(3, least(5, goal + 1))) END AS batch FROM c)
SELECT job_id, cast(goal AS bigint) AS goal, cast(cap AS bigint) AS cap, cast(batch AS bigint) AS batch, cast(CASE WHEN cap - seeds <= 0 OR cap <= 0 THEN 0 ELSE least(cap - seeds, greatest(5, 2 * batch)) END AS bigint) AS budget FROM b"""

QUERIES = {
    "job_results_page": (job_results_page, JOB_RESULTS_PAGE), "job_logs_page": (job_logs_page, JOB_LOGS_PAGE), "recent_errors_top3": (recent_errors_top3, RECENT_ERRORS), "last_event_per_job": (last_event_per_job, LAST_EVENT),
    "quality_summary": (quality_summary, QUALITY_SUMMARY), "rejection_histogram": (rejection_histogram, REJECTIONS), "capture_summary": (capture_summary, CAPTURE_SUMMARY), "operational_summary": (operational_summary, OPERATIONAL_SUMMARY),
    "operational_metrics": (operational_metrics, OPERATIONAL_METRICS), "commercial_summary": (commercial_summary, COMMERCIAL_SUMMARY), "commercial_metrics": (commercial_metrics, COMMERCIAL_METRICS), "ai_usage_summary": (ai_usage_summary, AI_USAGE),
    "capture_prefix_stop": (capture_prefix_stop, CAPTURE_PREFIX), "incremental_unseen": (incremental_unseen, INCREMENTAL), "upsert_latest": (upsert_latest, UPSERT_LATEST), "patch_present": (patch_present, PATCH), "backfill_anti_join": (backfill_anti_join, BACKFILL),
    "contacts_unpivot": (contacts_unpivot, CONTACTS), "source_normalize": (source_normalize, SOURCE_NORMALIZE), "final_score_blend": (final_score_blend, FINAL_SCORE), "budget_targets": (budget_targets, BUDGET),
}
