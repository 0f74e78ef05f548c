"""Stand-ins: the engine's tables as projections of the generic test tables, in Spark and, word for word, in SQL.

They exercise operators; they carry no business meaning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

JOBS = """SELECT o_orderkey AS job_id, o_orderdate AS created_at,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'pending' END AS status FROM orders"""

JOB_PROSPECTS = """SELECT l_orderkey AS job_id, l_suppkey AS prospect_id, cast(l_linenumber AS bigint) AS rank_position, l_partkey AS part_id,
  CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'N' THEN 'needs_review' ELSE 'rejected' END AS quality_status,
  CASE WHEN l_returnflag = 'R' AND l_quantity < 25 THEN 'low_contact_quality' WHEN l_returnflag = 'R' THEN 'geo_mismatch' WHEN l_returnflag = 'N' THEN 'geo_unknown' END AS rejection_reason,
  CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'accepted_target' WHEN l_returnflag = 'A' THEN 'accepted_related' WHEN l_returnflag = 'N' THEN 'rejected_low_confidence'
       WHEN l_linestatus = 'F' THEN 'rejected_directory' ELSE 'rejected_media' END AS acceptance_decision,
  CASE WHEN l_tax > 0.06 THEN 'inconsistent' WHEN l_tax < 0.02 THEN 'consistent' ELSE '' END AS contact_consistency_status,
  CASE WHEN l_quantity > 40 THEN concat('{"invalid_phone_candidates_count": ', cast(cast(l_quantity AS bigint) - 40 AS string), '}')
       WHEN l_quantity > 30 THEN concat('{"phone_validation_rejections": {"date_like": ', cast(cast(l_linenumber AS bigint) AS string), ', "invalid_length": 2}}') END AS raw_extraction,
  l_discount AS match_score, l_shipdate AS created_at, l_quantity AS quantity, l_extendedprice AS price, l_tax AS tax FROM lineitem"""

PROSPECTS = """SELECT s_suppkey AS id, s_name AS company_name, n_name AS country, s_acctbal AS score,
  CASE WHEN s_nationkey % 2 = 0 THEN 'consistent' ELSE 'unknown' END AS contact_consistency_status FROM supplier JOIN nation ON s_nationkey = n_nationkey"""

LOGS = """SELECT event_id AS id, user_id AS job_id, ts AS created_at, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
  event_type AS message, props AS context FROM events"""

#: Totals of a job derived from its rows, for jobs without rows too.
TOTALS = """SELECT job_id, status, created_at, n + job_id % 3 AS total_processed, n + job_id % 5 AS total_found, job_id % 3 AS total_failed, job_id % 2 AS total_skipped
  FROM (SELECT j.job_id, j.status, j.created_at, count(p.prospect_id) AS n FROM jobs j LEFT JOIN job_prospects p ON j.job_id = p.job_id GROUP BY j.job_id, j.status, j.created_at) t"""

_SOURCES = {"jobs": ["orders"], "job_prospects": ["lineitem"], "prospects": ["supplier", "nation"], "logs": ["events"]}
_TEXT = {"jobs": JOBS, "job_prospects": JOB_PROSPECTS, "prospects": PROSPECTS, "logs": LOGS}


def adapter(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "totals":
        text = TOTALS.replace("FROM jobs j", "FROM {jobs} j").replace("JOIN job_prospects p", "JOIN {job_prospects} p")
        return spark.sql(text, jobs=adapter(spark, sf_dir, "jobs"), job_prospects=adapter(spark, sf_dir, "job_prospects"))
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _SOURCES[name]}
    text = _TEXT[name].replace("{", "{{").replace("}", "}}")
    for t in tables:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    return spark.sql(text, **tables)


def with_sql(*names: str) -> str:
    """WITH clause of the adapters for the SQL side."""
    text = _TEXT | {"totals": TOTALS}
    return "WITH " + ", ".join(f"{n} AS ({text[n].replace(' AS string)', ' AS varchar)')})" for n in names) + " "
