"""Metrics kept up to date: one summary per job in a store, worked out anew for jobs that a change touches and for no others.

Rates are rounded per job, so global rows are means over job summaries and can't be merged from parts of a job; a job's summary is the smallest
state that can be. A change brings rows of jobs and the jobs' own counters; the rows that its jobs have already are read from their buckets,
and the new rows and summaries become visible in one commit. The global rows are aggregates over the summaries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import written
from ..sinks.store import Store, Table
from . import kpi
from .upsert import upsert

SUMMARY = (
    "job_id bigint, status string, accepted_count bigint, needs_review_count bigint, rejected_count bigint, candidates_processed bigint, candidates_discovered bigint, acceptance_rate double,"
    " candidate_dropoff_by_reason map<string,bigint>, completed_with_zero_accepted boolean, candidates_per_accepted double, article_exclusion_count bigint, directory_exclusion_count bigint,"
    " article_directory_exclusion_ratio double, accepted_target_count bigint, accepted_related_count bigint, rejected_non_target_count bigint, inconsistent_contact_count bigint,"
    " false_phone_filtered_count bigint, accepted_target_precision double, total_processed bigint"
)


def tables(rows: str, jobs: str, keys: tuple[str, ...], buckets: int = 64) -> dict[str, Table]:
    """Rows of jobs by keys, the jobs, and their summaries; all in buckets of the job."""
    by = ("job_id",)
    return {"rows": Table(rows, keys, kept=(), buckets=buckets, by=by), "jobs": Table(jobs, by, kept=(), buckets=buckets), "summaries": Table(SUMMARY, by, kept=(), buckets=buckets)}


def update(store: Store, rows: DataFrame, jobs: DataFrame, exclusions: DataFrame, writer: str = "metrics", number: int | None = None) -> bool:
    """Take in rows and jobs (either may be empty). exclusions: (job_id, reason, n) of all jobs, as they are now."""
    touched = written(rows.select("job_id").union(jobs.select("job_id")).distinct(), "touched")
    spec = store.tables["rows"]
    of_jobs = lambda name: store.read_keys(name, touched, ["job_id"])
    all_rows = written(upsert(of_jobs("rows"), rows.select(spec.schema.names), list(spec.keys), list(spec.order), []), "rows")
    all_jobs = written(upsert(of_jobs("jobs"), jobs.select(store.tables["jobs"].schema.names), ["job_id"], [], []), "jobs")
    operational = kpi.operational_summary(kpi.capture_summary(all_jobs, all_rows), exclusions)
    summary = operational.join(kpi.commercial_summary(all_rows), "job_id", "left").join(all_jobs.select("job_id", "total_processed"), "job_id", "left")
    return store.commit({"rows": rows.select(spec.schema.names), "jobs": all_jobs, "summaries": summary}, writer, number)


def operational_metrics(store: Store) -> DataFrame:
    return kpi.operational_metrics(store.read("summaries"))


def commercial_metrics(store: Store) -> DataFrame:
    kept = store.read("summaries")
    return kpi.commercial_metrics(kept, kept.drop("total_processed"))
