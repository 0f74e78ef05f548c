"""A plan of stages that can be taken up again: what is whole is read, what is missing is done.

Every stage has a digest of the plan's parameters, its name and the digest of the stage before, so a change anywhere makes all later stages new.
A stage writes its table to a folder of its own and then its line in the ledger, a table of the store; a run that stops between or within stages
leaves the lines of whole stages, and the next run with the same parameters reads their tables and goes on behind them.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import new_folder
from ..operators import hits as hit_rules
from ..operators import synthesis
from ..sinks.store import Store, Table
from ..sources import providers

LEDGER = {"ledger": Table("run string, stage string, digest string, path string, rows bigint", ("run", "stage"), kept=(), buckets=4)}


class Ledger:
    def __init__(self, store: Store, run: str, parameters: dict):
        self.store, self.run = store, run
        self.digest = hashlib.sha256(json.dumps([run, parameters], sort_keys=True).encode()).hexdigest()
        self.done: list[str] = []  # stages that this run worked out itself

    def stage(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        spark = self.store.spark
        self.digest = hashlib.sha256(f"{self.digest}/{name}".encode()).hexdigest()
        line = self.store.read("ledger").where((F.col("run") == self.run) & (F.col("stage") == name) & (F.col("digest") == self.digest)).first()
        if line is None:
            path = new_folder(spark, name)
            df = build()
            df.write.option("compression", "zstd").parquet(path)
            made = spark.read.parquet(path)
            self.store.commit({"ledger": spark.createDataFrame([(self.run, name, self.digest, path, made.count())], self.store.tables["ledger"].schema)}, f"ledger-{self.run}")
            self.done.append(name)
            return made
        return spark.read.parquet(line["path"])


def create_jobs(ledger: Ledger, jobs: DataFrame, search: Callable[[DataFrame], DataFrame], order: list[str], cap: str = "cap") -> dict[str, DataFrame]:
    """Jobs with their first candidates: queries, the hits of the first provider that has any, first of each URL, rows to insert.

    jobs: job_id, cap and the columns that synthesis reads. search: (job_id, ordinal, query) to hits (job_id, ordinal, query, provider, url,
    exclusion_reason). Returns the stages; `insert` has one row per job with its counters and its candidates in order, at most `cap`.
    """
    queries = ledger.stage("queries", lambda: synthesis.build_queries(jobs).select("job_id", cap, F.posexplode(F.expr(synthesis.flatten_batches("query_batches"))).alias("ordinal", "query")))
    found = ledger.stage("search", lambda: providers.provider_chain(search(queries.drop(cap)), order))
    unique = ledger.stage("unique", lambda: hit_rules.dedupe(found.drop("exclusion_reason"), "url", ["ordinal"], ["job_id"]))

    def insert() -> DataFrame:
        caps = jobs.select("job_id", cap).distinct()
        kept = unique.join(caps, "job_id").where(F.col("position") <= F.col(cap))
        per_job = kept.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct(F.col("position").cast("bigint").alias("position"), "url"))).alias("candidates"), F.min("provider").alias("provider"))  # at most `cap` of a job
        gone = unique.groupBy("job_id").agg(F.count_if(F.col("exclusion_reason").isNotNull()).alias("duplicates"))
        rows = jobs.select("job_id").join(per_job, "job_id", "left").join(gone, "job_id", "left")
        found_ = F.coalesce(F.size("candidates"), F.lit(0))
        return rows.select("job_id", "provider", F.when(found_ > 0, "pending").otherwise("completed").alias("status"), F.when(F.size("candidates") > 0, F.size("candidates")).otherwise(0).cast("bigint").alias("total_found"), F.coalesce("duplicates", F.lit(0)).alias("duplicates"), "candidates")

    return {"queries": queries, "search": found, "unique": unique, "insert": ledger.stage("insert", insert)}
