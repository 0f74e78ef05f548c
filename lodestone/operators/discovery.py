"""Discovery in batches with feedback: what a job still takes depends on what its earlier batches found and how many of them were accepted.

A job's search batches come in order. A batch is opened only while the job has fewer accepted results than its target and fewer candidates than its
cap; it then brings the first distinct URLs up to a budget, which follows from target, cap and what is left of the cap. URLs that an earlier
batch brought are excluded (duplicate_url_reopened); the others are candidates with running positions, processed in order until the target is
reached.

Form: repeats within a batch are aggregated and each batch is cut to the largest budget that its job can have, both before the rows of a job
meet, so a job's rows in the fold are bounded by its batches times that budget, however many hits it has. The fold reads jobs from sorted partitions row
by row; its state is a few numbers and at most `cap` URLs. A state can be kept and taken up again: run(state=...) goes on where it ended, so
batches may come in several runs or as a stream (follow), with the results of one run over all of them.

Cases: null URLs are dropped; null `accepted` counts as not accepted; a job without a row in jobs, or without target, has target 1, and
without cap four times its target, at least 5; hits of equal rank go by URL; a null job is a job like others.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import written
from . import synthesis

ROWS = "job_id bigint, batch int, rank bigint, url string, copies bigint, accepted boolean, status string, position bigint, processed_order bigint"
STATE = "job_id bigint, target bigint, cap bigint, found bigint, processed bigint, accepted_count bigint, batch int, taken bigint, budget bigint, here array<string>, seen array<string>"
_ALL = f"kind int, {ROWS}, target bigint, cap bigint, found bigint, processed bigint, accepted_count bigint, taken bigint, budget bigint, here array<string>, seen array<string>"


def _names(columns: str) -> list[str]:
    return [x.split(" ")[0] for x in columns.split(", ")]


class Capture:
    """State of one job."""

    def __init__(self, target: int, cap: int, batch_budget: int):
        self.target, self.cap, self.batch_budget = target, cap, batch_budget
        self.found = self.processed = self.accepted = self.taken = self.budget = 0
        self.batch: int | None = None
        self.here: set[str] = set()
        self.seen: set[str] = set()

    def step(self, batch: int, url: str, accepted: bool) -> tuple[str, int | None, int | None]:
        """Status, position and processed order of the next hit."""
        if batch != self.batch:
            done = self.accepted >= self.target or self.found >= self.cap
            self.batch, self.taken, self.here = batch, 0, set()
            self.budget = 0 if done else min(self.cap - self.found, self.batch_budget)
        if self.budget <= 0:
            return "not_reached", None, None
        if url in self.here:
            return "duplicate_url", None, None
        if self.taken >= self.budget:
            return "beyond_budget", None, None
        self.taken += 1
        self.here.add(url)
        if url in self.seen:
            return "duplicate_url_reopened", None, None
        self.seen.add(url)
        self.found += 1
        if self.accepted >= self.target or self.processed >= self.cap:
            return "found", self.found, None
        self.processed += 1
        self.accepted += accepted
        return "processed", self.found, self.processed


def _limits(jobs: DataFrame) -> DataFrame:
    """(job_id, target, cap, most): the budget of a batch before the cap's rest is counted."""
    df = jobs.selectExpr("job_id", f"cast({synthesis.capture_target('CAST(NULL AS bigint)', 'target')} AS bigint) AS target", "cast(cap AS bigint) AS cap")
    df = df.withColumn("cap", F.expr(f"coalesce(cap, cast({synthesis.candidate_cap('target')} AS bigint))"))
    return df.withColumn("most", F.expr(f"cast({synthesis.discovery_budget('target', 'cap', 'cap')} AS bigint)"))


def run(hits: DataFrame, jobs: DataFrame, state: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Hits with their status, and the state of every job with hits.

    hits: job_id, batch, rank, url, accepted. jobs: job_id, target, cap. state: what an earlier run returned.
    """
    one = hits.where("url IS NOT NULL").groupBy("job_id", "batch", "url").agg(F.min(F.struct("rank", F.coalesce("accepted", F.lit(False)).alias("accepted"))).alias("first"), F.count("*").alias("copies"))
    known = one.select("job_id").distinct().join(_limits(jobs).withColumnRenamed("job_id", "job"), F.col("job_id").eqNullSafe(F.col("job")), "left").drop("job")
    known = known.selectExpr("job_id AS job", "coalesce(target, 1L) AS target", "coalesce(cap, 5L) AS cap", "coalesce(most, 5L) AS most")
    rows = one.select("job_id", "batch", "first.rank", "url", "copies", "first.accepted").join(known, F.col("job_id").eqNullSafe(F.col("job"))).drop("job")
    place = Window.partitionBy("job_id", "batch").orderBy("rank", "url")
    # a batch taken up again may have brought `most` before, so its URLs are not cut by this run's rank alone but by no less than it
    rows = rows.withColumn("n_", F.row_number().over(place)).where(F.col("n_") <= F.col("most")).drop("n_")
    fields = ["target", "cap", "found", "processed", "accepted_count", "taken", "budget", "here", "seen"]
    nulls = {"found": "bigint", "processed": "bigint", "accepted_count": "bigint", "taken": "bigint", "budget": "bigint", "here": "array<string>", "seen": "array<string>"}
    feed = rows.select(F.lit(1).alias("kind"), "job_id", "batch", "rank", "url", "copies", "accepted", "most", "target", "cap", *(F.lit(None).cast(t).alias(c) for c, t in nulls.items()))
    if state is not None:
        held = state.join(known.select("job", "most"), F.col("job_id").eqNullSafe(F.col("job"))).drop("job")
        feed = feed.unionByName(held.select(F.lit(0).alias("kind"), "job_id", "batch", F.lit(None).cast("bigint").alias("rank"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("bigint").alias("copies"), F.lit(None).cast("boolean").alias("accepted"), "most", *fields))
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(c, kinds[t]) for c, t in (x.split(" ") for x in _ALL.split(", "))])

    def work(batches):
        job, has, capture = None, False, None

        def saved() -> dict:
            # a budget of 0 means that nothing is opened any more
            lists = {"here": sorted(capture.here), "seen": sorted(capture.seen) if capture.budget > 0 else []}
            return {"kind": 0, "job_id": job, "batch": capture.batch, "target": capture.target, "cap": capture.cap, "found": capture.found, "processed": capture.processed, "accepted_count": capture.accepted, "taken": capture.taken, "budget": capture.budget, **lists}

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if not has or r["job_id"] != job:
                    if has:
                        out.append(saved())
                    job, has, capture = r["job_id"], True, Capture(r["target"], r["cap"], r["most"])
                if r["kind"] == 0:
                    capture.target, capture.cap, capture.found, capture.processed, capture.accepted = r["target"], r["cap"], r["found"], r["processed"], r["accepted_count"]
                    capture.batch, capture.taken, capture.budget, capture.here, capture.seen = r["batch"], r["taken"], r["budget"], set(r["here"]), set(r["seen"])
                    continue
                status, position, order = capture.step(r["batch"], r["url"], r["accepted"])
                out.append({"kind": 1, **{c: r[c] for c in ("job_id", "batch", "rank", "url", "copies", "accepted")}, "status": status, "position": position, "processed_order": order})
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if has:
            yield pa.RecordBatch.from_pylist([saved()], schema=schema)

    dealt = feed.repartition("job_id").sortWithinPartitions("job_id", "kind", "batch", "rank", "url")
    both = written(dealt.mapInArrow(work, _ALL), "discovery")
    decided = both.where("kind = 1").select(*_names(ROWS))
    return decided, both.where("kind = 0").select(*_names(STATE))


def summary(state: DataFrame) -> DataFrame:
    """(job_id, found, processed, accepted, stop_reason) of jobs whose batches have all come."""
    from .kpi import stop_reason

    return state.select("job_id", "found", "processed", F.col("accepted_count").alias("accepted"), F.expr(stop_reason("accepted_count", "target", "processed", "cap", "found")).alias("stop_reason"))


def follow(stream: DataFrame, jobs: DataFrame, store, checkpoint: str, writer: str = "discovery"):
    """The same over a stream of hits whose batches come in order: decisions and states are tables `discovery` and `discovery_state` of the store.

    A micro-batch reads the states of its jobs only, and its rows and states become visible in one commit; done twice it counts once.
    """

    def step(hits: DataFrame, n: int) -> None:
        if store.state().writers.get(writer, -1) >= n:
            return
        state = store.read_keys("discovery_state", hits.select("job_id").distinct())
        decided, after = run(hits, jobs, state)
        store.commit({"discovery": decided, "discovery_state": after}, writer, n)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
