"""Streaming forms: windowed counts of logs, deduplicated hits, capture with keyed state. Upserts of a stream: sinks.store.sink."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def log_counts(logs: DataFrame, late: str = "10 minutes", window: str = "1 day") -> DataFrame:
    """Counts per window and level. Event times without a zone are read as session time first, as watermarks need it."""
    rows = logs.withColumn("at", F.col("created_at").cast("timestamp")).withWatermark("at", late)
    return rows.groupBy(F.window("at", window), "level").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "level", "n")


def unique_hits(hits: DataFrame, late: str = "1 hour") -> DataFrame:
    """First hit of each job and URL, state kept as long as duplicates may come."""
    return hits.withWatermark("found_at", late).dropDuplicatesWithinWatermark(["job_id", "url"])


def capture(candidates: DataFrame, target: int, cap: int) -> DataFrame:
    """Candidates a capture still takes, job by job in order of arrival, with accepted and processed counts as state.

    candidates: job_id bigint, rank bigint, accepted boolean. Rows of one micro-batch are taken by rank and held by one task
    a job; discovery.follow keeps its states in a table, cuts batches before their rows meet, and streams.
    """

    def step(key, batches, state: GroupState):
        accepted, processed = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches), ignore_index=True).sort_values("rank", kind="stable")
        out = []
        for r in rows.itertuples():
            if accepted >= target or processed >= cap:
                break
            processed += 1
            out.append((key[0], r.rank, bool(r.accepted), processed))
            accepted += bool(r.accepted)
        state.update((accepted, processed))
        yield pd.DataFrame(out, columns=["job_id", "rank", "accepted", "processed_order"])

    return candidates.groupBy("job_id").applyInPandasWithState(step, "job_id bigint, rank bigint, accepted boolean, processed_order bigint", "accepted bigint, processed bigint", "append", GroupStateTimeout.NoTimeout)
