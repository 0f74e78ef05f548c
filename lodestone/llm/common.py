"""Shared pieces of the training-data operators: shared storage, streaming groups, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.plan import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's own checkpoint folder.

    Only a local master, whose executors are the driver, may do without: it gets a temporary folder.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found and context.master.startswith("local"):
        found = f"{tempfile.gettempdir()}/lodestone-checkpoints"
    if not found:
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors.

    Written with Spark's committer, so retried and speculative tasks leave whole files only. All tables of an application
    lie in one folder of its own, which can go once its results are written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def most_frequent(counts: DataFrame, column: str, most: int) -> DataFrame:
    """At most `most` rows of counts: those above the least level that leaves no more, out of a histogram of a few hundred levels.

    An ordered limit would send that many rows of every partition to one place; this sends the histogram. A level whose
    rows would be too many goes whole, so fewer rows than asked for may come.
    """
    level = F.floor(F.log2(F.col(column)) * 16)
    levels = sorted(counts.where(F.col(column) > 0).groupBy(level.alias("l")).count().collect(), key=lambda r: -r["l"])
    least, n = None, 0
    for r in levels:
        if (n := n + r["count"]) > most:
            break
        least = r["l"]
    return counts.where((F.col(column) > 0) & (level >= least)) if least is not None else counts.limit(0)


HOT_SHARE = 1000


def with_groups(rows: DataFrame, groups: DataFrame, keys: list[str], count: str) -> DataFrame:
    """rows joined with groups on keys; count: how many rows of rows a group has.

    A key with more than a HOT_SHARE-th of the groups' rows would weigh on one task. There are fewer than HOT_SHARE of them, so
    they are broadcast and their rows stay where they are; the others are joined by key.
    """
    groups = materialize(groups, "groups")
    least = max(groups.agg(F.sum(count)).first()[0] or 0, 1) // HOT_SHARE
    hot, others = groups.where(F.col(count) > least), groups.where(F.col(count) <= least)
    of_hot = F.broadcast(hot.select(keys))
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(of_hot, keys, "left_anti").join(others, keys))


def runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of consecutive rows with one key, out of batches sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = batch.column(key).to_pylist()
        start = 0
        for i, k in enumerate(keys):
            if held or i > start:
                if k != last:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    yield pa.Table.from_batches(held)
                    held, start = [], i
            last = k
        if start < len(keys):
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def per_key(df: DataFrame, key: str, fn: Callable[[pa.Table], pa.Table | None], schema: str) -> DataFrame:
    """Apply fn to the rows of each key, one key in memory at a time.

    Unlike applyInPandas there is no fixed cost per group, which matters for many tiny groups.
    """

    def work(batches):
        for part in runs(batches, key):
            out = fn(part)
            if out is not None and out.num_rows:
                yield from out.to_batches()

    return df.repartition(F.col(key)).sortWithinPartitions(key).mapInArrow(work, schema)


LEAST_BITS, MOST_BITS, BITS_A_KEY = 1 << 20, 1 << 29, 12  # a filter has 128 KB to 64 MB; a full one lets everything through, which costs time and no results


def _slots(keys: list[bytes], bits: int) -> np.ndarray:
    """Four bits for each key of 16 random bytes."""
    return np.frombuffer(b"".join(keys), "<u4").reshape(-1, 4) % np.uint32(bits)


def in_bloom(bits: bytes, keys: list[bytes]) -> np.ndarray:
    at = _slots(keys, 8 * len(bits))
    return ((np.frombuffer(bits, np.uint8)[at >> 3] >> (at & 7)) & 1).all(1)


def bloom(keys: DataFrame) -> bytes:
    """A Bloom filter over the first column, 16-byte digests; sized by their number (45 million before it fills up), or-ed block by block on the executors."""
    size_bits = 1 << max(LEAST_BITS, min(MOST_BITS, BITS_A_KEY * keys.count())).bit_length() - 1
    blocks = max(32, size_bits // 8 >> 16)
    size = size_bits // 8 // blocks

    def build(batches):
        bits = np.zeros(size_bits // 8, np.uint8)
        for batch in batches:
            at = _slots(batch.column(0).to_pylist(), size_bits).ravel()
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        for b in range(blocks):
            if (part := bits[b * size : (b + 1) * size]).any():
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["block", "bits"])

    def merge(part: pa.Table) -> pa.Table:
        total = np.zeros(size, np.uint8)
        for x in part.column("bits").to_pylist():
            total |= np.frombuffer(x, np.uint8)
        return pa.table([pa.array([part.column("block")[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "bits"])

    bits = bytearray(size_bits // 8)
    for row in per_key(keys.mapInArrow(build, "block int, bits binary"), "block", merge, "block int, bits binary").collect():
        bits[row["block"] * size : (row["block"] + 1) * size] = row["bits"]
    return bytes(bits)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of edges(u, v), by repeated contraction of each node into its least neighbour.

    Every round is a min-aggregate with map-side combine and equi-joins, so a node with very many
    neighbours costs no more than its rows; the number of rounds is logarithmic in practice.
    """
    both = edges.select("u", "v").where("u <> v")
    left = materialize(both.unionByName(both.selectExpr("v AS u", "u AS v")).distinct(), name)
    assign = left.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    while not left.isEmpty():
        parent = left.groupBy("u").agg(F.min("v").alias("v")).selectExpr("u AS k", "least(u, v) AS p")
        parent = materialize(parent, name)
        assign = materialize(assign.join(parent, assign["root"] == parent["k"], "left").selectExpr("node", "coalesce(p, root) AS root"), name)
        a, b = parent.selectExpr("k AS u", "p AS pu"), parent.selectExpr("k AS v", "p AS pv")
        left = materialize(left.join(a, "u").join(b, "v").where("pu <> pv").selectExpr("pu AS u", "pv AS v").distinct(), name)
    return assign
