"""Plan shaping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def barrier(df: DataFrame) -> DataFrame:
    """The same rows behind a generator, through which the optimizer neither merges projections nor pushes filters.

    Long chains of rules otherwise get copied into every place that names their result, and planning time explodes. The outer form,
    since of the other one Catalyst infers a filter on the array's size, and works out all of its expressions twice.
    """
    return df.select(F.inline_outer(F.array(F.struct(*(F.col(f"`{c}`") for c in df.columns)))))


def shared(df: DataFrame, key: str) -> DataFrame:
    """The same rows dealt by key, in an exchange that several uses in one plan read: no use can prune its columns."""
    packed = df.select(key, F.array(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("row_"))
    return packed.repartition(key).select(F.inline_outer("row_"))


def spread(df: DataFrame) -> DataFrame:
    """A table as it was read, dealt out evenly if it lies in fewer partitions than there are cores; a large one never does."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
