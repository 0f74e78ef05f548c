"""Pages by place: rows of many jobs clustered in their order, so that any page of a job is one short range of one table.

cluster() writes rows by ranges of (job, order), each range sorted, with column `place`, which grows along the whole order. A page is a range of
places; bookmarks() holds the first place of every page. Reading page n looks up two numbers and scans with `place` between them, which Parquet's
statistics narrow to the files and row groups of that range: no page costs more than another, where an offset reads and sorts all rows before it.

Cases: null jobs and nulls in the order are rows like others (the order says where they stand); ties keep one order, as places are fixed once written;
pages beyond the last are empty; an empty table has no bookmarks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import written

IN_PART = (1 << 33) - 1


def cluster(rows: DataFrame, job: str, order: list[Column]) -> DataFrame:
    """rows written in ranges of (job, order) with column place. order: column expressions with their direction."""
    by = [F.asc_nulls_first(job), *order]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    return written(placed.withColumn("place", F.monotonically_increasing_id()), "clustered")


def bookmarks(clustered: DataFrame, job: str, size: int) -> DataFrame:
    """(job, page, place): where each page of `size` rows begins. Ranks come from places and counts of partitions, without sorting again."""
    part = F.shiftright("place", 33).alias("part_")
    counts = clustered.groupBy(part).count()
    before = counts.select("part_", F.coalesce(F.sum("count").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    ranked = clustered.select(job, "place", part).join(F.broadcast(before), "part_").withColumn("n_", F.col("before_") + F.col("place").bitwiseAND(IN_PART))  # one row per partition goes out
    start = ranked.groupBy(job).agg(F.min("n_").alias("start_")).withColumnRenamed(job, "job_")
    of_job = ranked.join(start, F.col(job).eqNullSafe(F.col("job_"))).withColumn("i_", F.col("n_") - F.col("start_"))
    return written(of_job.where(F.col("i_") % size == 0).select(job, (F.col("i_") / size).cast("bigint").alias("page"), "place"), "bookmarks")


def page(clustered: DataFrame, marks: DataFrame, job: str, value, number: int, size: int) -> DataFrame:
    """Page `number` (from 0) of one job, in order."""
    found = marks.where(F.col(job).eqNullSafe(F.lit(value)) & (F.col("page") == number)).select("place").collect()
    if not found:
        return clustered.limit(0).drop("place")
    # a page may go on in the next partition, whose places start anew: it ends where the next page or job begins
    least = found[0][0]
    after = marks.where(F.col("place") > least).agg(F.min("place")).first()[0]
    rows = clustered.where(F.col("place") >= least)
    rows = rows if after is None else rows.where(F.col("place") < after)
    return rows.orderBy("place").limit(size).drop("place")


def pages(clustered: DataFrame, marks: DataFrame, job: str, number: int) -> DataFrame:
    """Page `number` of every job: its rows by an equi-join on the job and a range of places."""
    ends = Window.partitionBy(job).orderBy("place")
    spans = marks.withColumn("end_", F.lead("place").over(ends)).where(F.col("page") == number).select(F.col(job).alias("job_"), F.col("place").alias("from_"), "end_")
    inside = F.col(job).eqNullSafe(F.col("job_")) & (F.col("place") >= F.col("from_")) & (F.col("end_").isNull() | (F.col("place") < F.col("end_")))
    return clustered.join(spans, inside).drop("job_", "from_", "end_", "place")
