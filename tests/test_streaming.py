import pytest
from pyspark.sql import functions as F

from lodestone.streaming import logs


def feed(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_windowed_counts(spark, tmp_path):
    rows = [("2024-01-01 10:00:00", "INFO"), ("2024-01-01 11:00:00", "ERROR"), ("2024-01-02 10:00:00", "INFO")]
    stream = feed(spark, tmp_path / "in", rows, "created_at string, level string")
    q = logs.log_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(str(r["start"].date()), r["level"], r["n"]) for r in spark.sql("SELECT * FROM counts").collect()} == {("2024-01-01", "INFO", 1), ("2024-01-01", "ERROR", 1), ("2024-01-02", "INFO", 1)}


def test_stateful_capture(spark, tmp_path):
    stream = feed(spark, tmp_path / "in", [(1, r, r % 2 == 0) for r in range(10)] + [(2, 0, False)], "job_id bigint, rank bigint, accepted boolean")
    q = logs.capture(stream, 2, 5).writeStream.outputMode("append").format("memory").queryName("capture").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r["job_id"], r["rank"]) for r in spark.sql("SELECT * FROM capture").collect()) == [(1, 0), (1, 1), (1, 2), (2, 0)]


@pytest.mark.parametrize("late", ["1 hour"])
def test_unique_hits(spark, tmp_path, late):
    rows = [(1, "u", "2024-01-01 10:00:00"), (1, "u", "2024-01-01 10:01:00"), (2, "u", "2024-01-01 10:02:00")]
    stream = feed(spark, tmp_path / "in", rows, "job_id int, url string, at string").withColumn("found_at", F.to_timestamp("at"))
    q = logs.unique_hits(stream, late).writeStream.outputMode("append").format("memory").queryName("unique").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("SELECT * FROM unique").count() == 2


def test_stream_of_hits_goes_on_after_a_restart(spark, tmp_path):
    from lodestone.sources.providers import HitSource

    spark.dataSource.register(HitSource)

    def run(queries):
        stream = spark.readStream.format("lodestone_hits").option("queries", "|".join(queries)).option("limit", 3).option("queriesPerBatch", 2).load()
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted((r["query"], r["ordinal"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run(["a", "b", "c"]) == [(q, i) for q in "abc" for i in range(3)]
    # the same checkpoint, more queries: nothing is lost, nothing comes twice
    assert run(["a", "b", "c", "d", "e", "f"]) == [(q, i) for q in "abcdef" for i in range(3)]
