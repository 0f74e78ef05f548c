import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import discovery, upsert
from lodestone.sinks.store import Conflict, State, Store, Table, sink

SCHEMA = "k bigint, v string, facts map<string,int>, seq int, created_at int"


def store_at(spark, root, buckets=8, **more):
    return Store(spark, str(root), {"a": Table(SCHEMA, ("k",), ("seq",), buckets=buckets), "b": Table(SCHEMA, ("k",), ("seq",), buckets=buckets), **more})


def rows(spark, *data):
    return spark.createDataFrame([(k, v, {"x": s}, s, c) for k, v, s, c in data], SCHEMA)


def content(df):
    return sorted(((r["k"], r["v"], r["facts"]["x"] if r["facts"] else None, r["created_at"]) for r in df.collect()), key=str)


def folders(root, name):
    return {f for f in os.listdir(root / name) if not f.startswith(".")}


def test_commit_is_all_or_nothing(spark, tmp_path):
    store = store_at(spark, tmp_path)
    assert content(store.read("a")) == [] and store.state() == State()
    assert store.commit({"a": rows(spark, (1, "x", 1, 10), (None, "n", 1, 10)), "b": rows(spark, (1, "y", 1, 10))}, "w", 0)
    before = content(store.read("a")), content(store.read("b"))
    # lost between staging and the manifest
    store.stage("a", rows(spark, (1, "lost", 9, 99)))
    store.stage("b", rows(spark, (2, "lost", 9, 99)))
    assert (content(store.read("a")), content(store.read("b"))) == before
    # a draft of a manifest that was never renamed isn't read
    (tmp_path / "_commits" / ".draft").write_text(json.dumps({"version": 9}))
    assert store.versions() == [1]
    assert store.commit({"a": rows(spark, (1, "z", 2, 20)), "b": rows(spark, (3, "w", 2, 20))}, "w", 1)
    assert content(store.read("a")) == sorted([(1, "z", 2, 10), (None, "n", 1, 10)], key=str) and content(store.read("b")) == [(1, "y", 1, 10), (3, "w", 2, 20)]
    assert content(store.read("a", version=1)) == before[0]
    lost = len(folders(tmp_path, "a"))
    assert len(store.vacuum(versions=2)) == 2 and len(folders(tmp_path, "a")) == lost - 1 and content(store.read("b")) == [(1, "y", 1, 10), (3, "w", 2, 20)]


def test_repeated_commit_counts_once(spark, tmp_path):
    store = store_at(spark, tmp_path)
    assert store.commit({"a": rows(spark, (1, "x", 1, 1))}, "job", 4)
    assert not store.commit({"a": rows(spark, (1, "again", 2, 2))}, "job", 4) and not store.commit({"a": rows(spark, (1, "old", 2, 2))}, "job", 3)
    assert store.commit({"a": rows(spark, (2, "other", 1, 1))}, "other", 0) and store.commit({}, "job", 5)
    assert content(store.read("a")) == [(1, "x", 1, 1), (2, "other", 1, 1)] and store.state().writers == {"job": 5, "other": 0}


def test_two_writers_both_get_in(spark, tmp_path, monkeypatch):
    one, two = store_at(spark, tmp_path), store_at(spark, tmp_path)
    publish, raced = Store._publish, []

    def race(self, state):
        if self is one and not raced:
            raced.append(two.commit({"a": rows(spark, (5, "two", 1, 1))}, "two", 0))
        publish(self, state)

    monkeypatch.setattr(Store, "_publish", race)
    assert one.commit({"a": rows(spark, (6, "one", 1, 1))}, "one", 0) and raced == [True]
    assert content(one.read("a")) == [(5, "two", 1, 1), (6, "one", 1, 1)] and one.state().version == 2
    with pytest.raises(Conflict):
        publish(one, State(1, {}, {}))


def test_a_run_touches_the_buckets_of_its_keys_only(spark, tmp_path):
    store = store_at(spark, tmp_path, buckets=32)
    store.commit({"a": rows(spark, *((i, "old", 1, 1) for i in range(400)))})
    assert len(store.state().tables["a"][0]["buckets"]) == 32
    store.commit({"a": rows(spark, (7, "new", 2, 2), (8, "new", 2, 2))})
    entry = store.state().tables["a"][1]
    assert 1 <= len(entry["buckets"]) <= 2
    files = [f for b in os.listdir(entry["path"]) if b.startswith("bucket_=") for f in os.listdir(f"{entry['path']}/{b}") if f.endswith(".parquet")]
    assert len(files) <= 2
    some = store.read_keys("a", spark.createDataFrame([(7,), (9,), (999,)], "k bigint"))
    assert content(some) == [(7, "new", 2, 1), (9, "old", 1, 1)]
    assert {f.rsplit("bucket_=")[1].split("/")[0] for f in store.deltas("a", entry["buckets"]).inputFiles()} == {str(b) for b in entry["buckets"]}


def test_compaction_keeps_the_table(spark, tmp_path):
    store, draw, want = store_at(spark, tmp_path, buckets=4), random.Random(3), {}
    for n in range(6):
        batch = [(draw.randrange(30), f"v{n}.{i}", i, 100 * n + i) for i in range(20)]
        for k, v, s, c in batch:
            want[k] = (k, v, s, want[k][3] if k in want else c)
        store.commit({"a": rows(spark, *batch)}, "w", n)
        if n in (2, 4):
            assert store.compact("a", 2)
    assert content(store.read("a")) == sorted(want.values(), key=str)
    assert store.compact("a", 1) and store.compact("a", 1) == []
    assert content(store.read("a")) == sorted(want.values(), key=str) and max(sum(b in e["buckets"] for e in store.state().tables["a"]) for b in range(4)) == 1
    store.vacuum()
    assert content(store.read("a")) == sorted(want.values(), key=str) and len(folders(tmp_path, "a")) == 1


def test_stream_into_a_table(spark, tmp_path):
    store = store_at(spark, tmp_path / "store")

    def feed(*data):
        rows(spark, *data).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        sink(stream, store, "a", str(tmp_path / "c"), "stream").awaitTermination(90)

    feed((1, "a", 1, 1), (2, "b", 1, 1))
    feed((2, "c", 2, 2), (3, "d", 2, 2))
    run()
    assert content(store.read("a")) == [(1, "a", 1, 1), (2, "c", 2, 1), (3, "d", 2, 2)]
    version = store.state().version
    feed((3, "e", 3, 3))
    run()
    assert content(store.read("a")) == [(1, "a", 1, 1), (2, "c", 2, 1), (3, "e", 3, 2)] and store.state().version == version + 1


# upserts


def test_upsert_bears_maps_and_the_later_row_wins(spark):
    old = rows(spark, (1, "zz", 5, 1), (2, "keep", 1, 1)).coalesce(1)
    new = rows(spark, (1, "b", 5, 9), (1, "a", 5, 8), (3, "first", 1, 7), (3, "last", 1, 6)).coalesce(1)
    assert content(upsert.upsert(old, new, ["k"], ["seq"])) == [(1, "a", 5, 1), (2, "keep", 1, 1), (3, "last", 1, 7)]
    numbered = new.withColumn("arrived", F.when(F.col("v").isin("b", "first"), 2).otherwise(1))
    assert content(upsert.upsert(old, numbered, ["k"], ["seq"], sequence="arrived")) == [(1, "b", 5, 1), (2, "keep", 1, 1), (3, "first", 1, 6)]


def test_patch_takes_the_last_row(spark):
    old = rows(spark, (1, "o", 1, 1))
    new = rows(spark, (1, "z", 1, 2), (1, "a", 1, 3)).coalesce(1).withColumn("present", F.array(F.lit("v")))
    assert content(upsert.patch(old, new, ["k"], "present")) == [(1, "a", 1, 1)]


# discovery in batches


def loop(hits, jobs):
    """The same by a plain loop over one job after the other."""
    out = {}
    for job in {h[0] for h in hits}:
        target, cap = jobs.get(job, (None, None))
        target = target or 1
        cap = cap if cap is not None else max(5, 4 * target)
        found, seen, processed, good = 0, set(), 0, 0
        for batch in sorted({h[1] for h in hits if h[0] == job}):
            first = {}
            for _, _, rank, url, ok in sorted((h for h in hits if h[0] == job and h[1] == batch), key=lambda h: (h[2], h[3])):
                first.setdefault(url, (rank, bool(ok)))
            size = min(cap, max(3, min(5, target + 1))) if cap > 0 else 0
            budget = 0 if good >= target or found >= cap else min(cap - found, max(5, 2 * size))
            taken = 0
            for url, (rank, ok) in sorted(first.items(), key=lambda x: (x[1][0], x[0])):
                key = (job, batch, url)
                if budget <= 0:
                    out[key] = ("not_reached", None, None)
                elif taken >= budget:
                    out[key] = ("beyond_budget", None, None)
                else:
                    taken += 1
                    if url in seen:
                        out[key] = ("duplicate_url_reopened", None, None)
                        continue
                    seen.add(url)
                    found += 1
                    if good >= target:
                        out[key] = ("found", found, None)
                    else:
                        processed, good = processed + 1, good + ok
                        out[key] = ("processed", found, processed)
    return out


def some_hits(seed, jobs=12, batches=6):
    draw = random.Random(seed)
    hits = [(j, b, r, f"u{draw.randrange(25)}", draw.choice([True, False, False, None])) for j in range(jobs) for b in range(batches) for r in range(draw.randrange(0, 14))]
    return hits, {j: (draw.choice([None, 1, 2, 4, 9]), draw.choice([None, 3, 8, 20, 40])) for j in range(jobs - 2)}


HITS, JOBS = "job_id bigint, batch int, rank bigint, url string, accepted boolean", "job_id bigint, target bigint, cap bigint"


def decided(df):
    return {(r["job_id"], r["batch"], r["url"]): (r["status"], r["position"], r["processed_order"]) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_discovery_equals_the_loop(spark, seed):
    hits, limits = some_hits(seed)
    jobs = spark.createDataFrame([(j, *x) for j, x in limits.items()], JOBS)
    want = loop(hits, limits)
    df = spark.createDataFrame([*hits, (0, 0, 0, None, True)], HITS)
    got = decided(discovery.run(df, jobs)[0])
    # rows beyond the largest budget of a batch are left out before the fold
    assert got == {k: want[k] for k in got} and all(want[k][0] in ("beyond_budget", "not_reached") for k in want.keys() - got.keys())
    assert {"processed", "duplicate_url_reopened", "not_reached"} <= {s for s, *_ in got.values()}
    # in three runs, the last of which goes on within a batch
    state, parts = None, {}
    for part in ("batch < 2", "batch < 5 AND batch >= 2", "batch >= 5"):
        rows_, state = discovery.run(df.where(part), jobs, state)
        parts |= decided(rows_)
    assert parts == got
    ends = {r["job_id"]: r for r in discovery.summary(discovery.run(df, jobs)[1]).collect()}
    assert all(ends[j]["processed"] == sum(s == "processed" for (k, *_), (s, *_) in want.items() if k == j) for j in ends)


def test_discovery_of_a_stream(spark, tmp_path):
    hits, limits = some_hits(5, jobs=5, batches=3)
    jobs = spark.createDataFrame([(j, *x) for j, x in limits.items()], JOBS)
    store = Store(spark, str(tmp_path / "store"), {
        "discovery": Table(discovery.ROWS, ("job_id", "batch", "url"), kept=(), buckets=4), "discovery_state": Table(discovery.STATE, ("job_id",), kept=(), buckets=4),
    })
    for b in range(3):
        spark.createDataFrame([h for h in hits if h[1] == b], HITS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(HITS).parquet(str(tmp_path / "in"))
        discovery.follow(stream, jobs, store, str(tmp_path / "c")).awaitTermination(90)
    got = decided(store.read("discovery"))
    assert got == decided(discovery.run(spark.createDataFrame(hits, HITS), jobs)[0])
    assert store.state().version == 3
