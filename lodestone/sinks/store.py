"""Keyed tables that change together: rows go to buckets of their keys as Parquet deltas, and one manifest makes all of a commit visible.

A commit stages the delta of every table first, each a folder of its own that nothing refers to. Then the manifest of the next version is
written beside the others and renamed into place, which fails if another writer has that version already (the commit then looks at the new
state and takes the next one). Readers open the newest manifest only, so a writer killed at any point leaves either the old state or the new
one, of all tables. Every commit bears its writer's name and sequence number; one that is at most the writer's last is skipped, so a commit may
be repeated: a restarted job or a micro-batch done twice changes nothing.

A delta holds one row per key, in the buckets of its keys; other buckets aren't touched. Readers merge: of the versions of a key the latest
commit wins whole, and columns in `kept` stay from its first row, in one aggregate by key. compact() merges the buckets with more than some
deltas into one each and leaves the others as they are; vacuum() deletes folders that no manifest of the last versions refers to.

All files go through Spark and Hadoop's file systems, so the root may be in any store that Spark reads. A manifest lists live deltas (bounded by
compaction), not rows.

Cases: null keys are keys like others; of equal keys in one commit the row with the greatest `order` wins, of ties the later one in `sequence`; an
empty commit is a version without deltas; tables that a commit leaves out stay as they are; columns of any type, maps included, pass as values.
"""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.upsert import last_rows

TRIES = 20


@dataclass(frozen=True)
class Table:
    """A keyed table. schema: a StructType, or its columns as text. order: columns that order rows of one key within a commit; kept: columns that stay from a key's first commit.
    by: the keys that choose a row's bucket, all of them if none are named."""

    schema: StructType | str
    keys: tuple[str, ...]
    order: tuple[str, ...] = ()
    kept: tuple[str, ...] = ("created_at",)
    buckets: int = 64
    by: tuple[str, ...] = ()


@dataclass
class State:
    """What a manifest says: version, last sequence number by writer, live deltas by table, each with its path, commit and buckets."""

    version: int = 0
    writers: dict[str, int] = field(default_factory=dict)
    tables: dict[str, list[dict]] = field(default_factory=dict)


class Conflict(RuntimeError):
    """Another writer took the version."""


class Store:
    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table]):
        self.spark, self.root = spark, root.rstrip("/")
        self.tables = {n: replace(t, schema=StructType.fromDDL(t.schema)) if isinstance(t.schema, str) else t for n, t in tables.items()}
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    # ---- manifests ----

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/_commits")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def state(self, version: int | None = None) -> State:
        found = self.versions()
        if not found:
            return State()
        stream = self._fs.open(self._path(f"{self.root}/_commits/{version or found[-1]:012d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return State(**json.loads(text))

    def _publish(self, state: State) -> None:
        """The manifest of a version, whole or not at all; Conflict if that version is there."""
        target = self._path(f"{self.root}/_commits/{state.version:012d}.json")
        draft = self._path(f"{self.root}/_commits/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(state.__dict__).encode()))
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, target, none)
        except Exception as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(str(state.version)) from e
            raise

    # ---- writing ----

    def _bucket(self, table: Table):
        return F.pmod(F.xxhash64(*(F.col(f"`{k}`") for k in table.by or table.keys)), F.lit(table.buckets)).cast("int")

    def stage(self, name: str, rows: DataFrame, sequence: str | None = None) -> dict:
        """Write one delta that nothing refers to yet; returns its entry for a manifest."""
        table = self.tables[name]
        one = last_rows(rows.select(*(F.col(f"`{f.name}`").cast(f.dataType) for f in table.schema), *([sequence] if sequence else [])), list(table.keys), list(table.order), sequence, list(table.kept))
        return self._write(name, one.select(*(F.col(f"`{c}`") for c in table.schema.names)))

    def _write(self, name: str, rows: DataFrame) -> dict:
        table, path = self.tables[name], f"{self.root}/{name}/{uuid.uuid4().hex}"
        dealt = rows.withColumn("bucket_", self._bucket(table)).repartition("bucket_")
        dealt.write.partitionBy("bucket_").option("compression", "zstd").parquet(path)
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(path)) if f.isDirectory()]
        return {"path": path, "buckets": sorted(int(n.removeprefix("bucket_=")) for n in names if n.startswith("bucket_="))}

    def commit(self, rows: dict[str, DataFrame], writer: str = "main", number: int | None = None, sequence: str | None = None) -> bool:
        """Make rows of several tables visible at once; False if this writer's number was committed before.

        Without a number the commit is the writer's next. Rows are staged once, whatever other writers do in the meantime.
        """
        state = self.state()
        if number is not None and state.writers.get(writer, -1) >= number:
            return False
        staged = {name: self.stage(name, df, sequence) for name, df in rows.items()}
        for _ in range(TRIES):
            if number is not None and state.writers.get(writer, -1) >= number:
                return False
            version = state.version + 1
            tables = {n: list(state.tables.get(n, [])) for n in self.tables}
            for name, entry in staged.items():
                if entry["buckets"]:
                    tables[name].append(entry | {"commit": version})
            new = State(version, state.writers | {writer: state.writers.get(writer, -1) + 1 if number is None else number}, tables)
            try:
                self._publish(new)
                return True
            except Conflict:
                state = self.state()
        raise Conflict(f"{TRIES} versions went to other writers")

    # ---- reading ----

    def deltas(self, name: str, buckets: Iterable[int] | None = None, state: State | None = None) -> DataFrame:
        """All live rows with column commit_, of all buckets or some; only folders of these buckets are opened."""
        state = state or self.state()
        table = self.tables[name]
        wanted = None if buckets is None else set(buckets)
        entries = [e for e in state.tables.get(name, []) if wanted is None or wanted & set(e["buckets"])]
        schema = StructType([*table.schema.fields])
        if not entries:
            return self.spark.createDataFrame([], schema).withColumn("commit_", F.lit(0).cast("bigint"))
        parts = []
        for e in entries:
            paths = [f"{e['path']}/bucket_={b}" for b in e["buckets"] if wanted is None or b in wanted]
            parts.append(self.spark.read.schema(schema).parquet(*paths).withColumn("commit_", F.lit(e["commit"]).cast("bigint")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def read(self, name: str, buckets: Iterable[int] | None = None, version: int | None = None) -> DataFrame:
        """The table as of the newest or a given version."""
        table = self.tables[name]
        return self._merged(table, self.deltas(name, buckets, self.state(version)))

    def _merged(self, table: Table, rows: DataFrame) -> DataFrame:
        others = [c for c in table.schema.names if c not in table.keys]
        kept = [c for c in table.kept if c in others]
        keys = [F.col(f"`{k}`") for k in table.keys]
        if not others:
            return rows.select(*keys).distinct()
        last = F.max_by(F.struct(*(F.col(f"`{c}`") for c in others)), "commit_").alias("last_")
        first = [F.min_by(f"`{c}`", F.when(F.col(f"`{c}`").isNotNull(), F.col("commit_"))).alias(f"first_{i}") for i, c in enumerate(kept)]
        df = rows.groupBy(*keys).agg(last, *first)
        value = lambda c: F.coalesce(f"first_{kept.index(c)}", F.col("last_").getField(c)) if c in kept else F.col("last_").getField(c)
        return df.select(*((F.col(f"`{c}`") if c in table.keys else value(c).alias(c)) for c in table.schema.names))

    def read_keys(self, name: str, keys: DataFrame, on: list[str] | None = None) -> DataFrame:
        """The rows of some keys, or of some values of the columns `on`, which must hold those that choose the bucket; only their buckets are opened.

        Null keys are found like others.
        """
        table = self.tables[name]
        on = on or list(table.keys)
        wanted = keys.select(*(F.col(f"`{k}`") for k in on)).distinct()
        found = [r[0] for r in wanted.select(self._bucket(table).alias("b")).distinct().collect()]  # at most `buckets` numbers
        renamed = wanted.select(*(F.col(f"`{k}`").alias(f"key_{i}") for i, k in enumerate(on)))
        same = functools.reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"key_{i}")) for i, k in enumerate(on)])
        return self.read(name, found).join(renamed, same, "left_semi")

    # ---- upkeep ----

    def compact(self, name: str, most: int = 4) -> list[int]:
        """Merge every bucket with more than `most` deltas into one; returns these buckets. Keys keep their last values and first ones in kept columns."""
        for _ in range(TRIES):
            state = self.state()
            entries = state.tables.get(name, [])
            many = [b for b in range(self.tables[name].buckets) if sum(b in e["buckets"] for e in entries) > most]
            if not many:
                return []
            merged = self._write(name, self._merged(self.tables[name], self.deltas(name, many, state)))
            left = [e | {"buckets": [b for b in e["buckets"] if b not in many]} for e in entries]
            new = [merged | {"commit": state.version}, *(e for e in left if e["buckets"])]
            try:
                self._publish(State(state.version + 1, state.writers, state.tables | {name: new}))
                return many
            except Conflict:
                continue
        raise Conflict(f"{TRIES} versions went to other writers")

    def vacuum(self, versions: int = 1) -> list[str]:
        """Delete folders that none of the last versions refers to: aborted commits and merged deltas. Not while a writer is staging."""
        live = {e["path"] for v in self.versions()[-versions:] for entries in self.state(v).tables.values() for e in entries}
        gone = []
        for name in self.tables:
            folder = self._path(f"{self.root}/{name}")
            for f in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
                if not any(p.endswith(f"/{name}/{f.getPath().getName()}") for p in live):
                    self._fs.delete(f.getPath(), True)
                    gone.append(f.getPath().getName())
        return gone


def sink(stream: DataFrame, store: Store, name: str, checkpoint: str, writer: str):
    """Upserts of a stream into one table: a micro-batch is a commit of its number, so one done twice counts once, and it writes its keys' buckets only."""
    return stream.writeStream.foreachBatch(lambda batch, n: store.commit({name: batch}, writer, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
