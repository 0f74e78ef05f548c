"""Exact dedup through a minimal perfect hash over the distinct digests of history.

The index is an artefact: rows of shards that build_index makes, that can be written, read (save, load), looked up and brought
up to date (absorb). A shard is a minimal perfect hash (hash and displace: keys fall in small buckets, each bucket stores
a displacement that sends its keys to free slots); slot i holds the full 32-byte digest, the locator of the winner
(largest id) and the size of the group. A lookup reads one slot and compares all bytes, so a digest outside the index can't
pass for a member. What a lookup doesn't find is grouped on its own and becomes a segment of its own.

A table without a history is taken as history (the lower half of its ids) and increment (the rest): history is indexed, the
increment's distinct digests are looked up, members bring winners and sizes up to date, nonmembers form a second
segment, and every row is then looked up for its winner.

Rows of one id and text are counted before anything else, and go to (shard, salt): a shard with many rows is given to
several tasks, each with a copy of the shard, so one text that makes up a third of all rows is spread.

Cases: null text counts as empty; null ids take part, belong to the increment and never win against an id; of rows with equal
text and equal id one stays; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bloom, in_bloom, materialize, per_key

SHARD_KEYS, LEAST_SHARDS = 20_000, 64
BROADCAST_SHARDS = 1 << 18  # most shards whose loads are broadcast (3 MB); more of them are joined by key
SALT_ROWS = 20_000
REPEATS = 10_000  # rows of one id and text that one task writes


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct digests (an n x 4 array of uint64): slot_of is a bijection to 0..n-1 on them."""

    def __init__(self, displacements: np.ndarray, n: int):
        self.displacements, self.n = displacements, n

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        n = len(keys)
        buckets = max(1, -(-n // 4))
        bucket = (keys[:, 1] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        taken = np.zeros(n, bool)
        out = np.zeros(buckets, np.int64)
        sizes = np.diff(edges)
        free = 0
        for b in np.argsort(-sizes, kind="stable"):
            rows = keys[order[edges[b] : edges[b + 1]]]
            if len(rows) == 0:
                break
            if len(rows) == 1:  # the last keys take the slots left over, named directly
                while taken[free]:
                    free += 1
                taken[free] = True
                out[b] = -free - 1
                continue
            d = 0
            while True:  # a block of displacements at a time
                at = np.sort(cls._at(rows[None], np.arange(d, d + 64)[:, None], n), axis=1)
                good = ~taken[at].any(1) & (np.diff(at, axis=1) > 0).all(1)
                if good.any():
                    d += int(good.argmax())
                    at = at[d % 64]
                    break
                d += 64
            taken[at] = True
            out[b] = d
        return cls(out, n)

    @staticmethod
    def _at(rows: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (_mix(rows[..., 2] + rows[..., 3] * d.astype(np.uint64)) % np.uint64(n)).astype(np.int64)

    def slot_of(self, keys: np.ndarray) -> np.ndarray:
        d = self.displacements[(keys[:, 1] % np.uint64(len(self.displacements))).astype(np.int64)]
        return np.where(d < 0, -d - 1, self._at(keys, np.maximum(d, 0), self.n))


def _words(digests) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 4)


def _shard(column: str, shards: int):
    return F.pmod(F.conv(F.substring(F.hex(column), 1, 12), 16, 10).cast("bigint"), F.lit(shards)).cast("int")


INDEX_COLUMNS = ["shards", "shard", "segment", "displacements", "digests", "winners", "named", "sizes"]  # named: whether a slot's winner has an id
INDEX = "shards int, shard int, segment int, displacements binary, digests binary, winners binary, named binary, sizes binary"
GROUPS = "digest binary, winner bigint, size bigint"


def _segment(shards: int, shard: int, segment: int, keys: list[bytes], winners: np.ndarray, named: np.ndarray, sizes: np.ndarray) -> pa.Table:
    mph = PerfectHash.build(_words(keys))
    order = np.argsort(mph.slot_of(_words(keys)))
    blobs = (mph.displacements.tobytes(), b"".join(keys[i] for i in order), winners[order].tobytes(), named[order].tobytes(), sizes[order].tobytes())
    return pa.table([*(pa.array([x], pa.int32()) for x in (shards, shard, segment)), *(pa.array([x], pa.binary()) for x in blobs)], INDEX_COLUMNS)


def build_index(groups: DataFrame, shards: int, segment: int = 0) -> DataFrame:
    """Index rows over groups(digest, winner, size) of distinct digests."""

    def one(part: pa.Table) -> pa.Table:
        winners, named = part.column("winner").fill_null(0).to_numpy().astype(np.int64), np.asarray(part.column("winner").is_valid())
        return _segment(shards, part.column("shard")[0].as_py(), segment, part.column("digest").to_pylist(), winners, named, part.column("size").to_numpy().astype(np.int64))

    return per_key(groups.select(_shard("digest", shards).alias("shard"), "digest", "winner", "size"), "shard", one, INDEX)


def save(index: DataFrame, path: str) -> None:
    index.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(path)


def shards_of(index: DataFrame) -> int:
    row = index.select("shards").first()
    return row[0] if row else 1


class Slots:
    """The segments of one shard, ready for lookups."""

    def __init__(self, segments: list[dict]):
        self.parts = []
        for x in segments:
            slots = _words([x["digests"]])
            values = [np.frombuffer(x[c], t).copy() for c, t in (("winners", np.int64), ("named", bool), ("sizes", np.int64))]
            self.parts.append((PerfectHash(np.frombuffer(x["displacements"], np.int64), len(slots)), slots, *values))

    def find(self, digests) -> tuple[np.ndarray, np.ndarray]:
        """Segment (-1: none) and slot of each digest."""
        keys = _words(digests)
        where, slot = np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        for i, (mph, slots, *_) in enumerate(self.parts):
            at = mph.slot_of(keys)
            found = (slots[at] == keys).all(1)  # the byte check
            where[found], slot[found] = i, at[found]
        return where, slot

    def values(self, where: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Winner, whether it has an id, and size."""
        winner, named, size = np.zeros(len(where), np.int64), np.zeros(len(where), bool), np.zeros(len(where), np.int64)
        for i, (_, _, winners, has, sizes) in enumerate(self.parts):
            here = where == i
            winner[here], named[here], size[here] = winners[slot[here]], has[slot[here]], sizes[slot[here]]
        return winner, named, size


def absorb(index: DataFrame, groups: DataFrame, shards: int, segment: int = 1) -> DataFrame:
    """The index after an increment's groups(digest, winner, size): digests that it holds get the larger winner and the sum of
    the sizes in their slots; the others form a new segment of each shard."""

    def one(part: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        slots, out = Slots(held.to_dict("records")), held
        if len(part):
            shard = int(part["shard"].iloc[0])
            digests, sizes = part["digest"].tolist(), part["size"].to_numpy(np.int64)
            winners, named = part["winner"].to_numpy(np.int64), part["named"].to_numpy(bool)
            where, slot = slots.find(digests)
            for i, (_, _, w, has, n) in enumerate(slots.parts):
                here = np.flatnonzero(where == i)
                n[slot[here]] += sizes[here]
                better = here[named[here] & (~has[slot[here]] | (winners[here] > w[slot[here]]))]
                w[slot[better]], has[slot[better]] = winners[better], True
            if len(held):
                out = held.assign(**{c: [p[k].tobytes() for p in slots.parts] for k, c in ((2, "winners"), (3, "named"), (4, "sizes"))})
            if len(new := np.flatnonzero(where < 0)):
                out = pd.concat([out, _segment(shards, shard, segment, [digests[i] for i in new], winners[new], named[new], sizes[new]).to_pandas()])
        return out[INDEX_COLUMNS]

    rows = groups.select(_shard("digest", shards).alias("shard"), "digest", F.coalesce("winner", F.lit(0)).alias("winner"), F.col("winner").isNotNull().alias("named"), "size")
    return rows.groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(one, INDEX)


def lookup(rows: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """rows(doc_id, digest, n) with the index's winner and size, both null for digests that it doesn't hold."""

    def one(part: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        slots = Slots(held.to_dict("records"))
        where, slot = slots.find(part["digest"])
        winner, named, size = slots.values(where, slot)
        known = pd.array(winner, dtype="Int64")
        known[~named] = pd.NA
        count = pd.array(size, dtype="Int64")
        count[where < 0] = pd.NA
        return pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "digest": part["digest"], "n": part["n"], "winner": known, "size": count})

    rows = rows.withColumn("shard", _shard("digest", shards))
    loads = materialize(rows.groupBy("shard").count().select("shard", F.ceil(F.col("count") / SALT_ROWS).cast("int").alias("salts")), "loads")
    loads = F.broadcast(loads) if shards <= BROADCAST_SHARDS else loads
    salted = rows.join(loads, "shard").select("shard", F.pmod(F.xxhash64("digest", "doc_id"), "salts").cast("int").alias("salt"), "doc_id", "digest", "n")
    copies = index.join(loads, "shard").withColumn("salt", F.explode(F.expr("sequence(0, salts - 1)"))).drop("salts")
    return salted.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInPandas(lambda a, b: one(a, b) if len(a) else _none(), "doc_id bigint, digest binary, n bigint, winner bigint, size bigint")


def _none() -> pd.DataFrame:
    return pd.DataFrame({"doc_id": [], "digest": [], "n": [], "winner": [], "size": []})


def _counted(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, digest, n): how often an id has a text."""
    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)).alias("digest"))
    return rows.groupBy("doc_id", "digest").agg(F.count("*").alias("n"))


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.sum("n").alias("size"))


def _shards(keys: int) -> int:
    """A power of two, so that an index tells its number of shards."""
    return 1 << int(max(LEAST_SHARDS, keys // SHARD_KEYS) - 1).bit_length()


def exact_dedup(docs: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    history: the texts already known. A row whose text history holds is a repeat of history's winner, which stays, and the rest
    is grouped within docs. Without it docs is split into history and increment, and the largest id of both stays.
    """
    rows = materialize(_counted(docs, id_col, text_col), "digests")
    if history is None:
        ends = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
        middle = None if ends[0] is None else (ends[0] + ends[1]) // 2
        old = rows.where(F.col("doc_id") <= F.lit(middle).cast("bigint"))
        new = rows.where(F.col("doc_id").isNull() | (F.col("doc_id") > F.lit(middle).cast("bigint")))
        shards = _shards(rows.count())
        index = materialize(build_index(_groups(old), shards), "index")
        index = materialize(absorb(index, _groups(new), shards), "index")
        found = lookup(rows, index, shards)
    else:
        known = materialize(_groups(_counted(history, id_col, text_col)), "groups")
        shards = _shards(known.count())
        index = materialize(build_index(known, shards), "index")
        first = materialize(lookup(rows, index, shards), "members")
        # nonmembers are grouped separately, in an index of their own
        others = first.where("size IS NULL").select("doc_id", "digest", "n")
        own = materialize(build_index(_groups(others), shards), "index")
        found = first.where("size IS NOT NULL").unionByName(lookup(others, own, shards))
    out = found.select("doc_id", F.col("winner").alias("keep_id"), F.col("size").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("winner")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "n")
    # the first of rows that repeat is the one that stays; very many of them are written by several tasks
    out = materialize(out, "looked")
    single, several, many = out.where("n = 1"), out.where(f"n > 1 AND n <= {REPEATS}"), out.where(f"n > {REPEATS}")
    dealt = many.withColumn("c", F.explode(F.expr(f"sequence(0, cast((n - 1) div {REPEATS} AS int))"))).repartition("text_sha256", "doc_id", "c")
    spread = several.withColumn("c", F.lit(0)).unionByName(dealt).withColumn("i", F.explode(F.expr(f"sequence(1, cast(least({REPEATS}, n - c * {REPEATS}) AS int))")))
    spread = spread.withColumn("kept", F.col("kept") & (F.col("c") == 0) & (F.col("i") == 1)).drop("c", "i")
    return single.unionByName(spread).drop("n")


def redundant(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Marks (doc_id, sha, twin) of rows that must go; twin: the mark is of the row that stays, held more than once."""
    lost = exact_dedup(docs, None, id_col, text_col).where("not kept")
    return lost.groupBy("doc_id", F.col("text_sha256").alias("sha")).agg(F.max(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("twin"))


def without(docs: DataFrame, marks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs less its marked rows; of rows marked as twins one stays. The columns of docs may have any names.

    Most rows carry no mark, and a Bloom filter over the marked ids lets them pass where they are read. Only the others,
    with what the filter takes for marked, go to the join, so whole texts aren't shuffled to drop a few.
    """
    spark = docs.sparkSession
    digest = lambda c: F.unhex(F.md5(F.coalesce(c.cast("string"), F.lit("null"))))
    bits = spark.sparkContext.broadcast(bloom(marks.select(digest(F.col("doc_id")).alias("k"))))

    @F.arrow_udf("boolean")
    def suspected(keys: pa.Array) -> pa.Array:
        return pa.array(in_bloom(bits.value, keys.to_pylist()))

    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(row, F.col(id_col).cast("bigint").alias("id_"), F.col(text_col).cast("string").alias("text_")).withColumn("suspect_", suspected(digest(F.col("id_"))))
    clean = rows.where("not suspect_").select("row")
    suspects = materialize(rows.where("suspect_").select("row", "id_", F.sha2(F.coalesce("text_", F.lit("")), 256).alias("sha_")), "suspects")
    m = marks.selectExpr("doc_id AS mark_id", "sha AS mark_sha", "twin AS mark_twin")
    joined = suspects.join(m.hint("merge"), F.col("id_").eqNullSafe(F.col("mark_id")) & (F.col("sha_") == F.col("mark_sha")), "left")
    twins = joined.where("mark_twin").dropDuplicates(["id_", "sha_"]).select("row")
    out = clean.unionByName(joined.where("mark_twin IS NULL").select("row")).unionByName(twins)
    return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
