"""Vector code compression: product quantisation whose nearest entries are found by annular norm pruning.

Components become whole numbers floor(4096 x); vectors are cut into PARTS equal parts. A codebook per part starts as that part
of the ENTRIES vectors with the smallest ids. Each round gives every part to its nearest entry and moves each entry to its
parts' mean, rounded down; an entry without parts stays. Ties go to the lower index.

Nearest entry: entries are sorted by norm. A part's first candidate is the entry of the nearest norm; since the norms of two
points differ by at most their distance, no entry outside [norm - d, norm + d] can be as near as the best distance d so far. The
interval is found by binary search, both ends included (so ties are seen), walked outwards from the first candidate, and narrowed
as d falls; distances are whole numbers and exact.

Distribution: a round is one pass in which each task sums its parts by entry, at most PARTS * ENTRIES rows a task whatever its
rows; the sums are added by Spark and the codebooks (one vector per entry) come to the driver. Label totals are pre-aggregated, and
labels with many rows are joined by broadcast.

Cases: null vectors and null or non-finite components are dropped; so are vectors whose length isn't a multiple of PARTS or
isn't that of the first kept vector, and vectors whose squared distances could leave 64 bits (components beyond 2^28 over the root of
the length, before scaling 8,192 at 64 components); with fewer than ENTRIES vectors there are fewer entries; equal ids are taken
in the order of their vectors, null ids last; repeated rows are vectors of their own; null labels count as one label; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, with_groups

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
REACH = 2.0**28  # components times the root of the length stay below, so a squared distance stays below 2^58 and label sums have room


def _whole(vectors: pa.Array, scale: int) -> Iterator[np.ndarray | None]:
    """Each vector in whole numbers, or None if it takes no part."""
    values, offsets = vectors.flatten().cast(pa.float64()), np.concatenate([[0], np.cumsum(np.asarray(vectors.value_lengths().fill_null(0)))])
    numbers, missing = values.to_numpy(zero_copy_only=False), np.asarray(values.is_null())
    with np.errstate(over="ignore", invalid="ignore"):
        whole = np.floor(scale * numbers)
    for ok, a, b in zip(vectors.is_valid().to_pylist(), offsets[:-1], offsets[1:], strict=True):
        q = whole[a:b]
        ok = ok and b > a and not missing[a:b].any() and np.isfinite(numbers[a:b]).all() and float(np.abs(q).max()) * math.sqrt(b - a) <= REACH
        yield q.astype(np.int64) if ok else None


def kept(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, q): the vectors that take part, their components as whole numbers of 64 bits, little-endian."""
    out = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("q", pa.binary())])

    def work(batches):
        for batch in batches:
            found = list(_whole(batch.column(2).cast(pa.list_(pa.float64())), scale))
            at = [i for i, q in enumerate(found) if q is not None and len(q) % parts == 0]
            if at:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array([found[i].astype("<i8").tobytes() for i in at], pa.binary())], schema=out)

    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v"))
    return rows.mapInArrow(work, "vec_id bigint, label string, q binary")


class Codebook:
    """Entries of one part, sorted by norm."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        norms = np.sqrt((entries.astype(np.float64) ** 2).sum(1))
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]
        self.evaluated = 0

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each point's nearest entry (ties: the lower one) and the squared distance."""
        norms = np.sqrt((points.astype(np.float64) ** 2).sum(1))
        k, n = len(self.norms), len(points)
        above = np.searchsorted(self.norms, norms)
        left, right = np.clip(above - 1, 0, k - 1), np.clip(above, 0, k - 1)
        first = np.where(np.abs(self.norms[left] - norms) <= np.abs(self.norms[right] - norms), left, right)
        best, code = self._distance(points, first), self.order[first]
        active = np.arange(n)
        for step in range(1, k):
            reach = np.sqrt(best[active].astype(np.float64)) * (1 + 1e-9) + 1e-6
            low, high = np.searchsorted(self.norms, norms[active] - reach), np.searchsorted(self.norms, norms[active] + reach, "right") - 1
            inside = (first[active] - step >= low) | (first[active] + step <= high)
            active, low, high = active[inside], low[inside], high[inside]
            if not len(active):
                break
            for side in (-step, step):
                place = first[active] + side
                allowed = (place >= low) & (place <= high)
                at, place = active[allowed], place[allowed]
                d, c = self._distance(points[at], place), self.order[place]
                nearer = (d < best[at]) | ((d == best[at]) & (c < code[at]))
                best[at[nearer]], code[at[nearer]] = d[nearer], c[nearer]
        return code, best

    def _distance(self, points: np.ndarray, places: np.ndarray) -> np.ndarray:
        self.evaluated += len(points)
        return ((points - self.entries[self.order[places]]) ** 2).sum(1)


def assign(points: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (vectors x parts) and squared distances of whole vectors."""
    found = [Codebook(book).nearest(part) for book, part in zip(books, np.split(points, len(books), axis=1), strict=True)]
    return np.stack([c for c, _ in found], 1), np.stack([d for _, d in found], 1)


def _points(batch: pa.RecordBatch, length: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """The rows whose vectors have this length, and the vectors."""
    raw = batch.column(batch.schema.get_field_index("q")).to_pylist()
    at = [i for i, x in enumerate(raw) if len(x) == 8 * length]
    points = np.frombuffer(b"".join(raw[i] for i in at), "<i8").reshape(len(at), length)
    return (batch if len(at) == len(raw) else batch.take(pa.array(at, pa.int64()))), points


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks (entries x components, whole numbers) of the vectors of kept(); empty without vectors."""
    first = [np.frombuffer(r["q"], "<i8") for r in rows.where("vec_id IS NOT NULL").orderBy("vec_id", F.hex("q")).limit(1).collect()] or [
        np.frombuffer(r["q"], "<i8") for r in rows.orderBy(F.hex("q")).limit(1).collect()
    ]
    if not first:
        return []
    length = len(first[0])
    same = rows.where(F.length("q") == 8 * length)
    seed = [np.frombuffer(r["q"], "<i8") for r in same.orderBy(F.col("vec_id").asc_nulls_last(), F.hex("q")).limit(entries).collect()]
    books = np.split(np.stack(seed), parts, axis=1)
    for _ in range(rounds):
        books = _moved(same, books, length)
    return books


def _moved(rows: DataFrame, books: list[np.ndarray], length: int) -> list[np.ndarray]:
    """Every entry at the mean of its parts, rounded down; entries without parts as they were."""
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("at", pa.int32()), ("total", pa.int64())])

    def work(batches):
        totals = [np.zeros(b.shape, np.int64) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            _, points = _points(batch, length)
            if len(points):
                codes, _ = assign(points, books)
                for p, part in enumerate(np.split(points, len(books), axis=1)):
                    np.add.at(totals[p], codes[:, p], part)
                    counts[p] += np.bincount(codes[:, p], minlength=len(books[p]))
        for p, (total, n) in enumerate(zip(totals, counts, strict=True)):
            e, c = (x.ravel() for x in np.meshgrid(np.flatnonzero(n), np.arange(total.shape[1]), indexing="ij"))
            if len(e):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(e), p), pa.int32()), pa.array(e, pa.int32()), pa.array(n[e]), pa.array(c, pa.int32()), pa.array(total[e, c])], schema=schema)

    sums = rows.select("q").mapInArrow(work, "part int, entry int, n bigint, at int, total bigint").groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    moved = [b.copy() for b in books]
    for r in sums.collect():  # one row per component of an entry
        moved[r["part"]][r["entry"], r["at"]] = r["total"] // r["n"]
    return moved


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position, in decimal, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def encode(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error): two hex digits per part, and the squared distances of all parts."""
    length = sum(b.shape[1] for b in books)
    out = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.string()), ("error", pa.int64())])

    def work(batches):
        for batch in batches:
            batch, points = _points(batch, length)
            if len(points):
                codes, d = assign(points, books)
                text = [x.tobytes().hex() for x in codes.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text), pa.array(d.sum(1))], schema=out)

    return rows.mapInArrow(work, "vec_id bigint, label string, code string, error bigint")


def decode(codes: DataFrame, books: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """codes with the vector that each code stands for, in column `approximation`."""
    table = F.array(*(F.array(*(F.array(*(F.lit(float(x) / scale) for x in entry)) for entry in b)) for b in books))
    places = F.sequence(F.lit(0), F.lit(len(books) - 1))
    number = lambda p: F.conv(F.substring(F.col("code"), 2 * p + 1, F.lit(2)), 16, 10).cast("int")
    return codes.withColumn("approximation", F.flatten(F.transform(places, lambda p: F.get(F.get(table, p), number(p)))))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error (errors of all vectors of its label), codebooks_sha256, label."""
    rows = materialize(kept(vectors, id_col, vector_col, label_col), "vectors")
    books = fit(rows)
    columns = ["vec_id", "code", "error", "label_error", "codebooks_sha256", "label"]
    if not books:
        return vectors.sparkSession.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string, label string").select(columns)
    coded = materialize(encode(rows, books), "codes").withColumns({"key": F.coalesce("label", F.lit("")), "none": F.col("label").isNull()})
    totals = coded.groupBy("key", "none").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    return with_groups(coded, totals, ["key", "none"], "n").withColumn("codebooks_sha256", F.lit(digest(books))).select(columns)


def _oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same in SQL, one query expression per round over (vector, part, component) rows; vectors of one length and distinct ids."""
    nearest = (
        "m{r} AS MATERIALIZED (SELECT vec_id, part, min(d * 100 + entry) AS best FROM (SELECT c.vec_id, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x))::BIGINT AS d"
        " FROM comps c JOIN b{r} b ON c.part = b.part AND c.place = b.place GROUP BY ALL) GROUP BY ALL)"
    )
    moved = (
        "b{s} AS MATERIALIZED (SELECT b.part, b.entry, b.place, coalesce(t.x, b.x) AS x FROM b{r} b LEFT JOIN (SELECT c.part, m.best % 100 AS entry, c.place,"
        " ((sum(c.x) - ((sum(c.x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x FROM comps c JOIN m{r} m ON c.vec_id = m.vec_id AND c.part = m.part GROUP BY ALL) t"
        " ON t.part = b.part AND t.entry = b.entry AND t.place = b.place)"
    )
    steps = [x for r in range(rounds) for x in (nearest.format(r=r), moved.format(r=r, s=r + 1))] + [nearest.format(r=rounds)]
    return f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
comps AS MATERIALIZED (SELECT vec_id, label, (i - 1) // (len(v) // {parts}) AS part, (i - 1) % (len(v) // {parts}) AS place, floor({scale} * v[i])::BIGINT AS x
  FROM (SELECT vec_id, label, v, unnest(range(1, len(v) + 1)) AS i FROM kept)),
b0 AS MATERIALIZED (SELECT c.part, f.entry, c.place, c.x FROM comps c JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {entries}) f USING (vec_id)),
{(","+chr(10)).join(steps)},
sums AS (SELECT vec_id, string_agg(lpad(format('{{:x}}', best % 100), 2, '0'), '' ORDER BY part) AS code, sum(best // 100)::BIGINT AS error FROM m{rounds} GROUP BY vec_id)
SELECT s.vec_id, s.code, s.error, (sum(s.error) OVER (PARTITION BY k.label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, place)) FROM b{rounds}) AS codebooks_sha256, k.label::VARCHAR AS label
FROM sums s JOIN kept k USING (vec_id)"""


#: Distances times 100 plus the entry, so that the least holds the lower index of a tie. Compares every part with every entry.
ORACLE_SQL = _oracle()
