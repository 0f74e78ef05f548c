"""Hard-negative mining: an exact kNN join of anchors with all rows, partitioned by Voronoi cells.

Components become whole numbers floor(256 x); a score is the inner product of two rows, a whole number. Rows are augmented by
sqrt(M^2 - |x|^2), with M the largest norm, and anchors by 0: then d^2 = |a|^2 + M^2 - 2 a.x, so high scores are small distances.

Cells: pivots are anchors spread by their hash; every anchor belongs to the group of its nearest pivot, every row to the cell of its
nearest pivot. Two searches follow, each in two rounds. In the first round a row meets the anchors of its own cell only, which gives every
anchor a first list of K and so a bound (its K-th score). In the second round a row is replicated to each other group that it
might serve: its distance to the group's pivot, less or more the group's radius, bounds its scores from above and below (as does its product with
the pivot, more or less radius times norm), and these must reach what some anchor of the group still needs. The first search finds positives (best K of the anchor's label), the second one
negatives: of other labels, scores from LOW % to 100 % of each positive's.

Distribution: the anchors of a group go in blocks of about BLOCK; rows meet a block in slices of about SLICE, streaming, so neither a
large group nor a hot cell (copies of one vector) weighs on one task, and a task holds one block and one batch of rows. Lists of K per block and
slice are merged by a ranking window, which Spark cuts to K per partition before the shuffle. Pivots and group bounds come to the
driver and go out by closure: at most PIVOT_NUMBERS numbers in all, whatever the input.

Cases: rows with a null label, a null vector, or a null or non-finite component take no part, nor do rows without an id, empty vectors, and
vectors of a norm beyond REACH (whose scores, in hundreds, could leave 64 bits; before scaling 524,288); equal ids are rows of their own (an
anchor's copy is another row); rows of different length don't meet; ties go to the smaller id; anchors without positives, and positives without
negatives, give no rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

K, LOW, SCALE, EVERY = 5, 80, 256, 100
GROUP, BLOCK, SLICE, LEAST_SLICE, SLICES = 512, 8192, 16384, 256, 32  # anchors to a pivot, to a block; rows to a slice, to one of the first SLICES
ANCHORS, BATCH = 1024, 2048  # anchors and rows of one matrix
PIVOTS, PIVOT_NUMBERS = 1024, 2_000_000  # most pivots, and most numbers in all of them
REACH, EXACT = 2.0**27, 2.0**52  # largest norm; product of norms whose inner products are exact in doubles
NEVER = -(2**62)


def shift_labels(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", every: int = 7, labels: int = 10) -> DataFrame:
    """Rows whose id is divisible by `every` get the next label, from 0 to labels - 1."""
    return vectors.withColumn(label_col, F.when(F.col(id_col) % every == 0, (F.col(label_col) + 1) % labels).otherwise(F.col(label_col)))


def _packed(q: np.ndarray) -> bytes:
    """Whole numbers in the narrowest of three widths, which the first byte tells."""
    most = np.abs(q).max()
    kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<i8"
    return bytes([int(kind[2])]) + q.astype(kind).tobytes()


def _matrix(raw: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of doubles filled up with zeros, and their lengths."""
    sizes = np.array([(len(x) - 1) // x[0] for x in raw], np.int64)
    if len(raw) and len({(x[0], len(x)) for x in raw}) == 1 and sizes[0] == width:
        flat = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)[:, 1:]
        return np.ascontiguousarray(flat).view(f"<i{raw[0][0]}").astype(np.float64), sizes
    out = np.zeros((len(raw), width))
    for i, x in enumerate(raw):
        out[i, : sizes[i]] = np.frombuffer(x, f"<i{x[0]}", offset=1)
    return out, sizes


def prepared(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """(id, label, v, size, sq, row): rows that take part, in whole numbers, with length, squared norm and a number of their own."""
    names = ["id", "label", "v", "size", "sq"]

    def work(batches):
        for batch in batches:
            lists = batch.column(2).cast(pa.list_(pa.float64()))
            values, sizes = lists.flatten(), np.asarray(lists.value_lengths().fill_null(0))
            ends, numbers = np.cumsum(sizes), values.to_numpy(zero_copy_only=False)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(numbers) | np.asarray(values.is_null()))])
            with np.errstate(over="ignore", invalid="ignore"):
                whole = np.floor(numbers * scale)
                squares = np.array([np.square(whole[e - s : e]).sum() for e, s in zip(ends, sizes, strict=True)])
            at = np.flatnonzero((bad[ends] == bad[ends - sizes]) & (sizes > 0) & (squares <= REACH**2))
            raw = [_packed(whole[ends[i] - sizes[i] : ends[i]]) for i in at]
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(raw, pa.binary()), pa.array(sizes[at], pa.int32()), pa.array(squares[at], pa.float64())], names)

    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("x")).where("id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL")
    return materialize(rows.mapInArrow(work, "id bigint, label string, v binary, size int, sq double").withColumn("row", F.monotonically_increasing_id()), "rows")


class Groups:
    """Pivots, and of each pivot's group of anchors: radius, norms, number of the first block, blocks, and scores still needed."""

    def __init__(self, pivots: np.ndarray, largest: float):
        n = len(pivots)
        self.pivots, self.m2, self.sq = pivots, largest, (pivots**2).sum(1)
        self.radius, self.most, self.least = np.zeros(n), np.zeros(n), np.zeros(n)
        self.first, self.blocks = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.low, self.high = np.full(n, np.inf), np.full(n, -np.inf)

    def distances(self, v: np.ndarray, lift: bool) -> np.ndarray:
        """From rows (lift: augmented) or anchors to the pivots, which are anchors."""
        own = np.full(len(v), self.m2) if lift else (v**2).sum(1)
        return np.sqrt(np.maximum(0, own[:, None] + self.sq[None] - 2 * (v @ self.pivots.T)))

    def served(self, v: np.ndarray) -> np.ndarray:
        """Which groups these rows might serve: the tighter of two bounds on each side, of augmented distances and of products with the pivot."""
        d = self.distances(v, True)
        product, turn = (self.sq + self.m2 - d**2) / 2, self.radius * np.sqrt((v**2).sum(1))[:, None]
        slack = 1e-9 * (self.m2 + self.most) + 1e-6
        above = np.minimum((self.most + self.m2 - np.maximum(0, d - self.radius) ** 2) / 2, product + turn) + slack
        below = np.maximum((self.least + self.m2 - (d + self.radius) ** 2) / 2, product - turn) - slack
        return (self.blocks > 0) & (above >= self.low) & (below <= self.high)


def _in_cells(rows: DataFrame, groups: Groups, lift: bool) -> DataFrame:
    """Adds cell, the nearest pivot, and far, the distance to it."""
    width = groups.pivots.shape[1]

    def work(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                d = groups.distances(_matrix(part.column("v").to_pylist(), width)[0], lift)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], [*part.schema.names, "cell", "far"])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(work, f"{names}, cell int, far double")


def _routed(rows: DataFrame, groups: Groups, home: bool, slices: int) -> DataFrame:
    """Rows once for every block they meet: of their own cell's group, or of the other groups that they might serve."""
    width = groups.pivots.shape[1]

    def work(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                cell = np.asarray(part.column("cell"))
                if home:
                    meets = np.zeros((len(cell), len(groups.pivots)), bool)
                    meets[np.arange(len(cell)), cell] = groups.blocks[cell] > 0
                else:
                    meets = groups.served(_matrix(part.column("v").to_pylist(), width)[0])
                    meets[np.arange(len(cell)), cell] = False
                at, group = np.nonzero(meets)
                times = groups.blocks[group]
                block = np.repeat(groups.first[group], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                for i in range(0, len(block), BATCH):
                    take = pa.array(np.repeat(at, times)[i : i + BATCH])
                    yield pa.RecordBatch.from_arrays([pa.array(block[i : i + BATCH]), *(part.column(c).take(take) for c in ("row", "id", "label", "v"))], ["block", "row", "id", "label", "v"])

    out = rows.select("row", "id", "label", "v", "cell").mapInArrow(work, "block bigint, row bigint, id bigint, label string, v binary")
    return out.withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int"))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exactly."""
    norm = lambda x: float(np.sqrt((x**2).sum(1).max())) if len(x) else 0.0
    if norm(a) * norm(b) < EXACT:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class Block:
    """Anchors of one block against streaming rows: per anchor and slot the first k rows seen."""

    def __init__(self, anchors: list[dict], width: int, k: int, low: int, negatives: bool):
        self.v, self.size = _matrix([a["v"] for a in anchors], width)
        self.row, self.id = np.array([a["row"] for a in anchors], np.int64), [a["id"] for a in anchors]
        self.label = np.array([a["label"] for a in anchors], object)
        self.width, self.k, self.low, self.negatives = width, k, low, negatives
        needs = [a["needs"] if negatives else [0] for a in anchors]
        self.slots = max(len(x) for x in needs)
        # a slot that an anchor lacks needs NEVER, which no score is below
        self.need = np.array([[*x, *[NEVER] * (self.slots - len(x))] for x in needs], np.int64)
        self.floor = np.array([[*(NEVER if f is None else f for f in a["floors"]), *[NEVER] * (self.slots - len(a["floors"]))] for a in anchors], np.int64)
        self.found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}

    def search(self, rows: pa.RecordBatch) -> None:
        ids, row = np.asarray(rows.column("id")), np.asarray(rows.column("row"))
        labels = np.array(rows.column("label").to_pylist(), object)
        v, sizes = _matrix(rows.column("v").to_pylist(), self.width)
        for start in range(0, len(self.v), ANCHORS):
            some = slice(start, start + ANCHORS)
            scores = _products(self.v[some], v)
            fits = (self.label[some, None] == labels[None]) != self.negatives
            fits &= self.size[some, None] == sizes[None]
            if not self.negatives:
                fits &= self.row[some, None] != row[None]
            for slot in range(self.slots):
                allowed = fits & (scores >= self.floor[some, slot, None])
                if self.negatives:
                    need = self.need[some, slot, None]
                    allowed &= (scores <= need) & (100 * scores >= self.low * np.maximum(need, NEVER // 100))
                for i in np.flatnonzero(allowed.any(1)):
                    self._keep(start + int(i), slot, np.flatnonzero(allowed[i]), scores[i], ids, row)

    def _keep(self, anchor: int, slot: int, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        s = scores[at]
        if len(at) > 4 * self.k:
            near = s >= np.partition(s, len(s) - self.k)[len(s) - self.k]
            at, s = at[near], s[near]
        best = np.lexsort((ids[at], -s))[: self.k]
        found = self.found.setdefault((anchor, slot), [])
        found += zip((-s[best]).tolist(), ids[at[best]].tolist(), row[at[best]].tolist(), strict=True)
        found.sort()
        del found[self.k :]
        if len(found) == self.k:
            self.floor[anchor, slot] = max(self.floor[anchor, slot], -found[-1][0])

    def results(self) -> Iterator[pa.RecordBatch]:
        out = [(int(self.row[a]), self.id[a], slot, id_, row, -neg) for (a, slot), found in self.found.items() for neg, id_, row in found]
        if out:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["anchor_row", "anchor_id", "slot", "id", "row", "score"])


_ANCHOR = "struct<row:bigint,id:bigint,label:string,v:binary,needs:array<bigint>,floors:array<bigint>>"


def _searched(routed: DataFrame, blocks: DataFrame, width: int, k: int, low: int, negatives: bool) -> DataFrame:
    """First k rows of every anchor and slot in each block and slice.

    Rows of a task are sorted by block, slice and kind: a block's anchors come first and the rows of the slice stream by.
    """

    def work(batches):
        held, at = None, None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("block", "slice", "kind")), strict=True))
            start = 0
            while start < len(keys):
                end = start + 1
                while end < len(keys) and end - start < BATCH and keys[end] == keys[start]:
                    end += 1
                if keys[start][2] == 0:
                    if held:
                        yield from held.results()
                    held, at, end = Block(batch.column("anchors")[start].as_py(), width, k, low, negatives), keys[start][:2], start + 1
                elif held and at == keys[start][:2]:
                    held.search(batch.slice(start, end - start))
                start = end
        if held:
            yield from held.results()

    rows = routed.selectExpr("block", "slice", "1 AS kind", f"cast(NULL AS array<{_ANCHOR}>) AS anchors", "row", "id", "label", "v")
    held = blocks.selectExpr("block", "slice", "0 AS kind", f"cast(anchors AS array<{_ANCHOR}>) AS anchors", "cast(NULL AS bigint) AS row", "cast(NULL AS bigint) AS id", "cast(NULL AS string) AS label", "cast(NULL AS binary) AS v")
    dealt = held.unionByName(rows).repartition("block", "slice").sortWithinPartitions("block", "slice", "kind")
    return dealt.mapInArrow(work, "anchor_row bigint, anchor_id bigint, slot int, id bigint, row bigint, score bigint")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k of every anchor and slot, with their rank."""
    order = Window.partitionBy("anchor_row", "slot").orderBy(F.col("score").desc(), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(cells: DataFrame, anchors: DataFrame, groups: Groups, k: int, low: int, negatives: bool, slices: int) -> DataFrame:
    """anchors (row, id, label, v, cell, block, needs): (anchor_row, anchor_id, slot, id, row, score, rank) of all rows."""
    width = groups.pivots.shape[1]
    none = F.expr("cast(array() AS array<bigint>)")

    def blocks(with_floors: DataFrame) -> DataFrame:
        packed = with_floors.groupBy("block").agg(F.collect_list(F.struct("row", "id", "label", "v", "needs", "floors")).alias("anchors"))
        return packed.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))

    home = materialize(_first(_searched(_routed(cells, groups, True, slices), blocks(anchors.withColumn("floors", none)), width, k, low, negatives), k), "home")
    if len(groups.pivots) == 1:
        return home
    full = home.groupBy("anchor_row", "slot").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") == k)
    floors = full.groupBy("anchor_row").agg(F.map_from_entries(F.collect_list(F.struct("slot", "kth"))).alias("kth"))
    known = anchors.join(floors, anchors["row"] == floors["anchor_row"], "left").drop("anchor_row")
    slots = "transform(needs, (need, i) -> element_at(kth, i))" if negatives else "array(element_at(kth, 0))"
    known = materialize(known.withColumn("floors", F.expr(slots)), "known")
    # what a slot still needs: no less than its K-th score so far and, for negatives, than LOW % of the positive's
    slot = known.select("cell", F.posexplode("needs").alias("i", "need"), "floors") if negatives else known.select("cell", F.lit(0).alias("i"), F.lit(2**62).alias("need"), "floors")
    least = f"greatest(coalesce(get(floors, i), {NEVER}), need * {low} / 100)" if negatives else f"coalesce(get(floors, i), {NEVER})"
    slot = slot.where("need >= 0") if negatives else slot
    groups.low[:], groups.high[:] = np.inf, -np.inf
    for r in slot.groupBy("cell").agg(F.min(F.expr(f"cast({least} AS double)")).alias("low"), F.max("need").alias("high")).collect():  # one row per pivot
        groups.low[r["cell"]], groups.high[r["cell"]] = r["low"], float(r["high"])
    others = _searched(_routed(cells, groups, False, slices), blocks(known), width, k, low, negatives)
    return _first(home.drop("rank").unionByName(others), k)


def mine(vectors: DataFrame, k: int = K, low: int = LOW, every: int = EVERY, group: int = GROUP, block: int = BLOCK, slice_rows: int = SLICE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; anchors: rows whose id is divisible by `every`."""
    rows = prepared(vectors, id_col, vector_col, label_col)
    anchors = rows.where(F.col("id") % every == 0)
    n = rows.agg(F.count("*").alias("rows"), F.count(F.when(F.col("id") % every == 0, 1)).alias("anchors"), F.max("sq").alias("sq"), F.max("size").alias("width")).first()
    if not n["anchors"]:
        return vectors.sparkSession.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    wanted = max(1, min(-(-n["anchors"] // group), PIVOTS, PIVOT_NUMBERS // n["width"]))
    chosen = anchors.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(wanted).collect()
    groups = Groups(_matrix([r["v"] for r in chosen], n["width"])[0], n["sq"])

    placed = materialize(_in_cells(anchors, groups, False), "anchors")
    for r in placed.groupBy("cell").agg(F.max("far").alias("far"), F.max("sq").alias("most"), F.min("sq").alias("least"), F.count("*").alias("n")).collect():  # one row per pivot
        c = r["cell"]
        groups.radius[c], groups.most[c], groups.least[c], groups.blocks[c] = r["far"], r["most"], r["least"], -(-r["n"] // block)
    groups.first = np.cumsum(groups.blocks) - groups.blocks
    at = lambda x: F.element_at(F.array(*(F.lit(int(y)) for y in x)), F.col("cell") + 1)
    placed = placed.withColumn("block", at(groups.first) + F.pmod(F.xxhash64("row"), F.greatest(at(groups.blocks), F.lit(1))))
    slices = max(-(-n["rows"] // slice_rows), min(SLICES, -(-n["rows"] // LEAST_SLICE)))
    cells = materialize(_in_cells(rows, groups, True), "cells")

    needs = F.expr("cast(NULL AS array<bigint>)")
    positives = materialize(_search(cells, placed.withColumn("needs", needs), groups, k, low, False, slices).select("anchor_row", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    wanted_of = positives.groupBy("anchor_row").agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "positive_score"))), lambda x: x["positive_score"]).alias("needs"))
    with_needs = materialize(placed.join(wanted_of, placed["row"] == wanted_of["anchor_row"]).drop("anchor_row"), "needs")
    negatives = _search(cells, with_needs, groups, k, low, True, slices)
    return negatives.join(positives, ["anchor_row", "slot"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: Compares every anchor with every row; distinct ids and vectors of one length.
ORACLE_SQL = f"""
WITH r AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % {EVERY} = 0 AND b.vec_id <> a.vec_id),
pos AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {K}),
neg AS (
  SELECT p.anchor_id, p.positive_id, n.other_id AS negative_id, p.positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) AS rank
  FROM pos p JOIN pairs n ON p.anchor_id = n.anchor_id AND NOT n.same AND {LOW} * p.positive_score <= 100 * n.score AND n.score <= p.positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= {K}"""
