"""Embedding near-dedup: exact threshold pairs by a dual traversal of cover trees.

Vectors are scaled to length 1; cosine >= t is then a Euclidean distance of at most r = sqrt(2 - 2 t), a metric. Equal vectors of one
label fall together first, with their number as weight.

Distribution: a cell is at first all vectors of one label, and fits a task up to CELL vectors. A larger one is dealt again and
again: centers chosen far apart in it are its next level, a vector is at home in the cell of its nearest center, and a guest in a
lower-numbered one unless it lies more than r beyond the border between the two centers, so that two linked vectors always
meet where the lower-numbered of the two is at home. Each vector carries in which levels it is a guest; a pair counts where it is
not guests of one level, which is in one cell only. A cell that dealing doesn't part (vectors spread evenly in many dimensions
are such) is dealt as blocks of itself, every pair of blocks in one task: exact, no task unbounded, quadratic in that cell.

In a task: a cover tree has nested levels with halving radii; node pairs farther apart than both covering radii plus r
hold no link, pairs whose farthest members are within r are all links and are counted without being listed, leaves are
compared in double precision. Centers of a level are found and compared in matrix blocks. Links are counted per vector; for
the components only links that join something new are handed on.

Cases: null or zero vectors, null or non-finite components, and null labels link with nothing; vectors of different
lengths don't link; null ids count as vectors without an id, kept only where no vector of their component has one; repeated rows are vectors of their own; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, with_groups

THRESHOLD = 0.98
CENTERS, SAMPLE, CELL, LEAF = 64, 2048, 16384, 24
CELL_NUMBERS = 8_000_000  # most vector components of a cell, which lowers CELL for long vectors
PARTED, COPIES, LEVELS = 0.7, 4.0, 40  # a dealt cell: largest part, all parts together, most times of dealing
CHUNK, BATCH = 8192, 256
BLOCK_PAIRS = 300  # pairs of vectors that cost as much in a block as one pair of nodes does by itself
SLACK = 1e-7


def _unit(raw: list[bytes]) -> np.ndarray:
    v = np.stack([np.frombuffer(x, np.float64) for x in raw])
    return v / np.linalg.norm(v, axis=1, keepdims=True)


class Node:
    __slots__ = ("center", "radius", "children", "points", "weight", "lazy")

    def __init__(self, center: int, radius: float, points: np.ndarray, weight: int):
        self.center, self.radius, self.points, self.weight = center, radius, points, weight
        self.children: list[Node] = []
        self.lazy = 0


class CoverTree:
    """Cover tree over unit vectors: the members of a node lie within its radius, its children cover them at half that."""

    def __init__(self, vectors: np.ndarray, weights: np.ndarray):
        self.v, self.w = vectors, weights
        ids = np.arange(len(vectors))
        d = self._from(0, ids)
        self.root = self._grow(0, ids, d, float(d.max()) if len(d) else 0.0)

    def _from(self, center: int, ids: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * (self.v[ids] @ self.v[center])))

    def _grow(self, center: int, ids: np.ndarray, d: np.ndarray, level: float) -> Node:
        node = Node(center, float(d.max()), ids, int(self.w[ids].sum()))
        if len(ids) <= LEAF or node.radius <= SLACK:
            return node
        half = min(level, node.radius) / 2
        # nested: the node's own center is the first child's; the next ones are points that no center covers yet
        near = (d <= half) | (ids == center)
        node.children.append(self._grow(center, ids[near], d[near], half))
        left = ids[~near]
        while len(left):
            candidates = left[:BATCH]
            dist = np.sqrt(np.maximum(0, 2 - 2 * (self.v[left] @ self.v[candidates].T)))
            chosen, covered = [], np.zeros(len(candidates), bool)
            for j in range(len(candidates)):
                if not covered[j]:
                    chosen.append(j)
                    covered |= dist[: len(candidates), j] <= half
            near = dist[:, chosen] <= half
            near[chosen] = np.eye(len(chosen), dtype=bool)
            got, which = near.any(1), near.argmax(1)
            members = np.flatnonzero(got)
            members = members[np.argsort(which[members], kind="stable")]
            for part in np.split(members, np.flatnonzero(np.diff(which[members])) + 1):
                j = chosen[which[part[0]]]
                node.children.append(self._grow(int(candidates[j]), left[part], dist[part, j], half))
            left = left[~got]
        return node


class Joiner:
    """Links between or within trees over one array of vectors: counts per vector, and links that connect."""

    def __init__(self, vectors: np.ndarray, weights: np.ndarray, threshold: float):
        self.v, self.w, self.t = vectors, weights, threshold
        self.r = float(np.sqrt(2 - 2 * threshold))
        self.counts = np.zeros(len(vectors), np.int64)
        self.parent = np.arange(len(vectors))
        self.edges: list[tuple[int, int]] = []

    def roots(self, ids: np.ndarray) -> np.ndarray:
        at = self.parent[ids]
        while ((up := self.parent[at]) != at).any():
            at = up
        self.parent[ids] = at
        return at

    def _edges(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links a[i], b[i]: one is handed on for each two components that they join."""
        while True:
            x, y = self.roots(a), self.roots(b)
            new = x != y
            if not new.any():
                return
            a, b, x, y = a[new], b[new], x[new], y[new]
            # of the links at each greater root, one; the others are looked at again
            high, at = np.unique(np.maximum(x, y), return_index=True)
            self.parent[high] = np.minimum(x, y)[at]
            self.edges += zip(a[at].tolist(), b[at].tolist(), strict=True)

    def _brute(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        for i in range(0, len(a), 1024):
            some = a[i : i + 1024]
            hit = self.v[some] @ self.v[b].T >= self.t
            if same:
                hit[np.arange(len(some)), np.arange(i, i + len(some))] = False
            if hit.any():
                self.counts[some] += hit @ self.w[b]
                if not same:
                    self.counts[b] += self.w[some] @ hit
                x, y = np.nonzero(hit)
                self._edges(some[x], b[y])

    def _all(self, a: np.ndarray, b: np.ndarray, wa: int, wb: int) -> None:
        self.counts[a] += wb
        self.counts[b] += wa
        self._edges(np.full(len(b), a[0]), b)
        self._edges(a[1:], np.full(len(a) - 1, b[0]))

    def within(self, node: Node) -> None:
        stack = [node]
        while stack:
            n = stack.pop()
            if 2 * n.radius <= self.r - SLACK:
                self.counts[n.points] += n.weight - self.w[n.points]
                self._edges(np.full(len(n.points) - 1, n.points[0]), n.points[1:])
            elif not n.children:
                self._brute(n.points, n.points, True)
            else:
                stack += n.children
                self._pairs(n.children, n.children, True)

    def _pairs(self, xs: list[Node], ys: list[Node], same: bool) -> None:
        """Children against children: one block of center distances prunes most pairs at once."""
        cy, ry = np.array([y.center for y in ys]), np.array([y.radius for y in ys])
        for i in range(0, len(xs), 512):
            part = xs[i : i + 512]
            cx, rx = np.array([x.center for x in part]), np.array([x.radius for x in part])
            d = np.sqrt(np.maximum(0, 2 - 2 * (self.v[cx] @ self.v[cy].T)))
            close = d <= rx[:, None] + ry[None, :] + self.r + SLACK
            if same:
                close &= np.arange(len(ys))[None, :] > (i + np.arange(len(part)))[:, None]
            found = int(close.sum())
            if not found:
                continue
            # where most children are close to each other, as in a loose cluster of copies, one block of all their members is cheaper
            left, right = sum(len(x.points) for x in part), sum(len(y.points) for y in ys)
            if left * right <= BLOCK_PAIRS * found:
                self._block(part, ys, i if same else None)
                continue
            for p, q in zip(*np.nonzero(close), strict=True):
                self.between(part[p], ys[q], d[p, q])

    def _block(self, xs: list[Node], ys: list[Node], first: int | None) -> None:
        """All members of xs against all of ys. first: the place of xs in ys where both are children of one node; then each pair of
        different children counts once, and pairs inside a child don't."""
        b = np.concatenate([y.points for y in ys])
        vectors, child = self.v[b].T, np.repeat(np.arange(len(ys)), [len(y.points) for y in ys])
        a = np.concatenate([x.points for x in xs])
        mine = np.repeat(np.arange(len(xs)), [len(x.points) for x in xs])
        for i in range(0, len(a), BATCH):
            some = a[i : i + BATCH]
            hit = self.v[some] @ vectors >= self.t
            if first is not None:
                hit &= child[None, :] > (first + mine[i : i + BATCH])[:, None]
            if hit.any():
                self.counts[some] += hit @ self.w[b]
                self.counts[b] += self.w[some] @ hit
                x, y = np.nonzero(hit & (self.roots(some)[:, None] != self.roots(b)[None, :]))
                self._edges(some[x], b[y])

    def between(self, a: Node, b: Node, d: float | None = None) -> None:
        if d is None:
            d = float(np.sqrt(max(0, 2 - 2 * float(self.v[a.center] @ self.v[b.center]))))
        if d > a.radius + b.radius + self.r + SLACK:
            return
        if d + a.radius + b.radius <= self.r - SLACK:
            self._all(a.points, b.points, a.weight, b.weight)
        elif not a.children and not b.children or len(a.points) * len(b.points) <= LEAF * LEAF:
            self._brute(a.points, b.points, False)
        elif a.children and (not b.children or a.radius >= b.radius):
            self._pairs(a.children, [b], False)
        else:
            self._pairs([a], b.children, False)


def _centers(part: pd.DataFrame) -> pd.DataFrame:
    """Next level of a cell: centers far from each other, out of a sample of its vectors."""
    part = part.sort_values("key")
    v = _unit(part["vector"].tolist())
    chosen, d = [0], np.linalg.norm(v - v[0], axis=1)
    while len(chosen) < CENTERS and d.max() > 0.1:
        chosen.append(int(d.argmax()))
        d = np.minimum(d, np.linalg.norm(v - v[chosen[-1]], axis=1))
    return pd.DataFrame({"cell": part["cell"].iloc[0], "number": np.arange(len(chosen)), "center": [v[c].tobytes() for c in chosen]})


def _deal(rows: pd.DataFrame, centers: pd.DataFrame, radius: float, level: int) -> pd.DataFrame:
    """Each vector in its home and in the cells where it is a guest."""
    if not len(rows):
        return pd.DataFrame({"cell": [], "number": [], "key": [], "guest": [], "dim": []})
    centers = centers.sort_values("number")
    c, v = np.stack([np.frombuffer(x, np.float64) for x in centers["center"]]), _unit(rows["vector"].tolist())
    between = np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T)))
    square = np.maximum(0, 2 - 2 * (v @ c.T))
    home = square.argmin(1)
    # how far v lies beyond the plane between its own center and another: at most r for a link across
    beyond = square - square[np.arange(len(v)), home][:, None]
    near = beyond <= 2 * (radius + SLACK) * between[home] + SLACK
    near &= np.arange(len(c))[None, :] < home[:, None]  # the pair counts in the lower of the two cells
    near[np.arange(len(v)), home] = True
    who, number = np.nonzero(near)
    x = rows.iloc[who]
    guest = x["guest"].to_numpy(np.int64) | np.where(home[who] == number, 0, 1 << level)
    return pd.DataFrame({"cell": x["cell"].to_numpy(), "number": number, "key": x["key"].to_numpy(), "guest": guest, "dim": x["dim"].to_numpy()})


def _dealer(radius: float, level: int):
    return lambda rows, centers: _deal(rows, centers, radius, level)


def _join_cell(part: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of one task: blocks a and b of a cell; members of one block only, if a = b."""
    v, w = _unit(part["vector"].tolist()), part["weight"].to_numpy(np.int64)
    guest, block, keys = part["guest"].to_numpy(np.int64), part["block"].to_numpy(), part["key"].tolist()
    a, b = part["a"].iloc[0], part["b"].iloc[0]
    joiner = Joiner(v, w, threshold)

    def tree(ids: np.ndarray) -> Node:
        t = CoverTree(v[ids], w[ids])
        stack = [t.root]
        while stack:
            n = stack.pop()
            n.center, n.points = int(ids[n.center]), ids[n.points]
            stack += n.children
        return t.root

    def trees(of: int) -> dict[int, Node]:
        return {int(g): tree(np.flatnonzero((block == of) & (guest == g))) for g in np.unique(guest[block == of])}

    left = trees(a)
    right = left if a == b else trees(b)
    for g, x in left.items():
        for h, y in right.items():
            if g & h or (a == b and g > h):
                continue  # guests of one level meet elsewhere
            if x is y:
                joiner.within(x)
            else:
                joiner.between(x, y)
    got = np.flatnonzero(joiner.counts)
    out = [(keys[i], None, int(joiner.counts[i])) for i in got] + [(keys[x], keys[y], 0) for x, y in joiner.edges]
    return pd.DataFrame(out, columns=["u", "v", "links"])


def _room(cell: int):
    """Vectors that a cell may hold, by column dim."""
    return F.greatest(F.lit(16), F.least(F.lit(cell), F.lit(CELL_NUMBERS) / F.col("dim")))


def _cells(points: DataFrame, radius: float, cell: int) -> DataFrame:
    """Rows (cell, dim, guest, key): cells of at most cell_size vectors, but for those that dealing doesn't part."""
    placed = materialize(points.select(F.xxhash64("label", "dim").alias("cell"), "dim", F.lit(0).cast("bigint").alias("guest"), "key"), "cells")
    done, vectors = None, points.select("key", "vector")
    for level in range(LEVELS):
        sizes = materialize(placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("dim").alias("dim")), "sizes")
        large = sizes.where(F.col("n") > _room(cell)).select("cell", "n")
        if large.isEmpty():
            break
        fits = placed.join(large, "cell", "left_anti")
        done = fits if done is None else done.unionByName(fits)
        big = placed.join(large, "cell").join(vectors, "key")
        share = F.greatest(F.lit(1.0), F.lit(float(SAMPLE)) / F.col("n") * (1 << 20))
        sample = big.where(F.pmod(F.xxhash64("key", F.lit(level)), F.lit(1 << 20)) < share).select("cell", "key", "vector")
        centers = materialize(sample.groupBy("cell").applyInPandas(_centers, "cell bigint, number int, center binary"), "centers")
        chunks = large.select("cell", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
        spread = big.join(chunks, "cell").withColumn("chunk", F.pmod(F.xxhash64("key"), "chunks").cast("int"))
        copies = centers.join(chunks, "cell").withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)")))
        dealt = (
            spread.select("cell", "chunk", "dim", "guest", "key", "vector").groupBy("cell", "chunk").cogroup(copies.select("cell", "chunk", "number", "center").groupBy("cell", "chunk"))
            .applyInPandas(_dealer(radius, level), "cell bigint, number int, key binary, guest bigint, dim int")
        )
        dealt = materialize(dealt, "dealt")
        parts = dealt.groupBy("cell", "number").agg(F.count("*").alias("n")).groupBy("cell").agg(F.max("n").alias("most"), F.sum("n").alias("all"))
        parted = materialize(large.join(parts, "cell").where((F.col("most") <= PARTED * F.col("n")) & (F.col("all") <= COPIES * F.col("n"))).select("cell"), "parted")
        done = done.unionByName(placed.join(large, "cell", "left_semi").join(parted, "cell", "left_anti"))
        placed = materialize(dealt.join(parted, "cell", "left_semi").select(F.xxhash64("cell", "number", F.lit(level)).alias("cell"), "dim", "guest", "key"), "cells")
    return placed if done is None else done.unionByName(placed)


def near_dedup(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cell: int = CELL) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept."""
    radius = float(np.sqrt(2 - 2 * threshold))
    plain = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))

    def encode(batches):
        for batch in batches:
            out = []
            for v, label in zip(batch.column("v").to_pylist(), batch.column("label").to_pylist(), strict=True):
                x = None
                if v and label is not None and None not in v:
                    a = np.array(v, np.float64) + 0.0
                    with np.errstate(over="ignore"):
                        norm = np.linalg.norm(a)
                    if np.isfinite(a).all() and np.abs(a).max() > 0:
                        # scaled before the norm where squares would leave the range of doubles
                        x = a.tobytes() if 1e-100 < norm < 1e100 else (a / np.abs(a).max()).tobytes()
                out.append(x)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(out, pa.binary())], ["vec_id", "label", "vector"])

    rows = plain.mapInArrow(encode, "vec_id bigint, label string, vector binary")
    rows = materialize(rows.withColumn("key", F.when(F.col("vector").isNotNull(), F.unhex(F.sha2(F.concat(F.col("vector"), F.col("label").cast("binary")), 256)))), "vectors")
    points = rows.where("key IS NOT NULL").groupBy("key").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("weight"))
    points = materialize(points.withColumn("dim", (F.length("vector") / 8).cast("int")), "points")

    # a cell is one task, or the pairs of its blocks where dealing didn't part it
    cells = _cells(points, radius, cell)
    sizes = cells.groupBy("cell").agg(F.ceil(F.count("*") / F.max(_room(cell))).cast("int").alias("blocks"))
    placed = cells.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("key", F.lit(7)), "blocks").cast("int"))
    pairs = placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("a", F.least("block", "other")).withColumn("b", F.greatest("block", "other"))
    work = pairs.join(points.select("key", "vector", "weight", "label"), "key").select("cell", "label", "dim", "a", "b", "block", "guest", "key", "vector", "weight")
    found = materialize(work.groupBy("cell", "label", "dim", "a", "b").applyInPandas(lambda p: _join_cell(p, threshold), "u binary, v binary, links bigint"), "pairs")

    links = found.where("v IS NULL").groupBy("u").agg(F.sum("links").alias("links")).withColumnRenamed("u", "key")
    group = components(found.where("v IS NOT NULL").select("u", "v")).withColumnRenamed("node", "key")
    least_id = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("least"))
    known = points.select("key", "weight").join(least_id, "key").join(links, "key", "left").join(group, "key", "left").select("key", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "key").alias("root"), "least")
    known = materialize(known, "known")
    top = known.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("k"))
    by_key = with_groups(known, top, ["root"], "k").select("key", "n_links", "component")
    out = rows.select("vec_id", "key").join(by_key, "key", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


#: The same by comparing all pairs of a label and a transitive closure, for tables of test size.
ORACLE_SQL = """
WITH RECURSIVE t AS (SELECT vec_id, embedding::double[] AS v, label FROM embeddings),
g AS (SELECT vec_id, v, label FROM t WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98),
c(u, v) AS (SELECT vec_id, vec_id FROM t UNION SELECT c.u, l.v FROM c JOIN l ON c.v = l.u), m AS (SELECT u, min(v) AS component_id FROM c GROUP BY u), n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM t JOIN m ON vec_id = m.u LEFT JOIN n ON vec_id = n.u
"""
