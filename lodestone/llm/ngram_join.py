"""N-gram Jaccard join: an exact metric-space self-join of documents under the Jaccard distance of word shingles.

The distance 1 - |A & B| / |A | B| is a metric. Two documents link when their similarity is at least 4/5, that is
at a distance of at most 1/5. The join finds every connected component of the links:

1. Equal sets fall together: everything below works on distinct sets, named by a 128-bit digest.
2. Pivots. A document in random prose is at distance 1 from nearly all others, where no pivot can tell documents
   apart; so pivots are chosen where distances are below 1. Linked sets A, B share an element among the first
   |A| - ceil(4/5 |A|) + 1 elements of A and likewise of B, in any order common to all sets. The order taken here
   puts the shingles of a quarter of the hash range first, rarest first, so that this head of a set seldom
   meets unrelated sets. Of all sets whose heads hold one shingle, the one with the least digest is the pivot.
3. Voronoi regions. A set belongs to the region of every pivot it meets; linked sets share a region. Its distance to
   the pivot is computed exactly. Sets within 1/5 link to the pivot. Inside a region, sets whose distances to a pivot
   differ by more than 1/5 can't link (triangle inequality), and sets joined to one pivot need no comparison with
   each other. Remaining sets choose further pivots and go to the cell of the nearest; a set x is replicated to the
   cell of pivot p when d(x, p) <= d(x, nearest) + 2/5, and cells are joined recursively, at the end exactly.
4. A region too large for one task goes through distributed rounds. A round by the same rule takes the members of its
   smallest components as pivots, compares every member with them in salted chunks, and gives cells, windows and links.
5. Where the windows don't part a region and the pivots don't connect it (sets at distances just beyond 1/5, such as pages of one
   template), a second exact filter does: in the order of rarity inside the region, two linked sets share an element
   among the first |A| - ceil(8/9 |A|) + 1 of the smaller set and the first |B| - ceil(4/5 |B|) + 1 of the larger. So every set
   is compared only with those that hold one of its few rarest elements early, in memory or in tasks over bounded chunks.
   Whatever the data, the rounds are few.

Cases: null or blank texts have an empty set and link with nothing; null ids take part, and count for nothing in the
least id of a component; repeated ids and rows stay one output row each; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bloom, components, in_bloom, materialize, most_frequent, per_key, with_groups
from .shingles import shingle_sets

NUM, DEN = 4, 5  # links at similarity >= NUM / DEN
FIRST = np.uint64(1 << 62)  # shingle hashes below this stand first in the common order
CHUNK = 1 << 20  # hashes among which locally frequent shingles are looked for
FREQUENT = 16  # occurrences in a chunk that make a shingle a candidate for the table of frequent ones
TABLE = 1 << 16  # most entries of the broadcast table of frequent shingles: 512 KB
PER_BUCKET = 1_000_000  # shingles counted in one task at a time
REGION_MB = 48  # sets of a region that one task joins in memory
LEAF = 16  # sets compared pair by pair
PARTED, COPIES = 0.7, 4.0  # a dealt region or cell: largest part, all parts together
ROUNDS = 40  # most distributed rounds; what they leave is finished by rare elements


def head_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def probe_length(n):
    """How much of a set of n elements must be looked at where the other one may have any size."""
    return n + (-NUM * n) // DEN + 1


def index_length(n):
    """The same where the other set is at least as large."""
    return n + (-2 * NUM * n) // (NUM + DEN) + 1


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _signatures(text: str, id_col: str):
    """Rows (id, tag, n_shingles, sid) and rows of locally frequent shingles (hot, hot_count)."""
    names = ["doc_id", "tag", "n_shingles", "sid", "hot", "hot_count"]

    def work(batches):
        kept, size = [], 0

        def frequent():
            values, counts = np.unique(np.concatenate(kept), return_counts=True)
            hot = counts >= FREQUENT
            n = int(hot.sum())
            return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(values[hot].astype(np.int64)), pa.array(counts[hot].astype(np.int64))], names)

        for batch in batches:
            lengths, sids = [], []
            for s in shingle_sets(batch.column(text)):
                lengths.append(len(s))
                sids.append(_digest(s) if len(s) else None)
                first = s[: np.searchsorted(s, FIRST)]
                kept.append(first)
                size += len(first)
                if size >= CHUNK:
                    yield frequent()
                    kept, size = [], 0
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("tag_"), pa.array(lengths, pa.int64()), pa.array(sids, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names)
        if kept:
            yield frequent()

    return work


def _heads(hot: np.ndarray):
    """Distinct sets of a batch: digest, size, and the part that stands first in the common order."""
    ranked = np.sort(hot)

    def work(batches):
        for batch in batches:
            rows = {}
            for s in shingle_sets(batch.column(0)):
                if not len(s) or (sid := _digest(s)) in rows:
                    continue
                p = head_length(len(s))
                c = int(np.searchsorted(s, FIRST))
                first = s[:c]
                at = np.searchsorted(ranked, first)
                is_hot = (at < len(ranked)) & (ranked[np.minimum(at, len(ranked) - 1)] == first) if len(ranked) else np.zeros(c, bool)
                # what is missing from the first part alone comes from the rest, in hash order
                rows[sid] = (len(s), first[~is_hot].tobytes(), first[is_hot].tobytes(), s[c : max(c, p)].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.binary()), pa.array([x[0] for x in rows.values()], pa.int64()), *(pa.array([x[k] for x in rows.values()], pa.binary()) for k in (1, 2, 3))], ["sid", "n", "first", "hots", "rest"])

    return work


def _deal(buckets: int):
    """Each set's first shingles by range of hash, packed by (batch, range); the set's own row goes along with one of them."""
    width = -(-int(FIRST) // buckets)

    def work(batches):
        for batch in batches:
            sids = batch.column("sid").to_pylist()
            firsts = [np.frombuffer(x, np.uint64) for x in batch.column("first").to_pylist()]
            sizes = np.array([len(x) for x in firsts])
            owner = np.repeat(np.arange(len(sids)), sizes)
            values = np.concatenate(firsts) if firsts else np.zeros(0, np.uint64)
            bucket = (values // np.uint64(width)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            values, owner, bucket = values[order], owner[order], bucket[order]
            home = np.array([int.from_bytes(x[:6], "little") % buckets for x in sids], np.int64)
            keys, blobs, owners, counts, metas = [], [], [], [], []
            by_home = np.argsort(home, kind="stable")
            # the buckets that this batch has something for, however many there are in all
            present = np.union1d(bucket, home)
            edges = np.searchsorted(bucket, present), np.searchsorted(bucket, present, "right")
            homes = np.searchsorted(home[by_home], present), np.searchsorted(home[by_home], present, "right")
            rows = batch.select(["n", "hots", "rest"]).to_pylist()
            for b, lo, hi, first, last in zip(present.tolist(), *edges, *homes, strict=True):
                who, n = np.unique(owner[lo:hi], return_counts=True)
                keys.append(b)
                blobs.append(values[lo:hi].tobytes())
                owners.append(b"".join(sids[i] for i in who))
                counts.append(n.astype(np.uint32).tobytes())
                metas.append([{"sid": sids[i], "c": int(sizes[i]), **rows[i]} for i in by_home[first:last].tolist()])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary()), pa.array(owners, pa.binary()), pa.array(counts, pa.binary()), pa.array(metas, META)], ["bucket", "shingles", "owners", "counts", "metas"])

    return work


META = pa.list_(pa.struct([("sid", pa.binary()), ("n", pa.int64()), ("c", pa.int64()), ("hots", pa.binary()), ("rest", pa.binary())]))
META_SQL = "array<struct<sid:binary,n:bigint,c:bigint,hots:binary,rest:binary>>"


def _shared(part: pa.Table) -> pa.Table:
    """Per set: its shingles of this range that other sets hold too, with the number of sets; and the sets' own rows."""
    shingles, sids = [], []
    for blob, owners, counts in zip(part.column("shingles").to_pylist(), part.column("owners").to_pylist(), part.column("counts").to_pylist(), strict=True):
        sids.append(np.repeat(np.frombuffer(owners, "S16") if owners else np.zeros(0, "S16"), np.frombuffer(counts, np.uint32)))
        # within a batch, shingles are in bucket order by stable sort: still by owner
        shingles.append(np.frombuffer(blob, np.uint64))
    s, o = np.concatenate(shingles), np.concatenate(sids)
    values, which, df = np.unique(s, return_inverse=True, return_counts=True)
    keep = df[which] > 1
    s, o, df = s[keep], o[keep], df[which][keep]
    order = np.argsort(o, kind="stable")
    s, o, df = s[order], o[order], df[order]
    cuts = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]])) if len(o) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(o)).astype(np.int64)[: len(cuts)]
    out_sid = [o[a].ljust(16, b"\0") for a in cuts]
    out = {"sid": out_sid, "shingles": [s[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], "dfs": [df[a:b].astype(np.uint32).tobytes() for a, b in zip(cuts, ends, strict=True)], "meta": [None] * len(cuts)}
    for metas in part.column("metas").to_pylist():
        for m in metas:
            out["sid"].append(m["sid"])
            out["shingles"].append(None)
            out["dfs"].append(None)
            out["meta"].append({k: m[k] for k in ("n", "c", "hots", "rest")})
    return pa.table([pa.array(out["sid"], pa.binary()), pa.array(out["shingles"], pa.binary()), pa.array(out["dfs"], pa.binary()), pa.array(out["meta"], SET_META)], ["sid", "shingles", "dfs", "meta"])


SET_META = pa.struct([("n", pa.int64()), ("c", pa.int64()), ("hots", pa.binary()), ("rest", pa.binary())])


def _head_of(hot_rank: dict[int, int]):
    """The shared shingles in a set's head: rows (shingle, sid)."""

    def one(part: pa.Table) -> pa.Table | None:
        rows = part.to_pylist()
        meta = next((r["meta"] for r in rows if r["meta"]), None)
        s = [np.frombuffer(r["shingles"], np.uint64) for r in rows if r["shingles"]]
        d = [np.frombuffer(r["dfs"], np.uint32) for r in rows if r["dfs"]]
        s = np.concatenate(s) if s else np.zeros(0, np.uint64)
        d = np.concatenate(d) if d else np.zeros(0, np.uint32)
        room = head_length(meta["n"]) - (meta["c"] - len(s))
        if room <= 0:
            return None
        head = s[np.lexsort((s, d))][:room]
        for more in (np.array(sorted(np.frombuffer(meta["hots"], np.uint64), key=lambda x: hot_rank[int(x)]), np.uint64), np.frombuffer(meta["rest"], np.uint64)):
            head = np.concatenate([head, more[: max(0, room - len(head))]])
        return pa.table([pa.array(head.astype(np.int64)), pa.array([rows[0]["sid"]] * len(head), pa.binary())], ["shingle", "sid"])

    return one


def _full_sets(text: str, bits: Broadcast):
    """The whole sets of texts whose digest may be among those asked for."""

    def work(batches):
        for batch in batches:
            sids, sets = [], []
            seen = set()
            for s in shingle_sets(batch.column(text)):
                if len(s) and (sid := _digest(s)) not in seen and in_bloom(bits.value, [sid])[0]:
                    seen.add(sid)
                    sids.append(sid)
                    sets.append(s.tobytes())
                    if len(sids) >= 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(sids, pa.binary()), pa.array(sets, pa.binary())], ["sid", "items"])
                        sids, sets = [], []
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.binary()), pa.array(sets, pa.binary())], ["sid", "items"])

    return work


def _cells(dist: np.ndarray) -> np.ndarray:
    """Which sets belong to which pivot's cell: at home in the nearest one's, guests in those before it that a link may reach.
    Linked sets meet where the one whose home comes first is at home."""
    home = dist.argmin(0)
    near = dist <= dist.min(0) + 2 * (1 - NUM / DEN + 1e-9)
    order = np.arange(len(dist))[:, None]
    return near & (order < home) | (order == home)


class Region:
    """Sets of one region in memory, as one array of item numbers with offsets."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(x) for x in sets], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.n)])
        values, self.items = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(values), bool)
        self.parent = np.arange(len(sets))
        self.found: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def roots(self, ids: np.ndarray) -> np.ndarray:
        return np.array([self.find(i) for i in ids.tolist()], np.int64)

    def common(self, p: int, ids: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of set p with each of ids."""
        mine = self.items[self.offsets[p] : self.offsets[p + 1]]
        self.mark[mine] = True
        lengths = self.n[ids]
        starts = np.concatenate([[0], np.cumsum(lengths)])
        at = np.arange(starts[-1]) + np.repeat(self.offsets[ids] - starts[:-1], lengths)
        got = np.add.reduceat(self.mark[self.items[at]].astype(np.int64), starts[:-1]) if len(ids) else np.zeros(0, np.int64)
        self.mark[mine] = False
        return got

    def links(self, p: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances from p to ids, and which of them link, decided in whole numbers."""
        both = self.common(p, ids)
        union = self.n[p] + self.n[ids] - both
        return 1 - both / union, DEN * both >= NUM * union

    def link(self, a: int, ids: np.ndarray) -> None:
        """Note links of a with ids: one for each component that they join."""
        for b in ids.tolist():
            if (x := self.find(a)) != (y := self.find(b)):
                self.parent[max(x, y)] = min(x, y)
                self.found.append((a, b))

    def join(self) -> list[tuple[int, int]]:
        """Links that connect exactly what all links connect."""
        self._cell(np.arange(len(self.n)), 0)
        return self.found

    def _cell(self, ids: np.ndarray, depth: int) -> None:
        radius = 1 - NUM / DEN + 1e-9
        while len(ids) > 1:
            r = self.roots(ids)
            if r.min() == r.max():
                return  # all connected already
            if len(ids) <= LEAF:
                p, ids = ids[0], ids[1:]
                other = ids[self.roots(ids) != self.find(p)]
                self.link(p, other[self.links(p, other)[1]])
                continue
            if depth > 6:
                return self._by_prefix(ids)
            # several pivots at a time, then cells around them
            pivots = self._pivots(ids, r)
            rows = []
            for p in pivots:
                d, linked = self.links(p, ids)
                self.link(p, ids[linked])
                rows.append(d)
            stay = ~np.isin(ids, pivots)
            left, dist = ids[stay], np.stack(rows)[:, stay]
            after = self.roots(left)
            if not len(left) or after.min() == after.max():
                return
            cells = _cells(dist)
            sizes = cells.sum(1)
            if sizes.max() <= PARTED * len(left) and sizes.sum() <= COPIES * len(left):
                for k, part in enumerate(cells):
                    # members of one component that lie outside every window of the others need no more work
                    self._cell(self._window(left[part], dist[k][part], radius), depth + 1)
                return
            if len(np.unique(after)) > PARTED * len(np.unique(r)):
                return self._by_prefix(left)  # neither parted nor connected
            ids = left  # the pivots are settled; go on with the others

    def _by_prefix(self, ids: np.ndarray) -> None:
        """Every set against those that hold one of its rarest elements early enough, see point 5 above."""
        n = self.n[ids]
        starts = np.concatenate([[0], np.cumsum(n)])
        owner = np.repeat(np.arange(len(ids)), n)
        items = self.items[np.arange(starts[-1]) + np.repeat(self.offsets[ids] - starts[:-1], n)]
        held = np.bincount(items, minlength=len(self.mark))
        order = np.lexsort((items, held[items], owner))
        items, place = items[order], np.arange(starts[-1]) - starts[owner]
        early = (place < probe_length(n)[owner]) & (held[items] > 1)
        items, owner, place = items[early], owner[early], place[early]
        # postings: for each element the sets that hold it early
        by_item = np.argsort(items, kind="stable")
        values, first = np.unique(items[by_item], return_index=True)
        last = np.append(first[1:], len(items))
        of_set = np.searchsorted(owner, np.arange(len(ids) + 1))
        index = index_length(n)
        for a in range(len(ids)):
            mine = np.arange(of_set[a], of_set[a + 1])
            mine = mine[place[mine] < index[a]]
            if not len(mine):
                continue
            at = np.searchsorted(values, items[mine])
            size = last[at] - first[at]
            which = np.repeat(np.arange(len(mine)), size)
            entry = by_item[np.arange(size.sum()) + np.repeat(first[at] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)]
            b = owner[entry]
            # at the first element they share, what may still follow in both must suffice
            most = 1 + np.minimum(n[a] - place[mine][which], n[b] - place[entry]) - 1
            fits = (n[b] >= n[a]) & (b != a) & (DEN * n[a] >= NUM * n[b]) & ((NUM + DEN) * most >= NUM * (n[a] + n[b]))
            others = ids[np.unique(b[fits])]
            others = others[self.roots(others) != self.find(int(ids[a]))]
            if len(others):
                self.link(int(ids[a]), others[self.links(int(ids[a]), others)[1]])

    def _window(self, ids: np.ndarray, d: np.ndarray, radius: float) -> np.ndarray:
        """Drop what can't link to another component: no member of another one within the radius in distance to the pivot."""
        if len(ids) < 2:
            return ids
        order = np.argsort(d, kind="stable")
        ids, d, r = ids[order], d[order], self.roots(ids[order])
        lo, hi = np.searchsorted(d, d - radius, "left"), np.searchsorted(d, d + radius, "right")
        change = np.concatenate([[0], np.cumsum(r[1:] != r[:-1])])
        return np.sort(ids[change[hi - 1] != change[lo]])

    def _pivots(self, ids: np.ndarray, roots: np.ndarray) -> np.ndarray:
        """Members of the smallest components: each is settled against all others in one pass."""
        _, which, sizes = np.unique(roots, return_inverse=True, return_counts=True)
        k = 1 if len(ids) < 64 else 8
        return ids[np.argsort(sizes[which], kind="stable")[:k]]


def _join_region(part: pa.Table) -> pa.Table | None:
    sids = part.column("sid").to_pylist()
    if len(sids) < 2:
        return None
    found = Region([np.frombuffer(x, np.uint64) for x in part.column("items").to_pylist()]).join()
    return pa.table([pa.array([sids[a] for a, _ in found], pa.binary()), pa.array([sids[b] for _, b in found], pa.binary())], ["u", "v"])


def _against_pivots(left, right):
    """One chunk of a large region against its pivots: links, and cells by the window rule."""
    import pandas as pd

    pivots, sets = right["sid"].tolist(), [np.frombuffer(x, np.uint64) for x in right["items"]]
    members = left[~left["sid"].isin(pivots)]
    parent = left["region"].iloc[0]
    out = []
    if len(members):
        region = Region(sets + [np.frombuffer(x, np.uint64) for x in members["items"]])
        k = len(pivots)
        ids = np.arange(k, k + len(members))
        got = [region.links(p, ids) for p in range(k)]
        dist, linked = np.stack([g[0] for g in got]), np.stack([g[1] for g in got])
        cells = _cells(dist)
        sids, n = members["sid"].tolist(), members["n"].tolist()
        for i, sid in enumerate(sids):
            out += [(None, None, pivots[p], sid, 0) for p in np.flatnonzero(linked[:, i])]
            out += [(parent, pivots[p], None, sid, n[i]) for p in np.flatnonzero(cells[:, i])]
    return pd.DataFrame(out, columns=["parent", "pivot", "u", "sid", "n"])


def _early_elements(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (region, item, sid, n, index) of the elements that stand early in a set in the order of rarity inside its region, of
    those that several members hold; index: early enough for a partner of the same size or more."""

    def unpack(batches):
        for batch in batches:
            sizes = batch.column("n").to_numpy()
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                times = np.repeat(np.arange(part.num_rows), sizes[i : i + 64])
                items = np.concatenate([np.frombuffer(x, np.int64) for x in part.column("items").to_pylist()])
                for j in range(0, len(items), 1 << 16):
                    at = pa.array(times[j : j + (1 << 16)])
                    yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in ("region", "sid", "n")), pa.array(items[j : j + (1 << 16)])], ["region", "sid", "n", "item"])

    unpacked = materialize(members.join(sets, "sid").select("region", "sid", "n", "items").mapInArrow(unpack, "region binary, sid binary, n bigint, item bigint"), "items")
    held = unpacked.groupBy("region", "item").agg(F.count("*").alias("held"))
    rows = with_groups(unpacked, held, ["region", "item"], "held")
    # each set's own elements, a bounded group; ranks count the elements that no other set holds as well
    order = Window.partitionBy("region", "sid").orderBy("held", "item")
    rows = rows.withColumn("place", F.row_number().over(order) - 1)
    whole = lambda length: F.expr(f"n - {length} + 1")
    probe, index = whole(f"((n * {NUM} + {DEN - 1}) div {DEN})"), whole(f"((n * {2 * NUM} + {NUM + DEN - 1}) div {NUM + DEN})")
    return rows.where((F.col("place") < probe) & (F.col("held") > 1)).select("region", "item", "sid", "n", (F.col("place") < index).alias("index"))


def _against_index(part: pa.Table) -> pa.Table | None:
    """Links of a task's index members with all members."""
    rows = {}
    for sid, index, items in zip(*(part.column(c).to_pylist() for c in ("sid", "index", "items")), strict=True):
        rows[sid] = (index or rows.get(sid, (False,))[0], items)
    sids, flags = list(rows), np.array([x[0] for x in rows.values()])
    if len(sids) < 2 or not flags.any():
        return None
    region = Region([np.frombuffer(x[1], np.uint64) for x in rows.values()])
    for a in np.flatnonzero(flags).tolist():
        # sizes alone rule out many
        others = np.flatnonzero((DEN * region.n >= NUM * region.n[a]) & (DEN * region.n[a] >= NUM * region.n))
        others = others[region.roots(others) != region.find(a)]
        region.link(a, others[region.links(a, others)[1]])
    found = region.found
    return pa.table([pa.array([sids[a] for a, _ in found], pa.binary()), pa.array([sids[b] for _, b in found], pa.binary())], ["u", "v"])


def _by_rare_elements(members: DataFrame, sets: DataFrame, cap: float) -> DataFrame:
    """Links of regions that neither windows nor pivots take apart: groups of sets that share an early element, in which those that
    hold it as index elements are compared with all; chunk by chunk of both where a group is large."""
    early = materialize(_early_elements(members, sets), "early")
    pivot = early.groupBy("region", "item").agg(F.min(F.when(F.col("index"), F.col("sid"))).alias("pivot"), F.count("*").alias("k")).where("pivot IS NOT NULL AND k > 1")
    rows = with_groups(early, pivot, ["region", "item"], "k")
    rows = rows.groupBy(F.md5(F.concat("region", "pivot")).alias("group"), "sid").agg(F.max("index").alias("index"), F.max("n").alias("n"))
    rows = materialize(rows, "rare")
    size = rows.groupBy("group").agg(F.ceil(F.sum("n") / (cap / 4)).cast("int").alias("chunks"), F.ceil(F.sum(F.when(F.col("index"), F.col("n"))) / (cap / 4)).cast("int").alias("index_chunks"))
    rows = rows.join(size, "group").withColumn("c", F.pmod(F.xxhash64("sid"), "chunks")).withColumn("i", F.pmod(F.xxhash64("sid", F.lit(1)), "index_chunks"))
    all_ = rows.select("group", "c", F.explode(F.expr("sequence(0, index_chunks - 1)")).alias("i"), "sid", F.lit(False).alias("index"))
    index = rows.where("index").select("group", F.explode(F.expr("sequence(0, chunks - 1)")).alias("c"), "i", "sid", F.lit(True).alias("index"))
    tasks = all_.unionByName(index).select(F.concat_ws(":", "group", "c", "i").alias("task"), "sid", "index").join(sets, "sid")
    return per_key(tasks.select("task", "sid", "index", "items"), "task", _against_index, "u binary, v binary")


def _in_blocks(members: DataFrame, sets: DataFrame, cap: float) -> DataFrame:
    """Links of regions of a few long sets, each pair of bounded blocks of a region in a task of its own."""
    blocks = members.groupBy("region").agg(F.ceil(F.sum("n") / (cap / 2)).cast("int").alias("blocks"))
    rows = members.join(blocks, "region").withColumn("block", F.pmod(F.xxhash64("sid"), "blocks").cast("int"))
    pairs = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).join(sets, "sid")
    task = F.concat_ws(":", F.hex("region"), F.least("block", "other"), F.greatest("block", "other"))
    return per_key(pairs.select(task.alias("task"), "sid", "items"), "task", _join_region, "u binary, v binary")


def region_links(members: DataFrame, sets: DataFrame, region_mb: float = REGION_MB, pivots: int = 64) -> DataFrame:
    """Links (u, v) that connect what all links inside regions connect. members: region, sid, n; sets: sid, items.

    A region beyond region_mb goes through distributed rounds (see the module's points 4 and 5). A round that parts it, or that
    leaves at most PARTED of its components, is followed by another; otherwise its rare elements finish it. So the number of
    rounds grows with the logarithm of a region's size.
    """
    done = None
    cap = region_mb * 1e6 / 8
    members = members.withColumn("weight", F.lit(0).cast("bigint")).withColumn("root", F.col("sid"))
    settled = None
    for _ in range(ROUNDS):
        size = members.groupBy("region").agg(F.sum("n").alias("items"), F.max("n").alias("longest"), F.count("*").alias("members"))
        large = materialize(size.where((F.col("items") > cap) & (F.col("members") > 1)), "large")
        small = members.join(large.select("region"), "region", "left_anti")
        found = per_key(small.join(sets, "sid").select("region", "sid", "items"), "region", _join_region, "u binary, v binary")
        links = materialize(found, "links")
        done = links if done is None else done.unionByName(links)
        if large.isEmpty():
            return done
        # few sets, which must be long ones, are compared in blocks at once
        few = F.col("members") <= 2 * pivots
        done = done.unionByName(materialize(_in_blocks(members.join(large.where(few).select("region"), "region", "left_semi"), sets, cap), "links"))
        large = large.where(~few)
        if large.isEmpty():
            return done
        # as many pivots as a task can hold beside a chunk
        most = F.greatest(F.lit(1), F.least(F.lit(pivots), F.floor(cap / 4 / F.col("longest"))))
        chunked = large.select("region", F.ceil(F.col("items") / (cap / 4)).cast("int").alias("chunks"), most.cast("int").alias("most"))
        spread = materialize(members.join(chunked, "region").withColumn("chunk", F.pmod(F.xxhash64("sid"), F.col("chunks")).cast("int")), "spread")
        # the least of each chunk first, so that no task gathers a whole region
        rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("weight", "sid"))
        first = spread.withColumn("rank_", rank("region", "chunk")).where("rank_ <= most")
        chosen = materialize(first.withColumn("rank_", rank("region")).where("rank_ <= most").select("region", "sid").join(sets, "sid"), "pivots")
        copies = chunked.select("region", F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk")).join(chosen.select("region", "sid", "items"), "region")
        out = spread.select("region", "chunk", "sid", "n").join(sets, "sid").groupBy("region", "chunk").cogroup(copies.groupBy("region", "chunk")).applyInPandas(lambda a, b: _against_pivots(a, b) if len(a) else _nothing(), "parent binary, pivot binary, u binary, sid binary, n bigint")
        out = materialize(out, "round")
        # the pivots among themselves
        among = materialize(per_key(chosen.select("region", "sid", "items"), "region", _join_region, "u binary, v binary"), "links")
        new = out.where("u IS NOT NULL").selectExpr("u", "sid AS v").unionByName(among)
        done = done.unionByName(new)
        # components so far: those of the rounds before, joined by the links of this one
        joined = new.unionByName(links)
        if settled is not None:
            joined = joined.unionByName(settled.selectExpr("sid AS u", "root AS v"))
        settled = components(joined).withColumnRenamed("node", "sid")

        cells = out.where("u IS NULL").select("parent", "pivot", "sid", "n")
        sums = cells.groupBy("parent", "pivot").agg(F.count("*").alias("c")).groupBy("parent").agg(F.max("c").alias("widest"), F.sum("c").alias("copies"))
        parted = (F.col("widest") <= PARTED * F.col("all")) & (F.col("copies") <= COPIES * F.col("all"))
        parts = cells.groupBy("parent").agg(F.count_distinct("sid").alias("all")).join(sums, "parent").select("parent", parted.alias("parted"))
        was = spread.groupBy("region").agg(F.count_distinct("root").alias("before"))
        placed = cells.join(parts, "parent").select("parent", F.when(F.col("parted"), F.unhex(F.md5(F.concat("parent", "pivot")))).otherwise(F.col("parent")).alias("region"), "parted", "sid", "n").distinct()
        placed = placed.join(settled, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        inside = placed.groupBy("parent", "parted", "region", "root").agg(F.count("*").alias("weight"))
        mixed = inside.groupBy("parent", "parted", "region").agg(F.count("*").alias("k")).where("k > 1")
        state = mixed.join(was.withColumnRenamed("region", "parent"), "parent").select("region", (F.col("parted") | (F.col("k") <= PARTED * F.col("before"))).alias("goes_on"))
        # pivots settled together with one component leave others that still have to meet the rest
        left = placed.join(state, "region").join(inside.select("region", "root", "weight"), ["region", "root"])
        left = materialize(left.select("region", "sid", "n", "weight", "root", "goes_on"), "members")
        stuck = left.where("NOT goes_on").select("region", "sid", "n")
        if not stuck.isEmpty():
            done = done.unionByName(materialize(_by_rare_elements(stuck, sets, cap), "links"))
        members = left.where("goes_on").drop("goes_on")
    return done.unionByName(materialize(_by_rare_elements(members.select("region", "sid", "n"), sets, cap), "links"))


def _nothing():
    import pandas as pd

    return pd.DataFrame({"parent": [], "pivot": [], "u": [], "sid": [], "n": []})


def _groups(docs: DataFrame, id_col: str, text_col: str, region_mb: float, tagged: bool) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, tag, n_shingles, sid) of docs, and (sid, root) of the sets; tag: digest of the text, if asked for."""
    text = F.col(text_col).cast("string")
    tag = F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)) if tagged else F.lit(None).cast("binary")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id_"), tag.alias("tag_"), text.alias("text_"))
    seen = materialize(rows.mapInArrow(_signatures("text_", "id_"), "doc_id bigint, tag binary, n_shingles bigint, sid binary, hot bigint, hot_count bigint"), "signatures")
    base = seen.where("hot IS NULL").select("doc_id", "tag", "n_shingles", "sid")
    counted = materialize(seen.where("hot IS NOT NULL").groupBy("hot").agg(F.sum("hot_count").alias("c")), "frequent")
    frequent = sorted(most_frequent(counted, "c", TABLE).collect(), key=lambda r: (-r["c"], r["hot"]))
    hot = np.array([r["hot"] for r in frequent], np.int64).astype(np.uint64)
    hot_rank = {int(x): -i for i, x in enumerate(hot.tolist())}

    total = seen.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = int(max(24, total // 4 // PER_BUCKET))
    texts = rows.select("text_")
    heads = texts.mapInArrow(_heads(hot), "sid binary, n bigint, first binary, hots binary, rest binary")
    heads = heads.groupBy("sid").agg(*(F.first(c).alias(c) for c in ("n", "first", "hots", "rest")))
    dealt = heads.mapInArrow(_deal(buckets), f"bucket int, shingles binary, owners binary, counts binary, metas {META_SQL}")
    shared = per_key(dealt, "bucket", _shared, "sid binary, shingles binary, dfs binary, meta struct<n:bigint,c:bigint,hots:binary,rest:binary>")
    head = materialize(per_key(shared, "sid", _head_of(hot_rank), "shingle bigint, sid binary"), "heads")

    pivot = head.groupBy("shingle").agg(F.min("sid").alias("region"), F.count("*").alias("k")).where("k > 1")
    members = with_groups(head, pivot, ["shingle"], "k").select("region", "sid").distinct()
    sizes = base.where("sid IS NOT NULL").groupBy("sid").agg(F.min("n_shingles").alias("n"))
    members = materialize(members.join(sizes, "sid").select("region", "sid", "n"), "members")
    asked = materialize(members.select("sid").distinct(), "asked")
    sets = texts.mapInArrow(_full_sets("text_", docs.sparkSession.sparkContext.broadcast(bloom(asked))), "sid binary, items binary")
    sets = materialize(sets.groupBy("sid").agg(F.first("items").alias("items")).join(asked, "sid", "left_semi"), "sets")
    group = components(region_links(members, sets, region_mb)).withColumnRenamed("node", "sid")
    return base, group


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", region_mb: float = REGION_MB) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (least id reachable by links, itself included)."""
    base, group = _groups(docs, id_col, text_col, region_mb, False)
    least = base.where("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows_"))
    # only sets of a component have something to learn; the others are their own
    known = materialize(least.join(group, "sid").select("sid", "root", "least"), "known")
    top = known.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("k"))
    found = with_groups(known, top, ["root"], "k").select("sid", F.col("component_id").alias("found"))
    by_sid = least.join(found, "sid", "left").select("sid", "rows_", F.coalesce("found", "least").alias("component_id"))
    own = F.coalesce("component_id", "doc_id").alias("component_id")
    worded = with_groups(base.where("sid IS NOT NULL"), by_sid, ["sid"], "rows_").select("doc_id", "n_shingles", own)
    return worded.unionByName(base.where("sid IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def redundant(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", region_mb: float = REGION_MB) -> DataFrame:
    """Marks (doc_id, sha, twin) of rows that must go for one row of each component to stay: that of least id, then digest.

    twin: the mark is of the row that stays, which the table holds more than once.
    """
    base, group = _groups(docs, id_col, text_col, region_mb, True)
    rows = materialize(base.where("sid IS NOT NULL").join(group, "sid", "left").select("doc_id", "tag", F.coalesce("root", "sid").alias("root")), "rows")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")
    stays = rows.groupBy("root").agg(F.min(key).alias("stays"), F.count("*").alias("n")).where("n > 1")
    same = F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("tag") == F.col("stays.tag"))
    marks = with_groups(rows, stays, ["root"], "n").withColumnRenamed("n", "n_").groupBy("doc_id", "tag").agg(F.max(same).alias("twin"), F.count("*").alias("n"))
    return marks.where("not twin or n > 1").select("doc_id", F.lower(F.hex("tag")).alias("sha"), "twin")


#: The same by a self-join on shingles and a transitive closure, for tables of test size.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
k AS (SELECT doc_id, s, len(s) AS n, CASE WHEN len(s) = 0 THEN 'empty ' || doc_id ELSE md5(array_to_string(list_sort(s), chr(10))) END AS sid FROM s),
r AS (SELECT sid, min(doc_id) AS least, any_value(s) AS s, any_value(n) AS n FROM k GROUP BY sid), e AS (SELECT sid, n, unnest(s) AS x FROM r),
l AS (SELECT a.sid AS u, b.sid AS v FROM e a JOIN e b ON a.x = b.x AND a.sid <> b.sid GROUP BY a.sid, b.sid, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
c(u, v) AS (SELECT sid, sid FROM r UNION SELECT c.u, l.v FROM c JOIN l ON c.v = l.u), m AS (SELECT c.u AS sid, min(r.least) AS component_id FROM c JOIN r ON c.v = r.sid GROUP BY c.u)
SELECT k.doc_id, k.n AS n_shingles, m.component_id FROM k JOIN m ON k.sid = m.sid
"""
