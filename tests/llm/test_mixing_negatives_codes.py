import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestone.llm import hard_negatives, mixing, vector_codes

VECTORS = "vec_id bigint, embedding array<float>, label int, row int, id string, q int"
DOCS = "doc_id bigint, text string, source string, size int, target string, key int"


def awkward(rows, width=16):
    """rows and every case that an operator over vectors must bear."""
    v = rows[0][1]
    extra = [(900, None, 1), (1000, [], 1), (901, [float("nan")] * width, 1), (1100, [None] * width, 1), (902, [float("inf")] + [0.0] * (width - 1), 1), (1200, v, None), (None, v, rows[0][2]),
             (rows[3][0], rows[3][1], rows[3][2]), (rows[0][0], rows[0][1], rows[0][2]), (903, [1.0, 2.0], 1), (1300, [3.0, -2.0], 1), (1400, [1e30] * width, 1), (904, [0.0] * width, 1)]
    return [(*r, 1, "x", 2) for r in [*rows, *extra]]


def clustered(seed, n=300, width=16):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(9, width))
    out = []
    for i in range(n):
        v = centers[rng.integers(9)] + rng.normal(size=width) * rng.choice([0, 0.05, 0.4])
        out.append((i * 5, np.round(v, 2).astype(np.float32).tolist(), int(rng.integers(4))))
    return out


def takes_part(v, scale, reach):
    if not v or None in v or not np.isfinite(v).all():
        return None
    q = [math.floor(scale * float(x)) for x in v]
    return q if math.sqrt(sum(x * x for x in q)) <= reach else None


# hard negatives


def mined(rows):
    kept = [(i, label, q) for i, v, label, *_ in rows if i is not None and label is not None and (q := takes_part(v, 256, hard_negatives.REACH))]
    score = lambda a, b: sum(x * y for x, y in zip(a[2], b[2], strict=True))
    out = []
    for a in (r for r in kept if r[0] % 100 == 0):
        others = sorted(((-score(a, b), b[0], b[1]) for b in kept if b is not a and len(b[2]) == len(a[2])))
        for ps, pid, _ in [o for o in others if o[2] == a[1]][:5]:
            fits = [o for o in others if o[2] != a[1] and 80 * -ps <= 100 * -o[0] <= 100 * -ps][:5]
            out += [(a[0], pid, rank, nid, -ps, -ns) for rank, (ns, nid, _) in enumerate(fits, 1)]
    return Counter(out)


@pytest.mark.parametrize("seed,sizes", [(1, {}), (2, {"group": 2, "block": 2, "slice_rows": 40}), (3, {"group": 3, "block": 100, "slice_rows": 1000})])
def test_hard_negatives_against_brute_force(spark, seed, sizes):
    rows = awkward(clustered(seed))
    out = hard_negatives.mine(spark.createDataFrame(rows, VECTORS), **sizes)
    assert Counter(tuple(r) for r in out.collect()) == mined(rows)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_hard_negatives_of_copies_and_ties(spark):
    base = [0.5, 0.25, -0.5, 1.0]
    rows = [(i, base, i % 3, 0, "", 0) for i in range(400)] + [(1000 + i, [x * (1 - i / 500) for x in base], i % 3, 0, "", 0) for i in range(100)]
    rows = [(i, [float(np.float32(x)) for x in v], *rest) for i, v, *rest in rows]
    out = hard_negatives.mine(spark.createDataFrame(rows, VECTORS), group=2, block=3, slice_rows=50)
    assert Counter(tuple(r) for r in out.collect()) == mined(rows)


def test_hard_negatives_without_rows_or_anchors(spark):
    assert hard_negatives.mine(spark.createDataFrame([], VECTORS)).collect() == []
    assert hard_negatives.mine(spark.createDataFrame([(1, [1.0], 1, 0, "", 0)], VECTORS)).collect() == []


def test_large_numbers_are_exact(spark):
    a, b = np.array([[2.0**26, 1.0]]), np.array([[2.0**26, 1.0], [2.0**26, 2.0]])
    assert hard_negatives._products(a, b).tolist() == [[2**52 + 1, 2**52 + 2]]


def test_bounds_never_lose_a_row():
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(5, 6))
    anchors, rows = np.floor((centers[np.arange(40) % 5] + rng.normal(size=(40, 6)) * 0.1) * 50), np.floor(rng.normal(size=(300, 6)) * 80)
    groups = hard_negatives.Groups(anchors[:5], float((rows**2).sum(1).max()))
    d = groups.distances(anchors, False)
    cell = d.argmin(1)
    scores = anchors @ rows.T
    for c in range(5):
        mine = np.flatnonzero(cell == c)
        groups.blocks[c], groups.radius[c] = 1, d[mine, c].max()
        groups.most[c], groups.least[c] = (anchors[mine] ** 2).sum(1).max(), (anchors[mine] ** 2).sum(1).min()
        groups.low[c], groups.high[c] = 9000, 12000
    served = groups.served(rows)
    for c in range(5):
        wanted = ((scores[cell == c] >= 9000) & (scores[cell == c] <= 12000)).any(0)
        assert not (wanted & ~served[:, c]).any()
    assert served.mean() < 0.7


# vector codes


def coded(rows):
    kept = sorted(((i is None, i or 0, q, label) for i, v, label, *_ in rows if (q := takes_part(v, 4096, 2**28)) and len(q) == 16), key=lambda r: (r[0], r[1], np.array(r[2], "<i8").tobytes().hex()))
    books = [[r[2][2 * p : 2 * p + 2] for r in kept[:16]] for p in range(8)]
    nearest = lambda p, q: min((sum((x - y) ** 2 for x, y in zip(q[2 * p : 2 * p + 2], e, strict=True)), k) for k, e in enumerate(books[p]))
    for _ in range(6):
        new = []
        for p in range(8):
            of = defaultdict(list)
            for r in kept:
                of[nearest(p, r[2])[1]].append(r[2][2 * p : 2 * p + 2])
            new.append([[sum(x) // len(of[k]) for x in zip(*of[k], strict=True)] if of[k] else e for k, e in enumerate(books[p])])
        books = new
    out = [(i if not none else None, label, [nearest(p, q) for p in range(8)]) for none, i, q, label in kept]
    by_label = Counter()
    for _, label, found in out:
        by_label[label] += sum(d for d, _ in found)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), by_label[label], digest) for i, label, f in out), books


@pytest.mark.parametrize("n", [300, 7])
def test_vector_codes_against_brute_force(spark, n):
    rows = awkward(clustered(n, n))
    out = vector_codes.compress(spark.createDataFrame(rows, VECTORS))
    want, books = coded(rows)
    assert Counter(tuple(r)[:5] for r in out.collect()) == want
    near = vector_codes.decode(out.where("vec_id = 5"), [np.array(b) for b in books]).first()
    assert near["approximation"] == [x / 4096 for p in range(8) for x in books[p][int(near["code"][2 * p : 2 * p + 2], 16)]]


def test_vector_codes_without_rows(spark):
    assert vector_codes.compress(spark.createDataFrame([], VECTORS)).collect() == []
    assert vector_codes.compress(spark.createDataFrame([(1, [1.0, 2.0], 1, 0, "", 0), (2, None, 1, 0, "", 0)], VECTORS)).collect() == []


def test_annulus_finds_the_nearest_and_prunes():
    rng = np.random.default_rng(3)
    entries = np.floor(rng.normal(size=(16, 8)) * rng.uniform(10, 4000, size=(16, 1))).astype(np.int64)
    entries[5] = entries[2]  # a tie
    points = np.concatenate([entries, -entries, np.floor(rng.normal(size=(4000, 8)) * rng.uniform(10, 4000, size=(4000, 1))).astype(np.int64)])
    book = vector_codes.Codebook(entries)
    code, d = book.nearest(points)
    every = ((points[:, None] - entries[None]) ** 2).sum(2)
    assert (code == every.argmin(1)).all() and (d == every.min(1)).all()
    assert book.evaluated < 0.75 * every.size


# mixing


def mixture_rows(n=900, seed=4):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        source = ["a", "b", "\U00010000", "ﬀ", None, "hot", "hot", "hot"][rng.integers(8)]
        rows.append((i, " ".join(["w"] * int(rng.lognormal(3, 1.2))), source))
    rows += [(None, "one two", "a"), (None, "one two", "a"), (7, rows[7][1], rows[7][2]), (2000, None, "a"), (2001, "", "b"), (2002, " \t\n\x0b ", "a"), (2003, None, "empty"), (2004, "tiny", "small"), (2005, "a\x0bb\x0cc\xa0d", "a"), (2006, "x " * 60_000, "b")]
    return [(*r, 1, "x", 2) for r in rows]


def expected_targets(rows, most=3):
    sizes = Counter()
    for _, text, source, *_ in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(most * sizes[s] for s in capped)) / sum(weight[s] for s in free)
        more = {s for s in free if level * weight[s] > most * sizes[s]}
        if not more:
            return sizes, {s: float(most * sizes[s]) if s in capped else level * weight[s] for s in order}
        capped |= more


@pytest.mark.parametrize("chunk", [128, 4])
def test_mixing_meets_targets(spark, chunk):
    rows = mixture_rows()
    out = mixing.mix(spark.createDataFrame(rows, DOCS), chunk=chunk).collect()
    sizes, targets = expected_targets(rows)
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in out) == Counter((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for i, t, s, *_ in rows)
    taken, largest = Counter(), Counter()
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], targets[r["source"]], rel_tol=1e-9)
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3 and (r["size"] > 0 or r["taken"] == 0)
        share = min(3, r["target"] / r["source_size"]) if r["size"] else 0
        assert r["copies"] in (math.floor(share), math.ceil(share))
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= largest[s] / 2 + 1e-6
        if s == "hot":
            assert abs(taken[s] - targets[s]) < 0.02 * targets[s]


def test_mixing_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame(mixture_rows(), DOCS)
    assert Counter(map(tuple, mixing.mix(df).collect())) == Counter(map(tuple, mixing.mix(df.repartition(7, "text").sortWithinPartitions("size")).collect()))


def test_mixing_keeps_expected_copies(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), "ab"[i % 2], 0, "", 0) for i in range(300)]
    df = spark.createDataFrame(rows, DOCS)
    copies, share, runs = Counter(), {}, 6
    for seed in range(runs):
        for r in mixing.mix(df, seed=seed, chunk=8).collect():
            copies[r["doc_id"]] += r["copies"]
            share[r["doc_id"]] = r["target"] / r["source_size"]
    z = [(copies[i] / runs - share[i]) / math.sqrt(max(share[i] % 1 * (1 - share[i] % 1), 1e-9) / runs) for i in share]
    assert abs(np.mean(z)) < 0.3 and 0.7 < np.std(z) < 1.3


def test_mixing_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).collect() == []
    blank = mixing.mix(spark.createDataFrame([(1, None, None, 0, "", 0), (2, " ", "a", 0, "", 0)], DOCS)).collect()
    assert sorted((r["doc_id"], r["size"], r["target"], r["taken"]) for r in blank) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_mixture_repeats_rows(spark):
    df = spark.createDataFrame([(i, "a b c", "xy"[i % 2], 0, "", 0) for i in range(40)], DOCS)
    mixed = mixing.mix(df)
    want = {r["doc_id"]: r["copies"] for r in mixed.collect() if r["copies"]}
    assert Counter(r["doc_id"] for r in mixing.repeated(df, mixed).collect()) == Counter(want)
