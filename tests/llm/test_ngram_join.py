import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import common, exact_dedup, ngram_join
from lodestone.llm import shingles as hashing
from lodestone.llm.shingles import BLOCK, shingle_sets


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def expected(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return Counter((doc, len(sets[i]), least.get(find(i), doc)) for i, (doc, _) in enumerate(rows))


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 120))] for _ in range(n // 5)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words + rng.choice([[], ["tail"], ["license"] * 6]))))
    return rows


def got(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


def test_cases(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got(ngram_join.ngram_components(docs)) == expected(rows)


def test_empty(no_docs):
    assert ngram_join.ngram_components(no_docs).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_random_against_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(ngram_join.ngram_components(df)) == expected(rows)


def test_large_regions_are_split(spark):
    """With a region size of a few sets, the distributed rounds must find the same components."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(300):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(80)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(ngram_join.ngram_components(df, region_mb=0.01)) == expected(rows)


@pytest.mark.parametrize("seed", range(6))
def test_region_join_finds_all_components(seed):
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(12):
        core = rng.choice(10_000, 40, replace=False)
        for _ in range(rng.integers(1, 60)):
            s = core.copy()
            k = rng.integers(0, 12)
            s[rng.choice(40, k, replace=False)] = rng.integers(10_000, 20_000, k)
            sets.append(np.unique(s).astype(np.uint64))
    region = ngram_join.Region(sets)
    region.join()
    roots = [region.find(i) for i in range(len(sets))]
    plain = [frozenset(s.tolist()) for s in sets]
    for i, a in enumerate(plain):
        for j in range(i):
            if 5 * len(a & plain[j]) >= 4 * len(a | plain[j]):
                assert roots[i] == roots[j]
    assert len(set(roots)) > 1


def template_rows(n, seed=3, words=200, changed=7, copies=8):
    """Pages of one template at a similarity of about 0.7 to each other, and here and there a near copy of one."""
    rng = random.Random(seed)
    base = [f"t{i}" for i in range(words)]
    rows = []
    for i in range(n):
        page = list(base)
        for at in rng.sample(range(words), changed):
            page[at] = f"own{i}x{at}"
        rows.append((len(rows), " ".join(page)))
        if i % copies == 0:
            page[rng.randrange(words)] = "other"
            rows.append((len(rows), " ".join(page)))
    return rows


def expected_by_bits(rows):
    """Like expected, with sets as bits of whole numbers."""
    number, bits, sizes = {}, [], []
    for _, t in rows:
        s = shingles(t)
        bits.append(sum(1 << number.setdefault(x, len(number)) for x in s))
        sizes.append(len(s))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = (bits[i] & bits[j]).bit_count()
            if both and 5 * both >= 4 * (sizes[i] + sizes[j] - both) and (a := find(i)) != (b := find(j)):
                root[max(a, b)] = min(a, b)
    return Counter((rows[i][0], sizes[i], rows[find(i)][0]) for i in range(len(rows)))


@pytest.mark.parametrize("region_mb", [48, 0.05])
def test_templates_just_beyond_the_threshold(spark, monkeypatch, region_mb):
    """Neither windows nor pivots part such a region; rounds must stay few all the same."""
    rounds = []
    monkeypatch.setattr(ngram_join, "materialize", lambda df, name: (rounds.append(name), common.materialize(df, name))[1])
    rows = template_rows(400)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(ngram_join.ngram_components(df, region_mb=region_mb)) == expected_by_bits(rows)
    assert rounds.count("round") <= (0 if region_mb == 48 else 3)


@pytest.mark.parametrize("seed", range(4))
def test_prefix_join_finds_all_components(seed):
    rng = np.random.default_rng(seed)
    core = rng.choice(10_000, 90, replace=False)
    sets = []
    for _ in range(300):
        s = core[: rng.integers(70, 91)].copy()
        k = rng.integers(0, 22)
        s[rng.choice(len(s), k, replace=False)] = rng.integers(10_000, 10_300, k)
        sets.append(np.unique(s).astype(np.uint64))
    region = ngram_join.Region(sets)
    region._by_prefix(np.arange(len(sets)))
    roots = region.roots(np.arange(len(sets)))
    plain = [frozenset(s.tolist()) for s in sets]
    linked = [(i, j) for i, a in enumerate(plain) for j in range(i) if 5 * len(a & plain[j]) >= 4 * len(a | plain[j])]
    assert linked and all(roots[i] == roots[j] for i, j in linked)
    assert all(5 * len(plain[a] & plain[b]) >= 4 * len(plain[a] | plain[b]) for a, b in region.found)


def test_rare_elements_and_blocks_keep_every_link(spark):
    rng = np.random.default_rng(8)
    core = rng.choice(10_000, 60, replace=False)
    sets = {}
    for i in range(120):
        s = core.copy()
        k = rng.integers(0, 14)
        s[rng.choice(60, k, replace=False)] = rng.integers(10_000, 10_200, k)
        sets[i.to_bytes(16, "big")] = np.unique(s).astype(np.uint64)
    frame = spark.createDataFrame([(k, v.tobytes()) for k, v in sets.items()], "sid binary, items binary")
    members = spark.createDataFrame([(b"r", k, len(v)) for k, v in sets.items()], "region binary, sid binary, n bigint")
    plain = {k: frozenset(v.tolist()) for k, v in sets.items()}
    linked = [(a, b) for a in plain for b in plain if a < b and 5 * len(plain[a] & plain[b]) >= 4 * len(plain[a] | plain[b])]
    for join in (ngram_join._by_rare_elements, ngram_join._in_blocks):
        root = {k: k for k in plain}

        def find(k):
            while root[k] != k:
                k = root[k]
            return k

        found = [(bytes(r["u"]), bytes(r["v"])) for r in join(members, frame, 1000.0).collect()]
        for u, v in found:
            assert 5 * len(plain[u] & plain[v]) >= 4 * len(plain[u] | plain[v])
            root[find(u)] = find(v)
        assert linked and all(find(a) == find(b) for a, b in linked)


def test_one_shingle_in_very_many_sets(spark):
    """A phrase that all documents share is one key of every join by shingle."""
    rng = random.Random(2)
    rows = [(i, "the same five words here " + " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randint(0, 3)))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(ngram_join.ngram_components(df)) == expected_by_bits(rows)


def test_dealing_visits_only_present_buckets():
    sids = [bytes([i]) * 16 for i in range(20)]
    first = np.sort(np.random.default_rng(1).integers(0, 1 << 62, 200, np.uint64))
    batch = pa.RecordBatch.from_arrays([pa.array(sids, pa.binary()), pa.array([200] * 20), *(pa.array([x] * 20, pa.binary()) for x in (first.tobytes(), b"", b""))], ["sid", "n", "first", "hots", "rest"])
    out = next(iter(ngram_join._deal(3_000_000)([batch])))
    assert sum(len(m) for m in out.column("metas").to_pylist()) == 20
    assert sum(len(x) for x in out.column("shingles").to_pylist()) == 200 * 8 * 20


def test_shingles_of_blocks_and_slices():
    texts = ["a b c d e f", None, "", "word " * (BLOCK // 3), "z" * (2 * BLOCK) + " tail one two three four", " x"]
    array = pa.array(["skip", *texts])[1:]
    assert [len(s) for s in shingle_sets(array)] == [len(shingles(t)) for t in texts]


def test_redundant_keeps_one_of_each_component(docs):
    out = exact_dedup.without(docs, ngram_join.redundant(docs))
    rows = out.collect()
    assert out.columns == docs.columns
    kept = Counter(r["doc_id"] for r in rows)
    # one row of the near copies of 1, of far and its capitals, and of the two-word texts; texts without words all stay
    assert kept[1] == 1 and kept[2] == kept[3] == kept[13] == kept[9] == 0 and kept[8] == 1
    assert sum(r["text"] is None or not r["text"].strip() for r in rows) == 4


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", [64, 1024, 2048, 4096, 65536])
def test_patterned_words_stay_apart(n):
    word = thue_morse(n)
    other = word.translate(str.maketrans("ab", "ba"))
    sets = list(hashing.shingle_sets(pa.array([word, other, word.upper(), f"x {word} y z w", f"x {other} y z w"])))
    assert (sets[0] != sets[1]).all() and (sets[0] == sets[2]).all() and (sets[3] != sets[4]).all()


def test_long_words_hash_alike_at_any_place():
    word = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(3_000_000))
    tail = " one two three four five six"
    for before in (0, 1, 17, hashing.BLOCK - 1, hashing.BLOCK, hashing.BLOCK + 5):
        sets = list(hashing.shingle_sets(pa.array([" " * before + word, "\t" + word + " " * before, " " * before + word + tail, word + tail, " " * before + word[:-1] + "A"])))
        assert (sets[0] == sets[1]).all() and len(sets[0]) == 1
        assert len(sets[2]) == 3 and (sets[2] == sets[3]).all()
        assert sets[4][0] != sets[0][0]


def test_words_across_blocks_equal_words_within(monkeypatch):
    rng = np.random.default_rng(8)
    text = "".join(rng.choice(list("abC \n"), p=[0.35, 0.3, 0.2, 0.1, 0.05]) for _ in range(4000))
    want = list(hashing.shingle_sets(pa.array([text])))[0]
    for block in (1, 2, 3, 7, 64, 1000):
        monkeypatch.setattr(hashing, "BLOCK", block)
        assert (list(hashing.shingle_sets(pa.array([text])))[0] == want).all()
