import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestone.llm import exact_dedup


def expected(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[text or ""].append(doc)
    out, done = [], set()
    for doc, text in rows:
        ids = [i for i in groups[text or ""] if i is not None]
        keep = max(ids, default=None)
        first = (doc, text or "") not in done
        done.add((doc, text or ""))
        out.append((doc, keep, len(groups[text or ""]), doc == keep and first, hashlib.sha256((text or "").encode()).hexdigest()))
    return Counter(out)


def got(df):
    return Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect())


def test_cases(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got(exact_dedup.exact_dedup(docs)) == expected(rows)


def test_empty(no_docs):
    assert exact_dedup.exact_dedup(no_docs).collect() == []


def test_history(spark):
    history = spark.createDataFrame([(100, "known"), (7, "known"), (3, "old")], "doc_id bigint, text string")
    docs = spark.createDataFrame([(1, "known"), (2, "new"), (3, "new"), (4, "alone"), (3, "old")], "doc_id bigint, text string")
    found = {(r["doc_id"], r["text_sha256"][:4]): (r["keep_id"], r["kept"]) for r in exact_dedup.exact_dedup(docs, history).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()[:4]
    assert found == {(1, sha("known")): (100, False), (2, sha("new")): (3, False), (3, sha("new")): (3, True), (4, sha("alone")): (4, True), (3, sha("old")): (3, True)}


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 20_000])
def test_perfect_hash_is_a_bijection(n):
    keys = np.random.default_rng(n).integers(0, 2**64, (n, 4), np.uint64)
    assert sorted(exact_dedup.PerfectHash.build(keys).slot_of(keys).tolist()) == list(range(n))


def test_hot_text_is_salted(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SALT_ROWS", 50)
    rows = [(i, "hot") for i in range(700)] + [(1000 + i, f"t{i % 200}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(exact_dedup.exact_dedup(df)) == expected(rows)


def test_without_keeps_clashing_columns(docs):
    out = exact_dedup.without(docs, exact_dedup.redundant(docs))
    assert out.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = Counter(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in out.collect())
    assert set(kept.values()) == {1} and len(kept) == len({t or "" for _, t in rows})


def test_winners_come_from_both_sides_and_nonmembers_group(spark):
    """History holds the lower ids: one text wins there, one in the increment, and the increment has repeats of its own."""
    rows = [(1, "a"), (2, "b"), (3, "c"), (4, "c"), (100, "b"), (101, "d"), (102, "d"), (103, "e"), (None, "a"), (None, "n"), (None, "n"), (100, "b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(exact_dedup.exact_dedup(df)) == expected_with_nulls(rows)


def expected_with_nulls(rows):
    out, done = [], set()
    for doc, text in rows:
        same = [d for d, t in rows if t == text]
        keep = max((d for d in same if d is not None), default=None)
        out.append((doc, keep, len(same), doc == keep and (doc, text) not in done, hashlib.sha256(text.encode()).hexdigest()))
        done.add((doc, text))
    return Counter(out)


def test_null_ids_en_masse_are_spread(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "REPEATS", 40)
    rows = [(None, "hot")] * 333 + [(7, "hot")] * 100 + [(i, f"t{i}") for i in range(200)] + [(None, None)] * 41
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(exact_dedup.exact_dedup(df)) == expected_with_nulls([(d, t or "") for d, t in rows])


def test_index_is_an_artefact(spark, tmp_path):
    texts = lambda names: spark.createDataFrame([(hashlib.sha256(n.encode()).digest(), w, s) for n, w, s in names], exact_dedup.GROUPS)
    old = [(f"h{i}", i, 1 + i % 3) for i in range(500)]
    index = exact_dedup.build_index(texts(old), 8)
    exact_dedup.save(index, str(tmp_path / "index"))
    index = exact_dedup.load(spark, str(tmp_path / "index"))
    assert exact_dedup.shards_of(index) == 8
    new = [("h3", 900, 2), ("h4", 1, 5), ("x1", 5, 1), ("x2", None, 2)]
    index = exact_dedup.absorb(index, texts(new), 8)
    want = {n: (w, s) for n, w, s in old} | {"h3": (900, 3), "h4": (4, 7), "x1": (5, 1), "x2": (None, 2), "gone": (None, None)}
    names = {hashlib.sha256(n.encode()).digest(): n for n in want}
    rows = spark.createDataFrame([(1, d, 1) for d in names], "doc_id bigint, digest binary, n bigint")
    assert {names[bytes(r["digest"])]: (r["winner"], r["size"]) for r in exact_dedup.lookup(rows, index, 8).collect()} == want


def test_least_id_is_an_id(spark):
    least = -(2**63)
    rows = [(least, "alone"), (least, "twice"), (5, "twice"), (None, "nameless"), (None, "nameless"), (None, "both"), (least, "both")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(df).collect())
    assert out == Counter([(least, least, 1, True), (least, 5, 2, False), (5, 5, 2, True), (None, None, 2, True), (None, None, 2, False), (None, least, 2, False), (least, least, 2, True)])
    kept = exact_dedup.without(df, exact_dedup.redundant(df)).collect()
    assert Counter(map(tuple, kept)) == Counter([(least, "alone"), (5, "twice"), (None, "nameless"), (least, "both")])
    history = spark.createDataFrame([(least, "alone"), (None, "nameless")], "doc_id bigint, text string")
    got = {(r["doc_id"], r["keep_id"], r["kept"]) for r in exact_dedup.exact_dedup(df.where("text IN ('alone', 'nameless')"), history).collect()}
    assert (least, least, True) in got and (None, None, True) in got
