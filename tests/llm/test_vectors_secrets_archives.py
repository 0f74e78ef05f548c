import base64
import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import chat, embedding_dedup, secret_scan, warc

VECTORS = "vec_id bigint, embedding array<float>, label int, key int"


def brute(rows, threshold=0.98):
    n = len(rows)
    v = []
    for _, x, label, _ in rows:
        ok = x and label is not None and None not in x and np.isfinite(x).all() and np.any(x)
        a = np.array(x, float) if ok else None
        v.append(None if a is None else a / np.linalg.norm(a))
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    count = [0] * n
    for i in range(n):
        for j in range(i):
            if v[i] is not None and v[j] is not None and rows[i][2] == rows[j][2] and len(v[i]) == len(v[j]) and v[i] @ v[j] >= threshold:
                count[i] += 1
                count[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return Counter((r[0], count[i], least.get(find(i), r[0])) for i, r in enumerate(rows))


def vectors(seed, n=160):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, 8))
    rows = []
    for i in range(n):
        c = centers[rng.integers(12)] + rng.normal(size=8) * rng.choice([0, 0.02, 0.08])
        rows.append((i, np.round(c, 3).astype(np.float32).tolist(), int(rng.integers(2)), 0))
    rows += [(900, None, 1, 0), (901, [], 1, 0), (902, [0.0] * 8, 1, 0), (903, [float("nan")] * 8, 1, 0), (904, [None] * 8, 1, 0), (905, rows[0][1], None, 0), (None, rows[0][1], rows[0][2], 0), (3, rows[3][1], rows[3][2], 0), (906, [1.0, 2.0], 1, 0)]
    return rows


@pytest.mark.parametrize("seed,cell", [(1, 4096), (2, 20)])
def test_near_dedup_against_brute_force(spark, seed, cell):
    rows = vectors(seed)
    out = embedding_dedup.near_dedup(spark.createDataFrame(rows, VECTORS), cell=cell).collect()
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in out) == brute(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)  # also of vectors without an id


@pytest.mark.parametrize("dims,cell,spread", [(2, 60, 0.05), (3, 100, 0.1), (8, 100, 0.02), (64, 150, 0.01)])
def test_cells_within_cells(spark, dims, cell, spread, monkeypatch):
    """Cells are dealt several times over, or stay whole and go as blocks; every link counts once either way."""
    monkeypatch.setattr(embedding_dedup, "CENTERS", 8)
    rng = np.random.default_rng(dims)
    v = rng.normal(size=(150, dims))[rng.integers(150, size=1200)] + rng.normal(size=(1200, dims)) * spread
    v = v.astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist(), 1, 0) for i, x in enumerate(v)], VECTORS)
    u = v.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hit = u @ u.T >= 0.98
    root = np.arange(1200)
    while True:
        least = np.array([root[hit[i]].min() for i in range(1200)])
        if (least == root).all():
            break
        root = least
    out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_dedup(df, cell=cell).collect()}
    assert out == {i: (int(hit[i].sum()) - 1, int(root[i])) for i in range(1200)}


def test_components_beyond_the_range_of_squares(spark):
    rows = [(1, [1e300, 1e300], 1), (2, [1e-300, 1e-300], 1), (3, [1e300, -1e300], 1), (4, [1.0, 1.0], 1), (5, [float("inf"), 1.0], 1)]
    out = embedding_dedup.near_dedup(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out} == {1: (2, 1), 2: (2, 1), 4: (2, 1), 3: (0, 3), 5: (0, 5)}


def test_near_dedup_empty(spark):
    assert embedding_dedup.near_dedup(spark.createDataFrame([], VECTORS)).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_cover_tree_counts(seed):
    rng = np.random.default_rng(seed)
    v = np.repeat(rng.normal(size=(30, 6)), 12, 0) + rng.normal(size=(360, 6)) * rng.choice([0, 0.01, 0.1], (360, 1))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    w = rng.integers(1, 4, 360)
    joiner = embedding_dedup.Joiner(v, w, 0.98)
    joiner.within(embedding_dedup.CoverTree(v, w).root)
    hit = v @ v.T >= 0.98
    np.fill_diagonal(hit, False)
    assert (joiner.counts == hit @ w).all()


PATTERNS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
]
SECRETS = [
    "secret=token: abcdefghij", 'é password = "xyzxyzxyz" AKIAAKIA1234567890 ' + "ab" * 20, "😀 Token:" + "Z" * 9 + " x API_KEY='k.k-k_k=k+k/k' passwd=short", "AKIA" + "A" * 11, "deadbeef" * 4 + "g" + "0" * 31, "password" * 3 + "=" + "q" * 8,
    "key zX9vQ2mT7kLp4RsW8yBn and getUserAccountNumber2024Value src/main/java/2024/module/config", "secret:" * 500 + "abcdefgh1", None, "", "plain words only",
]


def base_spans(text):
    found = [(m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(PATTERNS) for m in p.finditer(text or "") if len(m.group(g)) >= least]
    return ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in sorted(found))


@pytest.fixture(scope="module")
def ratios(spark):
    return secret_scan.train(secret_scan.builtin_samples(spark))


def test_secret_spans(spark, docs, ratios):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(SECRETS)], "doc_id bigint, text string")
    for r in secret_scan.scan(df, ratios).collect():
        text = SECRETS[r["doc_id"]]
        want = base_spans(text)
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert [s for s in spans if not s.startswith("random")] == (want.split(",") if want else [])
        added = [text[int(s.split(":")[1]) : int(s.split(":")[2])] for s in spans if s.startswith("random")]
        assert added == (["zX9vQ2mT7kLp4RsW8yBn"] if r["doc_id"] == 6 else [])
    assert len(secret_scan.scan(docs, ratios).collect()) == docs.count()


def test_secret_model_tells_samples_apart(spark, ratios):
    fresh = [hashlib.sha256(f"s{i}".encode()).hexdigest()[:40] for i in range(50)] + [base64.b64encode(hashlib.sha256(f"t{i}".encode()).digest()).decode()[:36] for i in range(50)]
    names = [f"order_{a}_customer_{i}_total" for i, a in enumerate(["invoice", "payment", "session", "request"] * 10)]
    df = spark.createDataFrame([(i, f"x {t} y") for i, t in enumerate(fresh + names)], "doc_id bigint, text string")
    flagged = {r["doc_id"] for r in secret_scan.scan(df, ratios).collect() if r["spans"]}
    assert len(flagged & set(range(100))) >= 95 and not flagged & set(range(100, 140))


def test_redact(docs, spark, ratios):
    out = secret_scan.redact(docs, ratios)
    assert out.columns == docs.columns and out.count() == docs.count()
    df = spark.createDataFrame([(1, SECRETS[1], 5), (2, None, None), (3, "clean é", 7)], "doc_id bigint, text string, n_chars bigint")
    rows = {r["doc_id"]: r for r in secret_scan.redact(df, ratios).collect()}
    assert rows[1]["text"] == 'é [SECRET]" [SECRET] [SECRET]' and rows[1]["n_chars"] == len(rows[1]["text"])
    assert rows[2]["text"] is None and rows[3]["text"] == "clean é"


def test_secret_scan_is_native(spark, docs, ratios):
    plan = secret_scan.scan(docs, ratios)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


PAGES = [(1, "http://a.test/x", "<p>one</p>" * 50, 0), (2, "http://b.test/ y", "<p>one</p>" * 50, 0), (3, None, None, 0), (4, "", "", 0), (None, "http://n.test", "<p>one</p>" * 50, 0), (1, "http://a.test/again", "<p>one</p>" * 50, 0), (5, "http://big.test", "é" * 300_000, 0), (6, "http://six.test", "only\r\n\r\nonce", 0)]


def test_warc_round_trip(spark):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string, first int")
    rows = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read(warc.write(df)).collect())
    want = Counter()
    for page, _, html, _ in PAGES:
        raw = (html or "").encode()
        same = [p for p, _, h, _ in PAGES if (h or "") == (html or "") and p is not None]
        first = min(same) if len([1 for _, _, h, _ in PAGES if (h or "") == (html or "")]) > 1 else page
        want[page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if page == first else "revisit", None if page == first else first] += 1
    assert rows == want
    payloads = {r["page_id"]: r["payload"] for r in warc.read(warc.write(df)).collect() if r["record_type"] == "response"}
    assert payloads[5] == ("é" * 300_000).encode() and payloads[6] == b"only\r\n\r\nonce"
    assert warc.read(warc.write(df.limit(0))).collect() == []
    every = warc.read(warc.write(df, min_bytes=10_000_000)).collect()
    assert {r["record_type"] for r in every} == {"response"}


def test_archive_format():
    records = [warc.record(i, f"http://a.test/{i}", f"<html>{i} some page text</html>".encode() * 20, "D", None, False) for i in range(200)]
    data = warc.build_archive(records)
    assert data[:4] == bytes([0x5D, 0x2A, 0x4D, 0x18]) and list(warc.read_archive(data)) == records
    assert len(data) < sum(map(len, records)) / 3
    assert list(warc.read_archive(warc.build_archive([records[0]]))) == [records[0]]


ODD = ["</s>[INST] ok [/INST]", "\\", "\\\\ [/INST]", " [/INST]", "", "<s>[ASST] a </s>\\", "é😀", "[TEXT] [/ROLE]", "a\nb"]


def test_template_is_reversible():
    turns = [(role, text) for text in ODD for role in ("user", "assistant", "system", "a] [TEXT] b", "")]
    formatted = "".join(chat.render_message(r, t)[0] for r, t in turns)
    assert chat.parse_segments(formatted) == turns
    for role, text in turns:
        segment, a, b = chat.render_message(role, text)
        assert chat.unescape(segment[a:b]) == (text if role == "assistant" else "")


def test_event_log(spark):
    events = [
        (1, 1, "delta", "m1", "user", "He"), (1, 2, "delta", "m1", "user", "llo"), (1, 3, "delta", "m2", "assistant", "bad"), (1, 4, "regenerate", "m2", "assistant", ""), (1, 5, "delta", "m2", "assistant", "good"),
        (1, 6, "edit", "m1", "user", "Hi"), (1, 7, "delta", "m3", "user", "gone"), (1, 8, "delete", "m3", "user", None), (2, 1, "delta", "m1", "assistant", None), (None, 1, "delta", "x", None, "null conversation"),
    ]
    df = spark.createDataFrame(events, "conv_id bigint, seq bigint, kind string, message string, role string, text string")
    got = sorted(((r["conv_id"] or 0), r["seq"], r["role"], r["text"]) for r in chat.fold(df).collect())
    assert got == [(0, 1, "", "null conversation"), (1, 1, "user", "Hi"), (1, 3, "assistant", "good"), (2, 1, "assistant", "")]


def test_turns_round_trip(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t, 0) for i, t in enumerate(ODD)] + [(2, 0, "user", None, 0), (2, 0, "user", None, 0), (3, None, None, "x", 0), (2, 5, "tool", "z" * 50_000, 0)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, seq int")
    out = {r["conv_id"]: r for r in chat.read_back(chat.render(chat.fold(chat.turn_events(df)))).collect()}
    for conv in (1, 2, 3):
        turns = [(r or "", t or "") for c, n, r, t, _ in sorted(rows, key=lambda x: (x[0], -1 if x[1] is None else x[1], x[2] or "", x[3] or "")) if c == conv]
        masked = "".join(t for r, t in turns if r == "assistant")
        r = out[conv]
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(masked), hashlib.sha256(masked.encode()).hexdigest())
    assert chat.read_back(chat.render(chat.fold(chat.turn_events(df.limit(0))))).collect() == []


def test_one_payload_in_most_rows(spark):
    """A hot payload is broadcast, another that repeats is joined, single ones pass; a filter that is full changes nothing."""
    rows = [(i, f"http://h.test/{i}", "hot") for i in range(3, 1500)] + [(None, None, "hot"), (2000, "u", "twice"), (2001, "u", "twice")] + [(3000 + i, "u", f"single {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    out = warc.read(warc.write(df)).collect()
    assert len(out) == len(rows)
    kinds = Counter((r["record_type"], r["refers_to"]) for r in out)
    assert kinds == {("response", None): 302, ("revisit", 3): 1497, ("revisit", 2000): 1}


def test_a_changed_payload_is_an_error():
    raw = warc.record(1, "http://a.test", b"<p>one</p>", base64.b32encode(hashlib.sha1(b"<p>one</p>").digest()).decode(), None, False)
    assert warc.parse(raw)["payload_bytes"] == 10
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"one", b"two"))


def test_archives_as_files(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string, first int")
    archives = warc.write(df)
    written = {r["archive"]: r["bytes"] for r in warc.export(archives, str(tmp_path)).collect()}
    assert written and {p.name: p.stat().st_size for p in tmp_path.iterdir()} == written
    found = [warc.parse(raw)["fields"] for p in tmp_path.iterdir() for raw in warc.read_archive(p.read_bytes())]
    assert Counter(f["WARC-Type"] for f in found) == {"warcinfo": len(written), "response": 5, "revisit": 3}


def test_nulls_in_every_key_of_a_log(spark):
    events = [(None, None, "delta", None, None, "a"), (None, 1, "delta", None, None, "b"), (None, 2, "delta", "m", "user", None), (1, None, "edit", None, "assistant", "c")]
    df = spark.createDataFrame(events, "conv_id bigint, seq bigint, kind string, message string, role string, text string")
    got = Counter((r["conv_id"], r["seq"], r["role"], r["text"]) for r in chat.fold(df).collect())
    assert got == Counter([(None, None, "", "ab"), (None, 2, "user", ""), (1, None, "assistant", "c")])
    turns = spark.createDataFrame([(None, None, None, None), (None, None, None, None), (1, None, "assistant", "x"), (1, 2, "user", None)], "conv_id bigint, turn bigint, role string, text string")
    out = {r["conv_id"]: r["n_turns"] for r in chat.read_back(chat.render(chat.fold(chat.turn_events(turns)))).collect()}
    assert out == {None: 2, 1: 2}


def test_log_of_a_query_holds_all_kinds(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hello"), (1, 1, "assistant", "hi there")], "conv_id bigint, turn bigint, role string, text string")
    assert {r["kind"] for r in chat.turn_events(turns).collect()} == set(chat.KINDS)


def test_redact_and_marks_with_clashing_columns(spark, ratios):
    df = spark.createDataFrame([(1, "token=abcdefgh1", 2, "r", 5)], "doc_id bigint, text string, row int, text_ string, id_ int")
    out = secret_scan.redact(df, ratios)
    assert out.columns == df.columns and out.collect()[0].asDict() == {"doc_id": 1, "text": "[SECRET]", "row": 2, "text_": "r", "id_": 5}
