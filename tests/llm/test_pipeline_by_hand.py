"""Every stage of the pipeline, and the classifier's scores, against plain Python on documents with planted cases."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm import packing, quality, secret_scan
from lodestone.llm.shingles import words_of
from lodestone.llm.tokenizer import default_path

LIBRARY = Tokenizer.from_file(default_path())
WORDS = "the river of stone and light moves under old trees while a quiet wind carries seeds over distant hills toward evening".split()


def planted():
    """(documents, labels): clean prose, rejects, exact and near copies, secrets, and odd texts."""
    draw = random.Random(12)
    docs, labels = [], []

    def add(text, good=None):
        docs.append((len(docs), text, "en", "s", None if text is None else len(text)))
        if good is not None:
            labels.append((len(docs) - 1, int(good), 0))
        return len(docs) - 1

    clean = [" ".join(draw.choice(WORDS) + str(draw.randrange(40)) for _ in range(draw.randint(30, 300))) + "." for _ in range(160)]
    for text in clean:
        add(text, True)
    for i in range(80):
        add(" ".join(w.upper() + "!!" for w in draw.choices(WORDS, k=60)) + f" #### {i}", False)
    for text in clean[:12]:
        add(text)
    for text in clean[20:32]:
        words = text.split(" ")
        words[len(words) // 2] = "changed"
        add(" ".join(words))
    for _ in range(6):
        text = " ".join(draw.choice(WORDS) + str(draw.randrange(40)) for _ in range(100))
        add(text + " password=hunter2hunter2 and AKIA" + "Z" * 16 + " then aB3xY9zQ7wE5rT2yU8iO0pLkJhGfDs4vNm6cX1q end")
    add(clean[50] * 40)
    add(None)
    add("")
    return docs, labels


def plain_features(text):
    """The classifier's passage features, one word at a time."""
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())
    if not words:
        row = [0.0] * quality.FEATURES
        row[quality.SURFACE - 1] = 1.0
        return [row]
    out = []
    for at in range(0, len(words), quality.WINDOW):
        part = words[at : at + quality.WINDOW]
        n = len(part)
        count = lambda w, test: sum(map(test, w))
        kinds = [tuple(count(w, t) for t in (lambda b: 65 <= b <= 90, lambda b: 97 <= b <= 122, lambda b: 48 <= b <= 57, lambda b: b >= 128)) for w in part]
        other = [len(w) - sum(k) for w, k in zip(part, kinds, strict=True)]
        lower = [w.lower() for w in part]
        sizes = [len(w) for w in part]
        chars, mean = sum(sizes), sum(sizes) / n
        share = lambda test: sum(map(bool, test)) / n
        row = [
            sum(k[0] for k in kinds) / chars, sum(k[2] for k in kinds) / chars, sum(k[3] for k in kinds) / chars, sum(other) / chars,
            share(k[0] > 1 and not k[1] for k in kinds), share(65 <= w[0] <= 90 for w in part), share(w[-1:] == b"!" for w in part), share(w == b"|" for w in part),
            share(w[-1] in b"%*&#$@~^+=<>" for w in part), share(w[-1] in b".?,;:" for w in part), share(not k[0] and not k[1] and not k[3] for k in kinds), share(o > 1 for o in other),
            len(set(lower)) / n, share(a == b for a, b in zip(lower, lower[1:])), mean / 8, max(0, sum(s * s for s in sizes) / n - mean**2) ** 0.5 / 8,
            share(s > 20 for s in sizes), share(s <= 2 for s in sizes), np.log1p(n) / np.log1p(quality.WINDOW), 0.0,
        ]
        hashed = [0.0] * quality.WORDS_HASHED
        for w in part:
            hashed[int(words_of(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0]) % quality.WORDS_HASHED] += 1 / n
        out.append(row + hashed)
    return out


def plain_score(model, text):
    w = model.weights
    rows = [(np.array(r, np.float32).astype(float) - model.mean) / model.scale for r in plain_features(text)]
    hidden = [np.tanh(r @ w["We"] + w["be"]) for r in rows]
    weight = [float(np.exp((np.tanh(h @ w["V"]) * (1 / (1 + np.exp(-(h @ w["U"]))))) @ w["w"])) for h in hidden]
    z = sum(a * h for a, h in zip(weight, hidden, strict=True)) / sum(weight)
    return float(1 / (1 + np.exp(-(z @ w["c"] + w["d"][0]))))


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_redaction(text, ratios):
    spans, blank = [], list(text)
    for _, pattern, group, least in secret_scan.RULES:
        for m in re.finditer(pattern, text):
            if len(m[group]) >= least:
                spans.append((m.start(), m.end()))
                blank[m.start() : m.end()] = " " * (m.end() - m.start())
    at = {c: i for i, c in enumerate(secret_scan.ALPHABET)}
    for m in re.finditer("[A-Za-z0-9+/_=-]{16,}", "".join(blank)):
        seen = set(zip(m[0], m[0][1:]))
        if len(seen) >= secret_scan.DIFFERENT and sum(ratios.ratios[at[a] * len(at) + at[b]] for a, b in seen) >= max(ratios.evidence, ratios.margin * len(seen)):
            spans.append(m.span())
    out, done = "", 0
    for a, b in sorted(spans):
        if a >= done:
            out += text[done:a] + "[SECRET]"
        done = max(done, b)
    return out + text[done:]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("planted"))
    docs, labels = planted()
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_scores_equal_plain_python(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    texts = {d: t for d, t, *_ in planted()[0]}
    for r in quality.score(docs, model).collect():
        want = plain_score(model, texts[r["doc_id"]])
        assert abs(r["score"] - want) < 1e-6 and r["predicted"] == int(r["score"] >= 0.3)
    odd = ["", None, "a", "É ! | x9 " * 100, "UPPER lower 12 %%", " \t\n"]
    got = list(quality.passages(pa.array(odd)))
    rows, owner = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
    for i, t in enumerate(odd):
        assert np.allclose(rows[owner == i], plain_features(t))


def test_each_stage_equals_plain_python(spark, tables):
    read = lambda df: {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
    first = spark.read.parquet(f"{tables}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    texts = read(first)

    model = quality.train(first, spark.read.parquet(f"{tables}/labels.parquet"))
    want = {d: t for d, t in texts.items() if plain_score(model, t) >= 0.3}
    assert set(range(160)) <= set(want) and not set(range(160, 240)) & set(want)
    step = stages["quality_classifier"](spark, first, tables)
    assert read(step) == want and step.columns == first.columns

    largest = {}
    for d, t in want.items():
        largest[t or ""] = max(d, largest.get(t or "", -1))
    want = {d: t for d, t in want.items() if largest[t or ""] == d}
    step = stages["exact_dedup"](spark, step, tables)
    assert read(step) == want

    sets = {d: shingles(t) for d, t in want.items()}
    root = {d: d for d in want}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in want:
        for b in want:
            if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and (x := find(a)) != (y := find(b)):
                root[max(x, y)] = min(x, y)
    near = {d: t for d, t in want.items() if find(d) == d}
    assert len(near) < len(want)
    step = stages["ngram_jaccard_join"](spark, step, tables)
    assert read(step) == near

    ratios = secret_scan.model_of(step)
    clean = {d: None if t is None else plain_redaction(t, ratios) for d, t in near.items()}
    assert sum("[SECRET]" in (t or "") for t in clean.values()) >= 3
    step = stages["secret_scan"](spark, step, tables)
    assert read(step) == clean
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in step.collect())

    check_packing(stages["packing"](spark, step, tables).collect(), clean)
    check_packing(corpus_pipeline.run(spark, tables).collect(), clean)


def check_packing(rows, texts):
    """Every id of every document in one piece; sequences without gaps, full but for powers of two."""
    ids = {d: [*LIBRARY.encode(t or "", add_special_tokens=False).ids, packing.SEPARATOR] for d, t in texts.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        some = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(some) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(some, "<u4").tobytes())
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for found, total in [(p, len(ids[d])) for d, p in pieces.items()] + [(s, None) for s in sequences.values()]:
        end = 0
        for at, length in sorted(found):
            assert at == end
            end += length
        assert end == total if total is not None else end <= packing.CAPACITY
