"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of WINDOW words, all of them, whatever its length. Each passage is encoded from surface
statistics of its bytes and words and from its words themselves, hashed to WORDS_HASHED shares, by a learned layer; gated
attention weighs the encodings; the weighted representation is scored. Only documents carry labels; the attention learns
which passages make a document what it is. Scoring reads texts only.

Weights are fitted on the driver with Adam on batches of BATCH documents, for at most EPOCHS passes or until the loss on a
tenth of the documents, held back from the fit, has not fallen for PATIENCE of them. The fit reads at most TRAIN_DOCS labelled
documents, those with the least hash of their id, and of these only texts of at most TRAIN_CHARS characters, one row per id
and label, which bounds what the driver gets (at most about 200 MB; some MB as a rule).

Cases: an empty or null text is one passage of its own kind and is scored like any other; null labels and labels without
an id are ignored; without any label every score is 0.5; repeated rows are scored alike; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import BLOCK, words_of

WINDOW = 64  # words of a passage
TRAIN_DOCS, TRAIN_CHARS = 6000, 50_000  # most labelled documents that the fit reads, and most characters of one
THRESHOLD = 0.3
FOLDS = 5
SURFACE, WORDS_HASHED = 20, 32
FEATURES, HIDDEN, GATE = SURFACE + WORDS_HASHED, 16, 8
EPOCHS, BATCH, PATIENCE, RATE, DECAY, SEED = 30, 256, 4, 0.01, 1e-4, 17


def _sums(mask: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(mask)])


def _passages(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of the passages of documents laid out in buf, and each passage's document."""
    n_docs = len(bounds)
    hashes, first, last = words_of(buf, np.unique(bounds)) if len(buf) else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    lo = np.searchsorted(first, bounds[:, 0])
    hi = np.searchsorted(first, bounds[:, 1])
    counts = hi - lo
    doc = np.repeat(np.arange(n_docs), counts)
    rank = np.arange(len(first)) - np.repeat(lo, counts)
    window = rank // WINDOW
    new = np.ones(len(first), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (window[1:] != window[:-1])
    starts = np.flatnonzero(new)
    out_doc = doc[starts]
    rows = np.zeros((len(starts), FEATURES))
    if len(starts):
        number = np.cumsum(new) - 1
        n = np.diff(np.append(starts, len(first))).astype(float)
        size = (last - first + 1).astype(float)
        upper, lower = _sums((buf >= 65) & (buf <= 90)), _sums((buf >= 97) & (buf <= 122))
        digit, high = _sums((buf >= 48) & (buf <= 57)), _sums(buf >= 128)
        a, b = first, last + 1
        up, low, dig, hig = (s[b] - s[a] for s in (upper, lower, digit, high))
        other = size - up - low - dig - hig
        end = buf[last]
        order = np.lexsort((hashes, number))
        distinct = np.ones(len(hashes), bool)
        distinct[1:] = (hashes[order][1:] != hashes[order][:-1]) | (number[order][1:] != number[order][:-1])
        same = np.zeros(len(hashes), bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & ~new[1:]
        add = lambda x: np.add.reduceat(x.astype(float), starts)
        chars = add(size)
        columns = [
            add(up) / chars, add(dig) / chars, add(hig) / chars, add(other) / chars,
            add((up > 1) & (low == 0)) / n, add((buf[first] >= 65) & (buf[first] <= 90)) / n,
            add(end == ord("!")) / n, add((size == 1) & (end == ord("|"))) / n,
            add(np.isin(end, np.frombuffer(b"%*&#$@~^+=<>", np.uint8))) / n,
            add(np.isin(end, np.frombuffer(b".?,;:", np.uint8))) / n,
            add((low == 0) & (up == 0) & (hig == 0)) / n, add(other > 1) / n,
            np.add.reduceat(distinct.astype(float), starts) / n, add(same) / n,
            add(size) / n / 8, np.sqrt(np.maximum(0, add(size**2) / n - (add(size) / n) ** 2)) / 8,
            add(size > 20) / n, add(size <= 2) / n, np.log1p(n) / np.log1p(WINDOW),
        ]
        rows[:, : len(columns)] = np.stack(columns, 1)
        shares = np.bincount(number * WORDS_HASHED + (hashes % np.uint64(WORDS_HASHED)).astype(np.int64), minlength=len(starts) * WORDS_HASHED)
        rows[:, SURFACE:] = shares.reshape(-1, WORDS_HASHED) / n[:, None]
    empty = np.setdiff1d(np.arange(n_docs), out_doc)
    if len(empty):
        blank = np.zeros((len(empty), FEATURES))
        blank[:, SURFACE - 1] = 1
        rows, out_doc = np.concatenate([rows, blank]), np.concatenate([out_doc, empty])
        order = np.argsort(out_doc, kind="stable")
        rows, out_doc = rows[order], out_doc[order]
    return rows, out_doc


def passages(texts: pa.Array):
    """(features, document numbers), a few documents at a time; numbers count up from the first text."""
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    ends = np.where(np.asarray(texts.is_valid()), offsets[1:], offsets[:-1])
    i = 0
    with np.errstate(over="ignore"):
        while i < len(texts):
            base = offsets[i]
            j = int(np.searchsorted(offsets, base + BLOCK, "right")) - 1
            if j <= i:  # one long text, block by block: passages start anew at each
                buf, at, parts = data[base : ends[i]], 0, []
                while at < len(buf):
                    end = min(at + BLOCK, len(buf))
                    if end < len(buf) and len(gaps := np.flatnonzero(buf[at:end] == 0x20)) and gaps[-1]:
                        end = at + int(gaps[-1])
                    parts.append(_passages(buf[at:end], np.array([[0, end - at]]))[0])
                    at = end
                rows = np.concatenate(parts)
                yield rows, np.full(len(rows), i)
                i += 1
                continue
            rows, doc = _passages(data[base : offsets[j]], np.stack([offsets[i:j] - base, ends[i:j] - base], 1))
            yield rows, doc + i
            i = j


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def score(self, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores of the documents whose passages begin at starts."""
        return self._forward((rows - self.mean) / self.scale, starts)["p"]

    def _forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        counts = np.diff(np.append(starts, len(x)))
        h = np.tanh(x @ w["We"] + w["be"])
        t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        e = (t * g) @ w["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
        a = e / np.repeat(np.add.reduceat(e, starts), counts)
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ w["c"] + w["d"]), "counts": counts}

    def _gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.weights, self._forward(x, starts)
        dz_score = (f["p"] - y) / len(y)
        dz = dz_score[:, None] * w["c"]
        dz_rows = np.repeat(dz, f["counts"], 0)
        da = (dz_rows * f["h"]).sum(1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, starts), f["counts"]))
        dt, dg = de[:, None] * w["w"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * w["w"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz_rows + dt @ w["V"].T + dg @ w["U"].T) * (1 - f["h"] ** 2)
        return {"c": f["z"].T @ dz_score, "d": dz_score.sum(keepdims=True), "w": (f["t"] * f["g"]).T @ de, "V": f["h"].T @ dt, "U": f["h"].T @ dg, "We": x.T @ dh, "be": dh.sum(0)}


def fit(rows: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> Model:
    rng = np.random.default_rng(SEED)
    draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    weights = {"We": draw(FEATURES, HIDDEN), "be": np.zeros(HIDDEN), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "w": draw(GATE), "c": draw(HIDDEN), "d": np.zeros(1)}
    model = Model(rows.mean(0), np.maximum(rows.std(0), 1e-2), weights)
    x = (rows - model.mean) / model.scale
    counts = np.diff(np.append(starts, len(rows)))

    def bags(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = counts[chosen]
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        return x[np.arange(n.sum()) + np.repeat(starts[chosen] - first, n)], first, labels[chosen]

    order = rng.permutation(len(starts))
    held = order[: len(order) // 10]
    used = order[len(held) :]
    check = bags(held) if len(held) else bags(used)
    first, second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
    best, kept, waited, step = np.inf, None, 0, 0
    for _ in range(EPOCHS):
        rng.shuffle(used)
        for i in range(0, len(used), BATCH):
            step += 1
            for k, g in model._gradients(*bags(used[i : i + BATCH])).items():
                g = g + DECAY * weights[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        p = np.clip(model._forward(check[0], check[1])["p"], 1e-9, 1 - 1e-9)
        loss = -np.mean(check[2] * np.log(p) + (1 - check[2]) * np.log(1 - p))
        if loss < best - 1e-4:
            best, kept, waited = loss, {k: v.copy() for k, v in weights.items()}, 0
        elif (waited := waited + 1) >= PATIENCE and step >= 100:
            break
    return Model(model.mean, model.scale, kept or weights)


def _fold(column: str):
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(FOLDS))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """Fit on labelled rows outside the held-out fold."""
    known = labels.select(F.col(id_col).cast("bigint").alias("id_"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isNotNull() & (_fold("id_") != 0))
    # a cut by hash leaves little more than is asked for, so the ordered limit has next to nothing to move
    total = known.count()
    share = min(1.0, 1.5 * TRAIN_DOCS / max(total, 1) + 1e-9)
    place = F.pmod(F.xxhash64("id_"), F.lit(1 << 32))
    chosen = known.where(place <= int(share * (1 << 32))).orderBy(place, "id_", "y").limit(TRAIN_DOCS)

    def encode(batches):
        for batch in batches:
            y = batch.column("y").to_pylist()
            ids = batch.column("id_").to_pylist()
            for rows, doc in passages(batch.column("text_")):
                for d in np.unique(doc):
                    yield pa.RecordBatch.from_arrays([pa.array([ids[d]], pa.int64()), pa.array([y[d]], pa.int32()), pa.array([rows[doc == d].astype(np.float32).tobytes()], pa.binary())], ["id_", "y", "rows"])

    texts = docs.select(F.col(id_col).cast("bigint").alias("id_"), F.col(text_col).cast("string").alias("text_"))
    texts = texts.where(F.coalesce(F.length("text_"), F.lit(0)) <= TRAIN_CHARS)
    # at most TRAIN_DOCS ids, so the broadcast is bounded, and one row of each comes back
    rows = texts.join(F.broadcast(chosen), "id_").mapInArrow(encode, "id_ bigint, y int, rows binary")
    found = rows.groupBy("id_", "y").agg(F.min("rows").alias("rows")).collect()
    found.sort(key=lambda r: (r["id_"], r["y"]))
    if not found:
        return None
    bags = [np.frombuffer(r["rows"], np.float32).reshape(-1, FEATURES) for r in found]
    starts = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]]).astype(np.int64)
    return fit(np.concatenate(bags).astype(float), starts, np.array([r["y"] for r in found], float))


def _scores(texts: pa.Array, model: Model | None) -> np.ndarray:
    out = np.full(len(texts), 0.5)
    if model is not None:
        for rows, doc in passages(texts):
            starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            out[doc[starts]] = model.score(rows.astype(np.float32).astype(float), starts)
    return out


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""

    def work(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(batch.column("text_"), model))], ["doc_id", "score_"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text_"))
    scored = rows.mapInArrow(work, "doc_id bigint, score_ double")
    return scored.select("doc_id", F.coalesce(_fold("doc_id") == 0, F.lit(False)).alias("held_out"), F.col("score_").alias("score"), (F.col("score_") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least the threshold; only the text goes to the workers."""

    @F.arrow_udf("double")
    def rate(texts: pa.Array) -> pa.Array:
        return pa.array(_scores(texts, model))

    return docs.where(rate(F.col(text_col).cast("string")) >= threshold)
