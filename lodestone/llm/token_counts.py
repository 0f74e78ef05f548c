"""Token counts by a two-tier lookup on the map side.

Tier 1 is one broadcast table: the most frequent pre-tokens of the corpus with their lengths in tokens, at most TABLE entries
of at most LONGEST characters (under 2 MB, whatever the input). It comes from the words of all documents, of which each
task hands on a bounded summary, split into pre-tokens only there; no pre-token is shuffled to be counted or encoded. The
table is cut at a count that a histogram of counts gives, so neither a task nor the driver holds more than its entries.
Tier 2 is a cache in each worker: a miss is encoded once and remembered, up to CACHE entries. The table only saves time:
counts are exact without it.

Cases: null and empty texts have 0 tokens and 0 bytes; special strings inside a text are special tokens, as the library's
default has it; null and repeated ids keep their rows; extra columns are ignored. Files other than byte-level BPE
(.model, other .json) are counted text by text through their library.
"""

from __future__ import annotations

from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, most_frequent
from .tokenizer import default_path, fast_encoder, vocabulary

LIMIT = 512
TABLE, LONGEST, CACHE = 1 << 16, 24, 300_000
SUMMARY, HELD, WORD = 1 << 14, 400_000, 64  # WORD: most characters of a word that is counted


class Lengths(dict):
    """Tokens of a pre-token; misses are encoded and kept in two generations, so that those in use survive a full cache."""

    def __init__(self, path: str, table: dict[str, int]):
        super().__init__(table)
        self.core = fast_encoder(path)._core_bpe
        self.special = vocabulary(path).special
        self.table, self.old = table, {}

    def __missing__(self, piece: str) -> int:
        n = self.old.get(piece)
        if n is None:
            n = 1 if piece in self.special else len(self.core.encode_single_piece(piece.encode()))
        if len(self) >= CACHE + len(self.table):
            self.old = dict(self)
            self.clear()
            self.update(self.table)
        self[piece] = n
        return n


@cache
def byte_level(path: str) -> bool:
    if not path.endswith(".json"):
        return False
    import json

    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    return data["model"]["type"] == "BPE" and (data.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and data.get("normalizer") is None


def frequent_pieces(docs: DataFrame, path: str, text_col: str = "text") -> list[str]:
    """At most TABLE of the most frequent short pre-tokens, from bounded summaries of the tasks' counts over all documents."""

    def summary(batches):
        held, kept = Counter(), Counter()

        def fold():
            # the most frequent words of each full counter
            for word, n in held.most_common(4 * SUMMARY):
                kept[word] += n
            held.clear()
            if len(kept) > 16 * SUMMARY:
                top = kept.most_common(4 * SUMMARY)
                kept.clear()
                kept.update(dict(top))

        for batch in batches:
            for text in batch.column(0):
                held.update(word for word in (text.as_py() or "").split(" ") if len(word) <= WORD)
                if len(held) > HELD:
                    fold()
        fold()
        pieces, found = vocabulary(path).pieces, Counter()
        for word, n in kept.items():
            for p in pieces(" " + word):
                found[p] += n
        top = [(p, n) for p, n in found.most_common(SUMMARY) if len(p) <= LONGEST]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"])

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(summary, "piece string, n bigint")
    total = materialize(counted.groupBy("piece").agg(F.sum("n").alias("n")), "pieces")
    return [r["piece"] for r in most_frequent(total, "n", TABLE).select("piece").collect()]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit."""
    path = path or default_path()
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    table = None
    if byte_level(path):
        core = fast_encoder(path)._core_bpe
        special = vocabulary(path).special
        pieces = frequent_pieces(docs, path, text_col)
        # names end to end with their ends, and a byte for each length
        ends = np.cumsum([len(p) for p in pieces], dtype=np.uint32)
        table = spark.sparkContext.broadcast(("".join(pieces), ends, bytes(1 if p in special else len(core.encode_single_piece(p.encode())) for p in pieces)))

    def count(batches):
        if table is not None:
            names, ends, sizes = table.value
            starts = [0, *ends[:-1].tolist()]
            split, lengths = vocabulary(path).pieces, Lengths(path, {names[a:b]: n for a, b, n in zip(starts, ends.tolist(), sizes, strict=False)})

            def tokens(texts):
                return [sum(map(lengths.__getitem__, split(t))) for t in texts]
        elif path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)

            def tokens(texts):
                return [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(path)
            whole.no_truncation()
            whole.no_padding()

            def tokens(texts):
                return [len(x.ids) for x in whole.encode_batch(texts, add_special_tokens=False)]

        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                n = tokens(part.column("text").to_pylist())
                sizes = pc.binary_length(part.column("text")).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), sizes, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
