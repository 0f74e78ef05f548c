"""Byte-level BPE encoding by backtracking over longest matches, and decoding by an offset table.

A sequence of tokens is what the merges make of its bytes exactly when every adjacent pair is compatible: encoding the two
tokens' bytes gives back the two tokens. So the encoder walks the text with the longest token at each position (an
Aho-Corasick automaton over all token bytes). It keeps a token if the pair with the one before is compatible, else
falls back to that token's longest proper prefix token, and steps back when none is left; a position found dead is never
tried again, and the automaton reads no further than the longest token, which makes the time linear in the text. Pair checks go down the two tokens' merge trees along their common
border and are remembered.

Decoding lays token bytes end to end in one array; an offset table turns ids into one gather.

Cases: null and empty texts have no ids and decode to an empty text; special strings are single tokens, as the library's
default has it; null and repeated ids keep their rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokenizer import default_path, vocabulary

CACHE = 200_000
PAIRS = 1_000_000


class Backtracker:
    """Exact encoder of single pre-tokens."""

    def __init__(self, path: str):
        import ahocorasick

        v = vocabulary(path)
        special = set(v.special.values())
        self.bytes = v.tokens
        self.size = [len(t) for t in v.tokens]
        self.longest_token = max(n for i, n in enumerate(self.size) if i not in special)
        self.automaton = ahocorasick.Automaton()
        by_bytes: dict[bytes, int] = {}
        for i, t in enumerate(v.tokens):
            if t and i not in special:
                by_bytes[t] = i
                self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.whole = by_bytes
        self.shorter = [-1] * len(v.tokens)
        for t, i in by_bytes.items():
            for n in range(len(t) - 1, 0, -1):
                if (j := by_bytes.get(t[:n])) is not None:
                    self.shorter[i] = j
                    break
        self.rank: dict[tuple[int, int], int] = {}
        self.made = [(-1, None)] * len(v.tokens)  # rank of the merge that makes a token, and its halves
        for pair, (rank, out) in v.merges.items():
            self.rank[pair] = rank
            self.made[out] = (rank, pair)
        self.compatible: dict[tuple[int, int], bool] = {}

    def pair_ok(self, a: int, b: int) -> bool:
        """Do the bytes of a, then b encode to exactly a, b?

        Undo merges on the two sides of the border from the latest back. At each stage the tokens that touch must not have
        a merge that would have come before the one just undone on either side.
        """
        if (known := self.compatible.get((a, b))) is not None:
            return known
        left, right, before = a, b, 1 << 60
        ok = True
        while True:
            rank = self.rank.get((left, right))
            if rank is not None and rank < before:
                ok = False
                break
            ml, mr = self.made[left][0], self.made[right][0]
            if ml < 0 and mr < 0:
                break
            if ml > mr:
                # the left token's last merge comes later: before it, its right half touches the border
                before, left = ml, self.made[left][1][1]
            else:
                # one merge works from left to right, so across the border it comes before its own use in the right token
                before, right = mr + 1, self.made[right][1][0]
        if len(self.compatible) >= PAIRS:
            self.compatible.clear()
        self.compatible[a, b] = ok
        return ok

    def encode(self, raw: bytes) -> list[int]:
        if (one := self.whole.get(raw)) is not None:
            return [one]
        text, n = raw.decode("latin-1"), len(raw)
        out: list[int] = []
        dead = bytearray(n + 1)
        reach, size, shorter = self.longest_token, self.size, self.shorter
        # the automaton copies what it is given, so it gets what a token can span and no more
        longest = lambda at: next(self.automaton.iter_long(text[at : at + reach]))[1]
        at, token = 0, longest(0)
        while True:
            end = at + size[token]
            if not dead[end] and (not out or self.pair_ok(out[-1], token)):
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest(at)
                continue
            token = shorter[token]
            while token < 0:
                dead[at] = 1
                token = out.pop()
                at -= size[token]
                token = shorter[token]


class Codec:
    """Encodes and decodes whole texts; pieces seen before come from a bounded cache."""

    def __init__(self, path: str):
        self.v = vocabulary(path)
        self.backtracker = Backtracker(path)
        self.young: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}
        self.table = np.frombuffer(b"".join(self.v.tokens), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in self.v.tokens])])

    def _look_up(self, pieces: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids and decimal ids of each piece. Two generations: what was used lately survives when the cache is full."""
        young = self.young
        for p in pieces:
            if p not in young:
                got = self.old.get(p)
                if got is None:
                    ids = [self.v.special[p]] if p in self.v.special else self.backtracker.encode(p.encode())
                    got = np.array(ids, np.uint32).tobytes(), b",".join([b"%d" % i for i in ids])
                young[p] = got
        found = [young[p] for p in pieces]
        if len(young) > CACHE:
            self.old, self.young = young, {}
        return found

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join([x[0] for x in self._look_up(self.v.pieces(text))]), np.uint32)

    def encode_with_decimal(self, text: str) -> tuple[np.ndarray, bytes]:
        found = self._look_up(self.v.pieces(text))
        return np.frombuffer(b"".join([x[0] for x in found]), np.uint32), b",".join([x[1] for x in found])

    def decode(self, ids: np.ndarray) -> str:
        parts = []
        for i in range(0, len(ids), 1 << 18):
            some = ids[i : i + (1 << 18)]
            starts = self.offsets[some]
            sizes = self.offsets[some + np.uint32(1)] - starts
            ends = np.cumsum(sizes)
            at = np.repeat(starts - (ends - sizes), sizes)
            parts.append(self.table[at + np.arange(len(at))].tobytes())
        return b"".join(parts).decode("utf-8", "replace")


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>."""
    path = path or default_path()

    def work(batches):
        c = codec(path)
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                ids = [c.encode(t or "").astype(np.int32) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _rows(docs, id_col, text_col).mapInArrow(work, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text, of rows with arrays of ids; null ids give an empty text."""
    path = path or default_path()

    def work(batches):
        c = codec(path)
        for batch in batches:
            texts = [c.decode(np.array(x or [], np.uint32)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(work, "doc_id bigint, text string")


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, then decode each text in one pass: doc_id, n_tokens, and digests of the decimal ids and of the decoded text."""
    path = path or default_path()

    def work(batches):
        c = codec(path)
        for batch in batches:
            n, a, b = [], [], []
            for text in batch.column("text"):
                ids, decimal = c.encode_with_decimal(text.as_py() or "")
                n.append(len(ids))
                a.append(hashlib.sha256(decimal).hexdigest())
                b.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _rows(docs, id_col, text_col).mapInArrow(work, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
