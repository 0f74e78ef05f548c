"""Harmonic packing of tokenised documents into sequences of fixed capacity.

Class k takes pieces of more than capacity / (k + 1) and at most capacity / k tokens; a bin of class k closes when it
holds k pieces, so a worker needs one open bin per class and no other worker's help. A document is first cut into full
sequences; of the rest, a piece goes whole into its class if a bin of such pieces would lose at most WASTE of the
capacity, else it is cut at the largest size of the next class. Bins that are still open when a worker's rows end
are poured together, cut into full sequences, and the last tokens into powers of two, which need no padding.

Every token lies in exactly one piece. sequence_id is (partition, running number): a retried task, which reads the same
rows of the same files, gives the same ids.

Cases: a null or empty text is the separator alone; a text of any length is cut as it goes; null and repeated ids keep
their rows; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokenizer import default_path, encoder

CAPACITY = 1024
SEPARATOR = 0
WASTE = 0.02
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def cut(rest: int, capacity: int = CAPACITY, waste: float = WASTE) -> list[int]:
    """Piece lengths for what remains of a document below one sequence."""
    out = []
    while rest:
        k = capacity // rest
        if k * rest >= (1 - waste) * capacity:
            out.append(rest)
            break
        size = capacity // (k + 1)
        out.append(size)
        rest -= size
    return out


class Packer:
    """Open bins of one worker."""

    def __init__(self, partition: int, capacity: int = CAPACITY):
        self.capacity, self.next = capacity, partition << 40
        self.open: dict[int, list] = {}
        self.rows: list[tuple] = []

    def _emit(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        at, n, c = 0, len(ids), self.capacity
        while n - at >= c:
            self._emit([(doc, at, ids[at : at + c], n)])
            at += c
        for size in cut(n - at, c):
            k = c // size
            bin_ = self.open.setdefault(k, [])
            bin_.append((doc, at, ids[at : at + size].copy(), n))
            if len(bin_) == k:
                self._emit(self.open.pop(k))
            at += size

    def finish(self) -> None:
        """Pour the open bins together, up to full sequences and then powers of two."""
        pieces = [p for k in sorted(self.open) for p in self.open[k]]
        left = sum(len(p[2]) for p in pieces)
        self.open = {}
        current, room = [], 0
        for doc, start, ids, total in pieces:
            at = 0
            while at < len(ids):
                if not room:
                    room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
                step = min(room, len(ids) - at)
                current.append((doc, start + at, ids[at : at + step], total))
                at, room, left = at + step, room - step, left - step
                if not room:
                    self._emit(current)
                    current = []

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [[]] * 7
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = path or default_path()

    def work(batches):
        encode = encoder(path)
        packer = Packer(TaskContext.get().partitionId(), capacity)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "")
                packer.add(doc, np.append(ids, np.uint32(SEPARATOR)))
                if len(packer.rows) >= 20_000:
                    yield packer.take()
        packer.finish()
        yield packer.take()

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, SCHEMA)
