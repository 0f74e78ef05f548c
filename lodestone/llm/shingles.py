"""Word and shingle hashing over Arrow string buffers, in numpy.

Words are the maximal runs of bytes outside space and 0x09-0x0D, with A-Z lower-cased. A word's hash is the mixed sum of one random
64-bit value for each pair of a byte and its place in the word: from a table for the first NEAR places, from a mixing function
beyond. No two places share a multiplier, so patterns don't cancel as they do in polynomials modulo 2^64, and a word is hashed by
its own bytes only, wherever blocks begin: a word that goes on in the next block carries its sum and its length along. Shingles are
kept as 64-bit hashes: two given words or shingles fall together with probability about 2^-64, any two of a pair of documents of
100,000 words with probability below 2^-30.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

WORDS = 5
BLOCK = 1 << 20
NEAR = 64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values by place and byte for the near places, seeds by byte for the others, weights of shingles."""
    rng = np.random.default_rng(20240229)
    near = rng.integers(0, 2**64, (NEAR, 256), np.uint64, endpoint=False)
    far = rng.integers(0, 2**64, 256, np.uint64, endpoint=False)
    near[:, 65:91], far[65:91] = near[:, 97:123], far[97:123]
    return near.ravel(), far, rng.integers(1, 2**63, WORDS + 1, np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sums(buf: np.ndarray, cuts: np.ndarray, carried: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of the words of buf, their starts and last bytes; carried: bytes that the word at the start of buf has before it."""
    near, far, _ = _tables()
    space = _SPACE[buf]
    word = ~space
    first, last = word.copy(), word.copy()
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    inner = cuts[(cuts > 0) & (cuts < len(buf))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    sizes = ends - starts + 1
    letters = buf[word]
    firsts = np.cumsum(sizes) - sizes
    place = np.arange(len(letters)) - np.repeat(firsts, sizes)
    if carried and starts[0] == 0:
        place[: sizes[0]] += carried
    values = near[np.minimum(place, NEAR - 1) * 256 + letters]
    beyond = np.flatnonzero(place >= NEAR)
    if len(beyond):
        values[beyond] = mix(far[letters[beyond]] + place[beyond].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.add.reduceat(values, firsts), starts, ends


def words_of(buf: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of buf, their starts and last bytes; cuts: where a document starts or ends."""
    sums, starts, ends = _sums(buf, cuts)
    return mix(sums), starts, ends


def _words(buf: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, starts, _ = words_of(buf, cuts)
    return h, starts


def _long_words(buf: np.ndarray) -> np.ndarray:
    """Word hashes of one document of any length, block by block."""
    out: list[np.ndarray] = []
    total, length = np.zeros(1, np.uint64), 0  # of a word that the last block left open
    for at in range(0, len(buf), BLOCK):
        block = buf[at : at + BLOCK]
        sums, starts, ends = _sums(block, np.zeros(0, np.int64), length)
        goes_on = bool(length and len(starts) and starts[0] == 0)
        if goes_on:
            sums[0] += total[0]
        elif length:
            out.append(mix(total))
        if len(ends) and ends[-1] == len(block) - 1 and at + BLOCK < len(buf):
            length = len(block) - int(starts[-1]) + (length if goes_on and len(starts) == 1 else 0)
            total, sums = sums[-1:].copy(), sums[:-1]
        else:
            length = 0
        out.append(mix(sums))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _sequence(h: np.ndarray) -> np.uint64:
    """One hash of a whole sequence of hashes."""
    total = np.uint64(len(h))
    for x in h:
        total = mix((total * np.uint64(0x9E3779B97F4A7C15) + x).reshape(1))[0]
    return total


def _sets(h: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct shingles of each document; bounds: its first word and the end."""
    weights = _tables()[2]
    n = max(0, len(h) - WORDS + 1)
    grams = np.full(n, weights[WORDS], np.uint64)
    for k in range(WORDS):
        grams += h[k : n + k] * weights[k]
    grams = mix(grams)
    for a, b in bounds:
        if b - a >= WORDS:
            s = np.sort(grams[a : b - WORDS + 1])
            keep = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            yield s[keep]
        elif b > a:
            yield np.array([_sequence(h[a:b])], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The set of each text as a sorted array of distinct 64-bit hashes: of its 5-word shingles, of all its words
    as one if there are fewer, empty without words or text."""
    with np.errstate(over="ignore"):
        texts = texts.cast(pa.large_string()).combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts.cast(pa.large_string())
        if not len(texts):
            return
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        valid = np.asarray(texts.is_valid())
        ends = np.where(valid, offsets[1:], offsets[:-1])
        i = 0
        while i < len(texts):
            base = offsets[i]
            j = int(np.searchsorted(offsets, base + BLOCK, "right")) - 1
            if j <= i:
                yield from _sets(h := _long_words(data[base : ends[i]]), [(0, len(h))])
                i += 1
                continue
            a, b = offsets[i:j] - base, ends[i:j] - base
            h, starts = _words(data[base : offsets[j]], np.unique(np.concatenate([a, offsets[i : j + 1] - base])))
            yield from _sets(h, np.stack([np.searchsorted(starts, a), np.searchsorted(starts, b)], 1).tolist())
            i = j
