"""The byte-level BPE vocabulary of the public tokenizer file, loaded once per worker process."""

from __future__ import annotations

import json
from functools import cache

import regex

#: Fixed values of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Vocabulary:
    """Token bytes by id, merges as (left id, right id) -> id, special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        to_byte = {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(PRINTABLE))}
        vocab = data["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens: list[bytes] = [b""] * size
        for text, i in vocab.items():
            self.tokens[i] = bytes(to_byte[c] for c in text) if text not in self.special else text.encode()
        for text, i in self.special.items():
            self.tokens[i] = text.encode()
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(data["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.pattern = regex.compile(PATTERN)
        self.splitter = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text; a special string is a piece of its own."""
        if self.splitter and any(s in text for s in self.special):
            return [p for part in self.splitter.split(text) if part for p in ([part] if part in self.special else self.pattern.findall(part))]
        return self.pattern.findall(text)


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@cache
def fast_encoder(path: str):
    """The same vocabulary in the tiktoken library: numpy ids of a whole text, and ids of one pre-token."""
    import tiktoken

    v = vocabulary(path)
    ranks = {t: i for i, t in enumerate(v.tokens) if i not in v.special.values()}
    return tiktoken.Encoding("lodestone", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=v.special)


@cache
def encoder(path: str):
    """Ids of any text as a numpy array, a special string as its own token.

    The library's splitter gives up on white space of about a million characters; such a text is split here with the same
    pattern, piece by piece.
    """
    import numpy as np

    fast, v = fast_encoder(path), vocabulary(path)

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            single = fast._core_bpe.encode_single_piece
            return np.concatenate([np.array([v.special[x]] if x in v.special else single(x.encode()), np.uint32) for x in v.pieces(text)])

    return encode
