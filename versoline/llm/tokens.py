"""Byte-level BPE ids of texts, with a cache of the pieces between spaces.

A space after a character that is no white space always starts a new match of the pre-token pattern, so a text without two
white-space characters in a row before a space can be cut there, and equal pieces are encoded once per worker.  Other texts
are encoded whole.
"""

from __future__ import annotations

import base64
import re
from array import array

import tiktoken

GAP = re.compile(r"\s ")
CACHED = 150_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Pieces(dict):
    """Piece to its ids (little-endian unsigned 32-bit), filled on demand and emptied when full."""

    def __init__(self, encode, front: str):
        self.encode, self.front = encode, front

    def __missing__(self, piece: str) -> bytes:
        if len(self) > CACHED:
            self.clear()
        ids = self[piece] = array("I", self.encode(self.front + piece)).tobytes()
        return ids


class Encoder:
    """Ids by a rank file; ``other`` encodes pieces outside the Latin blocks, where two libraries could disagree."""

    def __init__(self, path: str, pattern: str, other=None):
        self.ranks = read_ranks(path)
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.other = other
        self.first, self.later = Pieces(self._plain, ""), Pieces(self._plain, " ")

    def _plain(self, text: str) -> list[int]:
        if self.other and text and max(text) >= "ɐ":
            return self.other(text)
        return self.core.encode_ordinary(text)

    def forget(self) -> None:
        """Empty the piece caches; the ranks stay for the worker's next task."""
        self.first.clear()
        self.later.clear()

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if GAP.search(text):
            return array("I", self._plain(text)).tobytes()
        head, *rest = text.split(" ")
        return (self.first[head] if head else b"") + b"".join(map(self.later.__getitem__, rest))


_ENCODERS: dict[tuple, Encoder] = {}


def rank_encoder(path: str, pattern: str) -> Encoder:
    """One encoder per worker and vocabulary."""
    key = ("ranks", path)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, pattern)
    return _ENCODERS[key]


def json_encoder(json_path: str, rank_path: str, pattern: str) -> Encoder:
    """Ids of a tokenizers file; its rank twin does the pieces of Latin letters, where both agree, four times as fast."""
    key = ("json", json_path)
    if key not in _ENCODERS:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(json_path)
        tokenizer.encode_special_tokens = True
        _ENCODERS[key] = Encoder(rank_path, pattern, lambda text: tokenizer.encode(text, add_special_tokens=False).ids)
    return _ENCODERS[key]
