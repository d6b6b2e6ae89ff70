"""Byte-level BPE: encoding and decoding as a reduction over a tree of token sequences.

Token sequences with ``joined`` as the operation form a monoid: the sequence of a text is the product of the
sequences of its halves, however it is halved. ``joined`` re-encodes a window around the seam. A sequence is the
encoding of its bytes exactly if each two neighbours encode to themselves, so once the window's first and last
token agree with the tokens outside, those can't change and the join is done; else the window grows.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import appended, task_cache

#: Bytes up to which a piece is encoded by plain merging; longer ones are halved.
LEAF_BYTES = 24
#: Pieces and token pairs a task remembers, at most.
REMEMBERED = 300_000


class ByteBpe:
    """Encoder and decoder for one file of ranks; built once in each task."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pieces = regex.compile(pattern)
        self._known: dict[str, tuple[int, ...]] = {}
        self._neighbours: dict[tuple[int, int], bool] = {}

    def _merged(self, data: bytes) -> list[int]:
        """Encoding by plain merging: the lowest rank first, the leftmost of equals."""
        if len(data) > LEAF_BYTES:
            return self._merged_by_heap(data)
        rank_of, top = self.ranks.get, len(self.ranks)
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [rank_of(a + b, top) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = min(pairs)
            if best == top:
                break
            at = pairs.index(best)
            parts[at : at + 2] = [self.tokens[best]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = rank_of(parts[at] + parts[at + 1], top)
            if at:
                pairs[at - 1] = rank_of(parts[at - 1] + parts[at], top)
        return [self.ranks[p] for p in parts]

    def _merged_by_heap(self, data: bytes) -> list[int]:
        """The same for long strings: candidate merges wait in a heap, outdated ones are passed over."""
        ranks, n = self.ranks, len(data)
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i, i + 1, i + 2) for i in range(n - 1) if (rank := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, start, middle, end = heapq.heappop(heap)
            if ends[start] != middle or ends[middle] != end:
                continue
            ends[start], ends[middle] = end, 0
            if end < n:
                before[end] = start
                if (rank := ranks.get(data[start : ends[end]])) is not None:
                    heapq.heappush(heap, (rank, start, end, ends[end]))
            if (previous := before[start]) >= 0 and (rank := ranks.get(data[previous:end])) is not None:
                heapq.heappush(heap, (rank, previous, start, end))
        out, at = [], 0
        while at < n:
            out.append(ranks[data[at : ends[at]]])
            at = ends[at]
        return out

    def _stable(self, left: int, right: int) -> bool:
        """Whether two neighbouring tokens stay as they are."""
        key = (left, right)
        if (known := self._neighbours.get(key)) is None:
            known = self._merged(self.tokens[left] + self.tokens[right]) == [left, right]
            if len(self._neighbours) < REMEMBERED:
                self._neighbours[key] = known
        return known

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the joined bytes of two encodings."""
        if not left or not right:
            return left + right
        if self._stable(left[-1], right[0]):
            return left + right
        width = 1
        while True:
            i, j = max(0, len(left) - width), min(len(right), width)
            window = self._merged(b"".join(map(self.tokens.__getitem__, left[i:] + right[:j])))
            if (not i or self._stable(left[i - 1], window[0])) and (
                j == len(right) or self._stable(window[-1], right[j])
            ):
                return left[:i] + window + right[j:]
            width *= 2

    def reduced(self, data: bytes) -> list[int]:
        """Encoding of a byte string of any length, by halves."""
        if len(data) <= LEAF_BYTES:
            return self._merged(data)
        middle = len(data) // 2
        return self.joined(self.reduced(data[:middle]), self.reduced(data[middle:]))

    def piece(self, piece: str) -> tuple[int, ...]:
        """Encoding of one match of the pattern."""
        data = piece.encode("utf-8", "replace")
        whole = self.ranks.get(data)
        ids = (whole,) if whole is not None else tuple(self.reduced(data))
        if len(self._known) < REMEMBERED and len(data) <= 64:
            self._known[piece] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        """Token ids of a text, as little-endian unsigned 32-bit integers; none for null."""
        ids: list[int] = []
        known, piece, extend = self._known, self.piece, ids.extend
        for match in self.pieces.findall(text or ""):
            extend(known.get(match) or piece(match))
        return np.array(ids, "<u4")

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes of token ids, concatenated."""
        return b"".join(map(self.tokens.__getitem__, ids))


_BUILT: dict[tuple[str, str], ByteBpe] = task_cache({})


def built(path: str, pattern: str) -> ByteBpe:
    """The encoder of this task."""
    if (path, pattern) not in _BUILT:
        _BUILT[path, pattern] = ByteBpe(path, pattern)
    return _BUILT[path, pattern]


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The frame with ``ids`` (binary: little-endian unsigned 32-bit integers) and ``n_tokens`` of every whole text.

    Null and empty texts have no tokens; each row, repeated ones too, keeps its place; other columns pass through,
    but for old ones named like the new. The file of ranks must lie at ``path`` on every executor.
    """

    def rows(columns: dict) -> dict:
        bpe = built(path, pattern)
        ids = [bpe.encode(text) for text in columns["text"]]
        return {"ids": [x.tobytes() for x in ids], "n_tokens": [len(x) for x in ids]}

    return appended(docs, ["text"], rows, "ids binary, n_tokens long")


def decoded(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """The frame with ``data``, the bytes of its token ids; null ids give empty data."""

    def rows(columns: dict) -> dict:
        bpe = built(path, pattern)
        return {"data": [bpe.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in columns["ids"]]}

    return appended(tokens, ["ids"], rows, "data binary")
