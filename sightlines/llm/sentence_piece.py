"""SentencePiece encoding for merge-type vocabularies by a score-ordered agenda, and decoding.

A text is normalised as the model says, split into characters, and every pair of neighbours that is a piece waits in an
agenda. The pair with the best score, the leftmost of equals, is merged, and its new neighbours join the agenda; pairs
whose parts have meanwhile changed are passed over. Characters that are no piece fall back to bytes. Where no piece
of the vocabulary goes on behind its word, words are independent: the new words of a batch are merged together, one row
of an array being the agenda of one word, and long words by an agenda that is a heap. Every word that is encoded is held
against the sentencepiece library, a batch at a time.
"""

from __future__ import annotations

import codecs
import heapq
import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import SLICE_ROWS

#: Words a task remembers from one batch to the next, at most; beyond, it starts anew.
REMEMBERED = 200_000
#: Words of up to so many characters are merged together; longer ones by themselves.
WIDTHS = (8, 16, 40)

#: Characters (the space mark and the first code points) whose pairs are tabulated.
FREQUENT = 400

_NONE = np.iinfo(np.int64).max

_SPACE = "▁"


def _byte_by_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("byte_by_byte", _byte_by_byte)


class Pieces:
    """A merge-type vocabulary; made anew by every task."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.library.get_piece_size()
        texts = [self.library.id_to_piece(i) for i in range(size)]
        self.ids: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.bytes: list[int] = [-1] * 256
        self.surface: list[bytes] = []
        for i, text in enumerate(texts):
            if self.library.is_byte(i):
                value = int(text[1:-1], 16)
                self.bytes[value] = i
                self.surface.append(bytes([value]))
            elif self.library.is_control(i):
                self.surface.append(b"")
            elif self.library.is_unknown(i):
                self.surface.append(" ⁇ ".encode())
            else:
                self.ids[text] = i
                self.rank[text] = -self.library.get_score(i)
                self.surface.append(text.replace(_SPACE, " ").encode())
        self.starts = {i for text, i in self.ids.items() if text.startswith(_SPACE)}
        self.end = np.array([self.library.eos_id()], "<i4").tobytes()
        if any(self.library.is_unused(i) for i in range(size)) or min(self.bytes) < 0:
            raise ValueError("a vocabulary with unused pieces or without byte pieces")
        # a word ends where a space mark follows another character, unless a piece holds both
        whole = any(re.search(f"[^{_SPACE}]{_SPACE}", text) for text in self.ids)
        self.words = re.compile(".+" if whole else f"{_SPACE}*[^{_SPACE}]+|{_SPACE}+", re.DOTALL)
        # words can be given to the library as texts where normalising only marks spaces
        self.marked = self.library.normalize(" a  b") == f"{_SPACE}{_SPACE}a{_SPACE}{_SPACE}b"
        self.known: dict[str, bytes] = {}
        self.wrong: set[str] = set()
        self._tabulate()

    def _tabulate(self) -> None:
        """Arrays for the joint agendas: characters to symbols, pairs of symbols to places in the score order."""
        # a character that is no piece is a symbol below zero and in no pair
        self.characters = -1 - np.arange(0x110000, dtype=np.int64)
        for text, i in self.ids.items():
            if len(text) == 1:
                self.characters[ord(text)] = i
        place = {r: k for k, r in enumerate(sorted(set(self.rank.values())))}
        pairs = []
        for text, i in self.ids.items():
            for k in range(1, len(text)):
                left, right = self.ids.get(text[:k]), self.ids.get(text[k:])
                if left is not None and right is not None:
                    pairs.append((left << 32 | right, place[self.rank[text]] << 32 | i))
        pairs.sort()
        self.pairs, self.joined = np.array([*pairs, (_NONE, _NONE)], np.int64).T
        # pairs of frequent characters have a table of their own; all others have its last row and column
        self.frequent = np.full(0x110000, FREQUENT, np.int16)
        codes = np.r_[ord(_SPACE), np.arange(FREQUENT - 1)]
        self.frequent[codes] = np.arange(FREQUENT)
        symbols = np.r_[self.characters[codes], -1]
        self.table = self._waiting(symbols[:, None], symbols[None, :])

    def _waiting_characters(self, codes: np.ndarray) -> np.ndarray:
        """The same for each character and its follower, from rows of code points."""
        places = self.frequent[codes]
        out = self.table[places[:, :-1], places[:, 1:]]
        rare = (places[:, :-1] == FREQUENT) | (places[:, 1:] == FREQUENT)
        if rare.any():
            symbols = self.characters[codes]
            out[rare] = self._waiting(symbols[:, :-1][rare], symbols[:, 1:][rare])
        return out

    def _waiting(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place in the score order and merged piece, in one number, of pairs of symbols; ``_NONE`` for other pairs."""
        keys = left << 32 | right
        at = np.searchsorted(self.pairs, keys)
        return np.where((self.pairs[at] == keys) & (left >= 0) & (right >= 0), self.joined[at], _NONE)

    def merged_together(self, words: list[str], width: int) -> list[bytes]:
        """Ids (little-endian 32-bit integers) of normalised words of at most ``width`` characters."""
        n = len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        # the last column stands for the place before the first and after the last symbol
        alive = np.arange(width + 1) < sizes[:, None]
        padded = np.zeros((n, width + 1), np.uint32)
        padded[alive] = codes
        symbols = self.characters[padded]
        after = np.tile(np.arange(1, width + 2), (n, 1))
        before = np.tile(np.arange(-1, width), (n, 1))
        after[:, width], before[:, 0] = width, width
        agenda = np.full((n, width + 1), _NONE)
        agenda[:, :-1] = self._waiting_characters(padded)
        agenda[:, :-1][~alive[:, 1:]] = _NONE
        rows = np.arange(n)
        while len(rows):
            at = (agenda if len(rows) == n else agenda[rows]).argmin(axis=1)
            best = agenda[rows, at]
            left = best < _NONE
            rows, at, best = rows[left], at[left], best[left]
            gone = after[rows, at]
            follows, precedes = after[rows, gone], before[rows, at]
            symbols[rows, at] = best & 0xFFFFFFFF
            symbols[rows, gone] = -1
            alive[rows, gone] = False
            agenda[rows, gone] = _NONE
            after[rows, at], before[rows, follows] = follows, at
            for first, second in ((at, follows), (precedes, at)):
                agenda[rows, first] = np.where(
                    alive[rows, first] & alive[rows, second],
                    self._waiting(symbols[rows, first], symbols[rows, second]), _NONE,
                )
        ids = symbols[alive]
        ends = np.cumsum(alive.sum(axis=1)) * 4
        odd = np.logical_or.reduceat(ids < 0, np.r_[0, ends[:-1] // 4]) if n else []
        data, out, start = ids.astype("<i4").tobytes(), [], 0
        for end, fallback in zip(ends.tolist(), odd):
            out.append(self._expanded(ids[start // 4 : end // 4]) if fallback else data[start:end])
            start = end
        return out

    def _expanded(self, symbols: np.ndarray) -> bytes:
        """Ids of symbols, characters that are no piece as bytes."""
        ids: list[int] = []
        for symbol in symbols.tolist():
            ids.extend([symbol] if symbol >= 0 else map(self.bytes.__getitem__, chr(-1 - symbol).encode()))
        return np.array(ids, "<i4").tobytes()

    def merged(self, word: str) -> list[int]:
        """Ids of a normalised string of any length, by the agenda."""
        rank = self.rank
        symbols, n = list(word), len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [
            (r, i, len(pair)) for i in range(n - 1) if (r := rank.get(pair := symbols[i] + symbols[i + 1])) is not None
        ]
        heapq.heapify(agenda)
        while agenda:
            _, i, length = heapq.heappop(agenda)
            if not symbols[i] or (j := after[i]) == n or len(symbols[i]) + len(symbols[j]) != length:
                continue
            symbols[i] += symbols[j]
            symbols[j] = ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                pair = symbols[i] + symbols[k]
                if (r := rank.get(pair)) is not None:
                    heapq.heappush(agenda, (r, i, len(pair)))
            if (h := before[i]) >= 0:
                pair = symbols[h] + symbols[i]
                if (r := rank.get(pair)) is not None:
                    heapq.heappush(agenda, (r, h, len(pair)))
        ids: list[int] = []
        for symbol in filter(None, symbols):
            known = self.ids.get(symbol)
            if known is None:
                ids.extend(map(self.bytes.__getitem__, symbol.encode()))
            else:
                ids.append(known)
        return ids

    def learn(self, words: set[str]) -> None:
        """Encodes words that are not known yet and holds them against the library."""
        ordered = sorted(words, key=len)
        sizes = list(map(len, ordered))
        new: dict[str, bytes] = {}
        low = 0
        for width in WIDTHS:
            high = bisect_right(sizes, width)
            new |= zip(ordered[low:high], self.merged_together(ordered[low:high], width))
            low = high
        new |= ((w, np.array(self.merged(w), "<i4").tobytes()) for w in ordered[low:])
        self.known |= new
        new.pop(_SPACE, None)  # the one word without a text of its own
        if self.marked:
            texts = [w.removeprefix(_SPACE).replace(_SPACE, " ") for w in new]
            found = self.library.encode(texts, num_threads=1)
            same = np.fromiter(chain.from_iterable(found), "<i4").tobytes() == b"".join(new.values())
            if not same or [4 * n for n in map(len, found)] != list(map(len, new.values())):
                self.wrong |= {w for w, ids in zip(new, found) if np.array(ids, "<i4").tobytes() != new[w]}

    def encode(self, texts: list[str | None]) -> tuple[list[bytes], list[bool]]:
        """Ids of whole texts, the end id last, and whether the library gives the same; null is an empty text."""
        parted = [self.words.findall(self.library.normalize(text or "")) for text in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        self.learn(set().union(*parted).difference(self.known))
        ids = [b"".join(map(self.known.__getitem__, words)) + self.end for words in parted]
        if self.marked:
            return ids, [not self.wrong or self.wrong.isdisjoint(words) for words in parted]
        found = self.library.encode([text or "" for text in texts], add_eos=True, num_threads=1)
        return ids, [np.array(a, "<i4").tobytes() == b for a, b in zip(found, ids)]

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids: without control ids and the space that normalising put first."""
        surfaces = list(map(self.surface.__getitem__, ids))
        first = next((k for k, surface in enumerate(surfaces) if surface), len(surfaces))
        if first < len(surfaces) and ids[first] in self.starts:
            surfaces[first] = surfaces[first][1:]
        while surfaces and not surfaces[-1]:
            surfaces.pop()
        if b"" not in surfaces[first + 1 :]:
            return b"".join(surfaces).decode("utf-8", "byte_by_byte")
        # bytes on both sides of a control id are no character
        parts: list[list[bytes]] = [[]]
        for surface in surfaces:
            parts[-1].append(surface)
            if not surface:
                parts.append([])
        return "".join(b"".join(part).decode("utf-8", "byte_by_byte") for part in parts)


def _per_task(frame: DataFrame, needed: str, made, ddl: str) -> DataFrame:
    """The frame with new columns that ``made``, a path and a function of its pieces and a column, gives.

    The pieces and all they remember live for one task.
    """
    new = StructType.fromDDL(ddl)
    taken = {f.name.lower() for f in new}
    frame = frame.select(*[f"`{n}`" for n in frame.columns if n.lower() not in taken])
    arrow = to_arrow_schema(new)
    path, rows = made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = None
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                pieces = pieces or Pieces(path)
                part = batch.slice(start, SLICE_ROWS)
                found = rows(pieces, part.column(needed))
                arrays = [pa.array(found[f.name], f.type) if isinstance(found[f.name], list) else found[f.name] for f in arrow]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=[*part.schema.names, *arrow.names])

    return frame.mapInArrow(run, StructType([*frame.schema.fields, *new.fields]))


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """The frame with ``ids`` of every whole text, the end id last, ``n_tokens`` of them, and ``agrees``.

    ``agrees`` says whether the sentencepiece library gives the same ids for all words (for whole texts, where a model
    does more to a text than mark its spaces). Null and empty texts have the end id alone; each row, repeated ones too, keeps its place; other columns pass through, but
    for old ones named like the new. The model must lie at ``path`` on every executor.
    """

    def rows(pieces: Pieces, texts: pa.Array) -> dict:
        ids, agrees = pieces.encode(texts.to_pylist())
        counts = [len(x) // 4 for x in ids]
        values = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), values)
        return {"ids": lists, "n_tokens": counts, "agrees": agrees}

    return _per_task(docs, "text", (path, rows), "ids array<int>, n_tokens long, agrees boolean")


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """The frame with ``decoded``, the text of its ids, and ``decodes``: whether the library's decode gives the same.

    Null ids give an empty text; ids that are no piece raise an error.
    """

    def rows(pieces: Pieces, ids: pa.ListArray) -> dict:
        ids = ids.fill_null([])
        ends = np.r_[0, np.cumsum(ids.value_lengths().to_numpy())]
        flat = ids.flatten().to_numpy()
        lists = [flat[start:end].tolist() for start, end in zip(ends, ends[1:])]
        texts = [pieces.decode(x) for x in lists]
        library = [pieces.library.decode(x) if x else "" for x in lists]
        return {"decoded": texts, "decodes": [a == b for a, b in zip(texts, library)]}

    return _per_task(tokens, "ids", (path, rows), "decoded string, decodes boolean")
