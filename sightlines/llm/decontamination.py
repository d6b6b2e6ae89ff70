"""Benchmark decontamination by winnowing.

Of every run of consecutive k-gram hashes the smallest is kept, so texts that share a span of ``k + run - 1`` words
share a kept hash at the same place of the span. Kept hashes of the documents meet those of the test items; each
hit is extended to the left and right as long as the words agree, and counts when it spans a whole test window.

The test items are a stated query set: they are cut into overlapping segments and read in blocks of at most
``BLOCK_WORDS`` words, each of which meets all documents. One block is what an executor holds; more test items give
more blocks, not a larger one.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import appended, hashed, kept_apart, runs_of

#: Words of a window of a test item.
WINDOW_WORDS = 13
#: Words of a k-gram; windows of fewer words are one k-gram.
GRAM_WORDS = 8
#: Words of test items that a block holds, about.
BLOCK_WORDS = 2_000_000
#: Windows of a segment; longer items are cut into segments that overlap by a window less a word.
SEGMENT_WINDOWS = 20_000

_SPANS_DDL = "n_words long, spans array<struct<start:int,end:int>>, items array<long>"
_WORD_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


def alnum_words(text: str | None) -> list[bytes]:
    """Words of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


def kept_places(grams: np.ndarray, run: int) -> np.ndarray:
    """Places of the smallest hash of every ``run`` consecutive ones, the rightmost of equals; sorted.

    A sequence shorter than the run keeps its smallest.
    """
    n = len(grams)
    if not n:
        return np.empty(0, np.int64)
    run = min(run, n)
    windows = np.lib.stride_tricks.sliding_window_view(grams, run)
    return np.unique(np.arange(n - run + 1) + run - 1 - windows[:, ::-1].argmin(axis=1))


class Block:
    """Segments of test items with their fingerprints, by window length."""

    def __init__(self, segments: list[tuple[object, list[bytes]]]):
        self.items = [item for item, _ in segments]
        self.hashes = [hashed(words) for _, words in segments]
        by_length: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for number, hashes in enumerate(self.hashes):
            length = min(WINDOW_WORDS, len(hashes))
            gram = min(GRAM_WORDS, length)
            grams = runs_of(hashes, gram)
            places = kept_places(grams, length - gram + 1)
            by_length.setdefault(length, []).append((grams[places], np.full(len(places), number), places))
        self.prints = {}
        for length, parts in by_length.items():
            values, numbers, places = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(values, kind="stable")
            self.prints[length] = (values[order], numbers[order], places[order])

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, set]:
        """Marks of the words inside an occurring window, and the items with occurring windows."""
        marks, found = np.zeros(len(hashes) + 1, np.int64), set()
        grams_of: dict[int, np.ndarray] = {}
        for length, (values, numbers, places) in self.prints.items():
            if len(hashes) < length:
                continue
            gram = min(GRAM_WORDS, length)
            if gram not in grams_of:
                grams_of[gram] = runs_of(hashes, gram)
            grams = grams_of[gram]
            kept = kept_places(grams, length - gram + 1)
            low = np.searchsorted(values, grams[kept], "left")
            high = np.searchsorted(values, grams[kept], "right")
            seen: dict[tuple[int, int], int] = {}
            for at, a, b in zip(kept[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist()):
                for number, place in zip(numbers[a:b].tolist(), places[a:b].tolist()):
                    if at < seen.get((number, at - place), 0):
                        continue
                    start, end = _extended(hashes, at, self.hashes[number], place, gram)
                    seen[number, at - place] = end
                    if end - start >= length:
                        marks[start] += 1
                        marks[end] -= 1
                        found.add(self.items[number])
        return np.cumsum(marks[:-1]) > 0, found


def _extended(left: np.ndarray, at: int, right: np.ndarray, place: int, size: int) -> tuple[int, int]:
    """The longest span of the left sequence around a common k-gram that agrees with the right one."""
    back = min(at, place)
    other = np.flatnonzero(left[at - back : at] != right[place - back : place])
    start = at - back + int(other[-1]) + 1 if len(other) else at - back
    ahead = min(len(left) - at, len(right) - place)
    other = np.flatnonzero(left[at : at + ahead] != right[place : place + ahead])
    end = at + int(other[0]) if len(other) else at + ahead
    return (start, end) if end - at >= size else (at, at)


def _segments(items: Iterator[tuple[object, str | None]]) -> list[tuple[object, list[bytes]]]:
    out = []
    for item, text in items:
        words = alnum_words(text)
        for start in range(0, max(1, len(words) - WINDOW_WORDS + 1) if words else 0, SEGMENT_WINDOWS):
            out.append((item, words[start : start + SEGMENT_WINDOWS + WINDOW_WORDS - 1]))
    return out


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The segments of the test items, streamed to the driver and packed into bounded blocks."""
    block, words = [], 0
    rows = benchmark.select("item_id", "text").filter("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    for row in rows.toLocalIterator():
        for segment in _segments([(row.item_id, row.text)]):
            block.append(segment)
            words += len(segment[1])
            if words >= BLOCK_WORDS:
                yield block
                block, words = [], 0
    yield block


def hit_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents with n_words, spans array<struct<start,end>> of hit words and items array<long>.

    Spans are maximal, in order, and count words from 0, end excluded. Null texts have no words; null, repeated or
    empty items add nothing; every row of the documents gives one row, other columns pass through.
    """
    spark = docs.sparkSession

    def scanned(frame: DataFrame, packed, more: bool) -> DataFrame:
        state: dict = {}

        def rows(columns: dict) -> dict:
            if "block" not in state:
                state["block"] = Block(pickle.loads(packed.value))
            out = {"n_words": [], "spans": [], "items": []}
            for number, text in enumerate(columns["text"]):
                words = alnum_words(text)
                marks, found = state["block"].hits(hashed(words))
                if more:
                    for span in columns["spans"][number]:
                        marks[span["start"] : span["end"]] = True
                    found |= set(columns["items"][number])
                edges = np.flatnonzero(np.diff(np.concatenate(([0], marks.view(np.int8), [0]))))
                out["n_words"].append(len(words))
                out["spans"].append([{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()])
                out["items"].append(sorted(found))
            return out

        if more:  # what earlier blocks have found travels under names of its own
            frame = frame.withColumnsRenamed({"spans": "_spans", "items": "_items"})
            needed = {"text": "text", "_spans": "spans", "_items": "items"}
            return appended(
                frame, list(needed), lambda c: rows({needed[k]: v for k, v in c.items()}), _SPANS_DDL
            ).drop("_spans", "_items")
        return appended(frame, ["text"], rows, _SPANS_DDL)

    out, more = docs, False
    for block in _blocks(benchmark):
        out, more = scanned(out, spark.sparkContext.broadcast(pickle.dumps(block)), more), True
    return out


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents with n_words, n_hit, n_items, items (ids), spans and contaminated.

    A document is contaminated when a twentieth of its words or more are hit.
    """
    found = hit_spans(docs, benchmark)
    return found.withColumns(
        {
            "n_hit": F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)"),
            "n_items": F.size("items").cast("long"),
        }
    ).withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, all columns kept."""
    docs, back = kept_apart(docs, "n_words spans items n_hit n_items contaminated _spans _items")
    return contamination(docs, benchmark).filter("NOT contaminated").select(*back)
