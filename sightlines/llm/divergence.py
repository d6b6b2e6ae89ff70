"""Quality rules by distribution divergence.

Every document has two histograms: characters by class and words by a list of common words. Each is compared with
the reference of the document's language, the sum over all documents of that language, by the Jensen-Shannon
distance. Short documents say little about a distribution and are held to the base rules alone.
"""

from __future__ import annotations

import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import appended, stored

#: Frequent function words of four languages.
COMMON_WORDS = {
    "en": "the of and to in a is that for it was on are as with be by this he at from or an not they which but".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se avec ce".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o".split(),
}
#: Character classes: letters by case, other letters, digits, white space, sentence marks, other marks, symbols, rest.
CLASSES = 8
#: Documents of fewer words, or fewer common words, are not judged by that histogram.
LEAST_WORDS, LEAST_COMMON = 60, 25
#: Greatest distances of a document that is kept.
CLASS_DISTANCE, WORD_DISTANCE = 0.28, 0.72

#: Languages up to which their references (a kilobyte or two each) are broadcast; more of them are joined by shuffle.
BROADCAST_LANGUAGES = 2_000

_WORDS = sorted({w for words in COMMON_WORDS.values() for w in words})
_PLACE = {w.encode(): i for i, w in enumerate(_WORDS)}
_SYMBOLS = b"#*$%&|<>"


def _class_of(code: int) -> int:
    category = unicodedata.category(chr(code))
    if category in ("Lu", "Lt"):
        return 1
    if category[0] in "LM":
        return 0 if category == "Ll" else 2
    if category[0] == "N":
        return 3
    if category[0] == "Z" or code in (9, 10, 11, 12, 13):
        return 4
    if chr(code) in ".,;:!?'\"()-":
        return 5
    return 6 if category[0] == "P" or chr(code) in "#*$%&|<>@/\\_" else 7


_CLASS = np.array([_class_of(c) for c in range(0x10000)], np.uint8)


def class_counts(text: str) -> np.ndarray:
    """Characters by class; characters beyond the basic plane are of the last."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.bincount(_CLASS[np.where(codes < 0x10000, codes, 0xE000)], minlength=CLASSES)


def _repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    n = len(number)
    _, pair = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)
    _, window, count = np.unique(pair[:-1] * n + ids[2:], return_inverse=True, return_counts=True)
    twice = np.flatnonzero(count[window] > 1)
    marks = np.zeros(len(words), bool)
    for k in range(3):
        marks[twice + k] = True
    return int(marks.sum())


def _measured(text: str | None) -> dict:
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    seen: set[bytes] = set()
    dup = 0
    for line in data.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    counts = class_counts(text)
    common = [0] * len(_WORDS)
    for word, n in Counter(data.lower().translate(None, b".,;:!?\"()").split()).items():
        if (place := _PLACE.get(word)) is not None:
            common[place] += n
    breaks = sum(map(data.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    return {
        "n_words": len(words),
        "word_chars": len(text) - breaks,
        "n_symbols": sum(data.count(bytes([s])) for s in _SYMBOLS),
        "n_dup_lines": dup,
        "n_repeat_words": _repeat_words(words),
        "classes": counts.tolist(),
        "common": common,
    }


def measures(docs: DataFrame) -> DataFrame:
    """Base counts and both histograms of every document row; null texts count as empty."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "common")

    def rows(columns: dict) -> dict:
        found = [_measured(text) for text in columns["text"]]
        return {k: [f[k] for f in found] for k in names}

    made = appended(
        docs.select("doc_id", "text", "lang"), ["text"], rows,
        ", ".join(f"{n} long" for n in names[:5]) + ", classes array<long>, common array<long>",
    )
    return made.drop("text")


def _sums(column: str, size: int):
    return F.array(*[F.coalesce(F.sum(F.col(column)[i]), F.lit(0)).cast("double") for i in range(size)]).alias(column)


def _shares(column: str) -> str:
    """Counts as shares of their sum; an empty histogram stays at zero."""
    return f"transform({column}, x -> x / greatest(aggregate({column}, 0D, (a, x) -> a + x), 1D))"


def _distance(left: str, right: str) -> str:
    """Jensen-Shannon distance of two arrays of shares, logarithms to base 2: 0 to 1."""
    term = "if({0} > 0, {0} * log2(2 * {0} / (l + r)), 0D)"
    terms = f"zip_with({left}, {right}, (l, r) -> {term.format('l')} + {term.format('r')})"
    return f"sqrt(greatest(0D, 0.5D * aggregate({terms}, 0D, (a, x) -> a + x)))"


def judged(docs: DataFrame) -> DataFrame:
    """Per document row: base counts, class_distance and word_distance to the language's reference, base_failed, kept.

    References are sums over all rows of a language, null being a language of its own. A histogram is judged only
    with ``LEAST_WORDS`` words, or ``LEAST_COMMON`` common words; below, its distance is null and speaks for keeping.
    """
    found = stored(measures(docs), "measures")
    reference = found.groupBy("lang").agg(_sums("classes", CLASSES), _sums("common", len(_WORDS)))
    reference = reference.select(
        F.col("lang").alias("ref_lang"),
        F.expr(_shares("classes")).alias("ref_classes"),
        F.expr(_shares("common")).alias("ref_common"),
    )
    reference = stored(reference, "reference")
    if reference.count() <= BROADCAST_LANGUAGES:
        reference = F.broadcast(reference)
    shares = found.withColumns({"p": F.expr(_shares("classes")), "q": F.expr(_shares("common"))})
    joined = shares.join(reference, F.expr("lang <=> ref_lang"), "left")
    n_common = "aggregate(common, 0L, (a, x) -> a + x)"
    return (
        joined.withColumn(
            "class_distance", F.expr(f"if(n_words >= {LEAST_WORDS}, {_distance('p', 'ref_classes')}, NULL)")
        )
        .withColumn(
            "word_distance", F.expr(f"if({n_common} >= {LEAST_COMMON}, {_distance('q', 'ref_common')}, NULL)")
        )
        .withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))
        .withColumn(
            "kept",
            F.expr(
                f"NOT base_failed AND coalesce(class_distance <= {CLASS_DISTANCE}, true)"
                f" AND coalesce(word_distance <= {WORD_DISTANCE}, true)"
            ),
        )
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
            "class_distance", "word_distance",
        )
    )
