"""Small tables with odd rows, and plain versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

LOWER = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that clash with names used inside the operators.
CLASHING = ", digest string, class string, key string, score string, n_words string, spans string, ids string, KEPT string"


def prose(random_: random.Random, words: int, size: int = 4000) -> str:
    return " ".join(f"w{random_.randrange(size)}" for _ in range(words))


def changed(random_: random.Random, text: str, words: int) -> str:
    parts = text.split(" ")
    for _ in range(words):
        parts[random_.randrange(len(parts))] = f"x{random_.randrange(10**6)}"
    return " ".join(parts)


def documents() -> list[tuple]:
    """Copies, near copies, shared passages, nulls, empty, one-word and very long texts, repeated rows."""
    r = random.Random(5)
    texts: list[tuple] = []
    family = [prose(r, n) for n in (60, 120, 300)]
    for text in family:
        texts += [text, text, changed(r, text, 1), changed(r, text, 2), changed(r, text, 6), text.upper()]
    shared = prose(r, 70)
    texts += [f"{prose(r, 90)} {shared} {prose(r, 40)}" for _ in range(5)]
    line = prose(r, 12)
    texts += [f"{prose(r, 50)}\n{line}\n{prose(r, 50)}" for _ in range(8)]
    texts += ["", " \n\t ", None, "one", "one", "one two three", "same " * 300, "same " * 200, "é" * 5000, prose(r, 20000)]
    texts += ["a\x00b   c d", "😀 " * 60]
    rows = [(i * 3, t, "en" if i % 3 else None, "s", len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[0], rows[0], (None, family[0], None, None, None), (None, None, None, None, None)]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def components(rows: list[tuple]) -> dict[int, tuple[int, int]]:
    """Size of the shingle set and smallest linked id of every document, by comparing all pairs."""
    sets = {}
    for doc, text, *_ in rows:
        if doc is not None:
            w = words(text)
            n = min(5, len(w))
            sets[doc] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def contamination(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows: dict[tuple, set] = {}
    for item, text in items:
        w = word.findall((text or "").translate(LOWER))
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w and item is not None else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text, *_ in docs:
        w = word.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= x
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def base_rules(text) -> tuple:
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    triples = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    marked = {i + k for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for part in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", part):
            dup += part in seen
            seen.add(part)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(w), sum(map(len, w)), symbols, dup, len(marked), len(w) < 50 or 100 * len(marked) > 50 * len(w)
