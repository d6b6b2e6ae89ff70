"""Toxicity by a factorization machine over hashed terms.

A document is the set of its terms (words and word beginnings), hashed to ``2 ** HASH_BITS`` places. The score is the
logistic function of a bias, one weight per term and, for each pair of terms, the product of their vectors, so pairs
of terms count for more or less than their terms do alone.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import REMEMBERED_WORDS, appended, exploded, kept_apart, task_cache

#: Places of the hashed terms, as a power of two, and entries of a term's vector.
HASH_BITS, RANK = 18, 4
#: Labelled rows that the model is fitted on, about; a larger set of labels is sampled by a hash of the id.
SAMPLE_ROWS = 12_000
#: Characters of the word beginnings that are terms of their own.
BEGINNINGS = (3, 4, 5)
#: Documents of the sample that a term must occur in to have a weight.
LEAST_DOCUMENTS = 8
#: Chi-square that a term's link with the label must reach to have a weight.
LEAST_CHI_SQUARE = 30.0
#: Score from which a document counts as toxic.
THRESHOLD = 0.3
EPOCHS, BATCH_ROWS, RATE, SHRINK = 10, 64, 0.1, 1e-4

_STRIPPED = b".,;:!?\"'()[]|*#$%&<>-"


class _Terms(dict):
    """Places of a word's terms as 32-bit integers in one byte string, remembered up to a bound."""

    def __missing__(self, word: bytes) -> bytes:
        mask = (1 << HASH_BITS) - 1
        text = word.decode("utf-8", "replace").lower()
        terms = [text] + [f"{text[:n]}~" for n in BEGINNINGS if len(text) >= n]
        places = np.array([xxhash.xxh3_64_intdigest(t) & mask for t in terms], np.int32).tobytes()
        if len(self) < REMEMBERED_WORDS:
            self[word] = places
        return places


_TERMS = task_cache(_Terms())


def terms(text: str | None) -> np.ndarray:
    """Places of a text's distinct terms, sorted; none for null."""
    words = {w.strip(_STRIPPED) for w in set(text.encode("utf-8", "surrogatepass").lower().split())} if text else set()
    words.discard(b"")
    return np.unique(np.frombuffer(b"".join(map(_TERMS.__getitem__, words)), np.int32))


@dataclass
class Machine:
    """Bias, weights and vectors of a factorization machine."""

    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def score(self, places: np.ndarray) -> float:
        """Between 0 and 1; the bias alone for a document without terms."""
        vectors = self.vectors[places]
        sums = vectors.sum(axis=0)
        value = self.bias + self.weights[places].sum() + 0.5 * float(sums @ sums - np.einsum("ij,ij->", vectors, vectors))
        return float(1 / (1 + np.exp(-np.clip(value, -40, 40))))


def _telling(samples: list[np.ndarray], labels: np.ndarray, size: int) -> np.ndarray:
    """Terms that are frequent enough and depend on the label by a chi-square test; the others would only be learnt by heart."""
    places = np.concatenate(samples)
    count = np.bincount(places, minlength=size)
    toxic = np.bincount(places, np.repeat(labels, [len(s) for s in samples]), size)
    share = labels.mean()
    expected = np.maximum(count * share * (1 - share) * (1 - count / len(samples)), 1e-9)
    return (count >= LEAST_DOCUMENTS) & ((toxic - count * share) ** 2 / expected >= LEAST_CHI_SQUARE)


def fitted(samples: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Machine:
    """A machine fitted by stochastic gradients with a rate per parameter; without both labels it knows the bias only."""
    size = 1 << HASH_BITS
    share = float(labels.mean()) if len(labels) else 0.0
    bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    machine = Machine(bias, np.zeros(size, np.float32), np.zeros((size, RANK), np.float32))
    if not 0 < share < 1:
        return machine
    known = _telling(samples, labels, size)
    samples = [s[known[s]] for s in samples]
    random = np.random.default_rng(seed)
    machine.vectors[known] = random.normal(0, 0.05, (int(known.sum()), RANK))
    seen_w, seen_v, seen_b = np.full(size, 1e-2, np.float32), np.full((size, RANK), 1e-2, np.float32), 1e-2
    for _ in range(EPOCHS):
        order = random.permutation(len(samples))
        for start in range(0, len(order), BATCH_ROWS):
            batch = order[start : start + BATCH_ROWS].tolist()
            rows = [r for r in batch if len(samples[r])]
            bare = [r for r in batch if not len(samples[r])]  # these bear on the bias alone
            slope = float(np.sum(1 / (1 + np.exp(-machine.bias)) - labels[bare])) if bare else 0.0
            if rows:
                slope += _stepped(machine, [samples[r] for r in rows], labels[rows], seen_w, seen_v)
            slope /= len(batch)
            seen_b += slope**2
            machine.bias -= RATE * slope / seen_b**0.5
    return machine


def _stepped(machine: Machine, samples: list, labels: np.ndarray, seen_w: np.ndarray, seen_v: np.ndarray) -> float:
    """One step of the weights and vectors against the error; the sum of the errors."""
    w, v = machine.weights, machine.vectors
    lengths = np.array(list(map(len, samples)))
    places = np.concatenate(samples)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    vectors = v[places]
    sums = np.add.reduceat(vectors, starts)
    value = machine.bias + np.add.reduceat(w[places], starts) + 0.5 * (
        (sums**2).sum(axis=1) - np.add.reduceat((vectors**2).sum(axis=1), starts)
    )
    error = 1 / (1 + np.exp(-np.clip(value, -40, 40))) - labels
    each = np.repeat(error, lengths).astype(np.float32)
    at, where = np.unique(places, return_inverse=True)
    slope_w = np.bincount(where, each, len(at)) / len(samples) + SHRINK * w[at]
    slope_v = (np.repeat(sums, lengths, axis=0) - vectors) * each[:, None]
    slope_v = np.stack([np.bincount(where, slope_v[:, k], len(at)) for k in range(RANK)], axis=1)
    slope_v = slope_v / len(samples) + SHRINK * v[at]
    seen_w[at] += slope_w**2
    seen_v[at] += slope_v**2
    w[at] -= RATE * slope_w / np.sqrt(seen_w[at])
    v[at] -= RATE * slope_v / np.sqrt(seen_v[at])
    return float(error.sum())


def accepted(docs: DataFrame, machine: Machine) -> DataFrame:
    """The documents that aren't predicted toxic, all columns kept."""
    docs, back = kept_apart(docs, "score predicted")
    return scored(docs, machine).filter("predicted = 0").select(*back)


def held_out(column: str = "doc_id") -> F.Column:
    """Ids whose labels are never learnt from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2


def learnt(docs: DataFrame, labels: DataFrame) -> Machine:
    """A machine fitted on a bounded sample of labelled documents that aren't held out.

    Rows without id or label are left out; of several labels of one document the greatest counts. Only the terms'
    places and the labels of about ``SAMPLE_ROWS`` rows reach the driver; the sampled ids are broadcast.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out())
    known = known.groupBy("doc_id").agg(F.max(F.expr("if(toxic > 0, 1, 0)")).alias("toxic"))
    share = SAMPLE_ROWS / max(known.count(), SAMPLE_ROWS)
    sample = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic")

    def rows(columns: dict) -> dict:
        return {"places": [terms(t).tolist() for t in columns["text"]], "toxic": columns["toxic"]}

    table = exploded(chosen, rows, "places array<int>, toxic int").toArrow()
    places = [np.array(x.values.to_numpy(), np.int32) for x in table["places"]]
    # the order of rows that the cluster returns is not fixed; the fit must not depend on it
    order = sorted(range(len(places)), key=lambda i: (len(places[i]), places[i].tobytes()))
    targets = table["toxic"].to_numpy().astype(np.float32)
    return fitted([places[i] for i in order], targets[order] if len(order) else targets)


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """The documents with score (0 to 1) and predicted (1 from ``THRESHOLD`` on); null texts score as empty ones."""
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(machine))
    state: dict = {}

    def rows(columns: dict) -> dict:
        if "machine" not in state:
            state["machine"] = pickle.loads(packed.value)
        return {"score": [state["machine"].score(terms(t)) for t in columns["text"]]}

    return appended(docs, ["text"], rows, "score double").withColumn(
        "predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0)
    )
