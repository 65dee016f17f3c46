"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are whether a text has a word, a pair of neighbouring words, or a pair with one word between, each
hashed to one of ``2 ** BITS`` coordinates. Every coordinate has its own learning rate, and an L1 penalty leaves
most weights at zero, so the model is a short list that is broadcast (``2 ** BITS`` entries at most, whatever
the input).

The model is fitted on a bounded sample of labelled rows: at most ``MAX_POSITIVE`` and ``MAX_NEGATIVE`` of those
whose crc32(doc_id) mod 4 is not 2, least hash of the id first. The intercept is corrected for the shares of the
classes in all such labels. One task sees the sample's features, several times over; every text is scored.

Defined results: null and empty texts have no features and score what the intercept gives; very long texts are
scored whole; without any labelled rows of both classes every text scores the share of positive labels (0 if there
are none); rows with a null doc_id are never in the sample and not held out; labels other than 0 and 1 are not read;
a doc_id with several labels or rows counts with each of them, and repeated rows are returned as often as they
occur; equal texts have equal scores; an empty table gives an empty result; ``score`` reads doc_id and text only,
and ``keep_clean`` carries all other columns whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossweave.llm.common import TEXT_ROWS, arrow_map, texts

BITS = 20
MAX_POSITIVE = 6_000
MAX_NEGATIVE = 10_000
#: Features of the sample that are held at once (some 160 MB); the sample, which comes in order of a hash, ends where they are full.
MAX_FEATURES = 40_000_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 1.0
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
#: Words held by a worker at once.
CACHE = 150_000
_U = np.uint64
#: Odd multipliers, one for each place in a feature.
_PLACES = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


class _WordHashes(dict):
    """Hashes of words in lower case without marks at their ends."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        inner = word.lower()
        a, b = 0, len(inner)
        while a < b and not inner[a].isalnum():
            a += 1
        while b > a and not inner[b - 1].isalnum():
            b -= 1
        self[word] = value = xxhash.xxh64_intdigest((inner[a:b] or inner).encode("utf-8", "surrogatepass"))
        return value


_words = _WordHashes()


def features(text: str) -> np.ndarray:
    """Coordinates of a text's features, with repeats."""
    words = text.split()
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    parts = [h * _PLACES[0]]
    for gap in (1, 2):
        mixed = (h[:-gap] * _PLACES[0]) ^ ((h[gap:] + _U(gap)) * _PLACES[gap])
        parts.append((mixed ^ (mixed >> _U(29))) * _PLACES[1])
    return (np.concatenate(parts) >> _U(64 - BITS)).astype(np.int32)


class Ftrl:
    """FTRL-proximal (McMahan et al., 2013) for 0/1 features."""

    def __init__(self, size: int = 1 << BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.bias_z, self.bias_n = 0.0, 0.0

    def _weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return -np.sign(z) * np.maximum(np.abs(z) - self.l1, 0) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def bias(self) -> float:
        return -self.bias_z / ((self.beta + math.sqrt(self.bias_n)) / self.alpha)

    def learn(self, at: np.ndarray, label: int) -> None:
        z, n = self.z[at], self.n[at]
        w, b = self._weights(z, n), self.bias()
        gradient = sigmoid(b + float(w.sum())) - label
        square = gradient * gradient
        self.z[at] = z + gradient - (np.sqrt(n + square) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + square
        self.bias_z += gradient - (math.sqrt(self.bias_n + square) - math.sqrt(self.bias_n)) / self.alpha * b
        self.bias_n += square

    def sparse(self) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates and weights that aren't zero."""
        w = self._weights(self.z, self.n)
        at = np.flatnonzero(w)
        return at.astype(np.int32), w[at]


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def fit(examples: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> Ftrl:
    """Several passes, each in another fixed order."""
    model = Ftrl()
    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(examples)):
            model.learn(*examples[i])
    return model


class Scorer:
    """The weights as a table, for a worker."""

    def __init__(self, at: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.table = np.zeros(1 << BITS)
        self.table[at] = weights
        self.some = self.table != 0
        self.bias = bias

    def score(self, text: str) -> float:
        if not text:
            return sigmoid(self.bias)
        found = features(text)
        return sigmoid(self.bias + float(self.table[np.unique(found[self.some[found]])].sum()))


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def sample(labels: DataFrame) -> DataFrame:
    """doc_id, label: the bounded sample of labels that may be learnt from."""
    fold = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % FOLDS
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold != HELD_OUT))
    part = lambda label, most: known.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return part(1, MAX_POSITIVE).union(part(0, MAX_NEGATIVE))


def train(docs: DataFrame, labels: DataFrame) -> Scorer | float:
    """A scorer, or the share of positive labels if only one class has labels."""
    fold = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % FOLDS
    counts = {r["toxic"]: r["count"] for r in labels.filter(fold != HELD_OUT).filter(F.col("toxic").isin(0, 1)).groupBy("toxic").count().collect()}
    positive, negative = counts.get(1, 0), counts.get(0, 0)
    if not positive or not negative:
        return 1.0 if positive else 0.0
    # The sample has a fixed bound of some thousand ids, so it may be broadcast and its model come back.
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample(labels)), "doc_id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(features(x)).tobytes() for x in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("label"), pa.array(found, pa.binary())], names=["place", "label", "found"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ends, known = bytearray(), [0], []  # one block of memory, which goes back as a whole
        full = False
        for batch in batches:
            for found, label in zip(batch.column("found").to_pylist(), batch.column("label").to_pylist()):
                full = full or ends[-1] + len(found) // 4 > MAX_FEATURES  # shorter texts that would still fit must not be favoured
                if not full:
                    held += found
                    ends.append(ends[-1] + len(found) // 4)
                    known.append(label)
        flat = np.frombuffer(held, np.int32)
        examples = [(flat[a:b], y) for a, b, y in zip(ends, ends[1:], known)]
        if examples:
            model = fit(examples)
            at, weights = model.sparse()
            seen = sum(y for _, y in examples)
            # Sampling classes at different rates moves the intercept by the log of the rates' ratio.
            bias = model.bias() - math.log(max(seen, 1) / positive) + math.log(max(len(examples) - seen, 1) / negative)
            yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([bias, *weights.tolist()], pa.float64())], names=["at", "weight"])

    # Texts are read where they are; the features of the bounded sample meet in one task.
    made = arrow_map(chosen.select(F.xxhash64("doc_id").alias("place"), "label", "text"), read, "place long, label int, found binary", TEXT_ROWS)
    rows = arrow_map(made.repartition(1).sortWithinPartitions("place", "label", "found"), learn, "at int, weight double", TEXT_ROWS).collect()
    if not rows:
        return positive / (positive + negative)
    weights = {r["at"]: r["weight"] for r in rows}
    bias = weights.pop(-1)
    at = sorted(weights)
    return Scorer(np.array(at, np.int32), np.array([weights[a] for a in at]), bias)


def _scoring(docs: DataFrame, labels: DataFrame):
    """A function from text to score, for the workers."""
    model = train(docs, labels)
    if isinstance(model, float):
        return lambda: lambda text: model
    at = np.flatnonzero(model.some).astype(np.int32)
    shared = docs.sparkSession.sparkContext.broadcast((at, model.table[at], model.bias))
    return lambda: Scorer(*shared.value).score


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    make = _scoring(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = make()
        for batch in batches:
            ids = batch.column("doc_id")
            scores = [scorer(x) for x in texts(batch.column("text"))]
            columns = [ids, pa.array([held_out(x) for x in ids.to_pylist()], pa.bool_()), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, held_out boolean, score double, predicted int", TEXT_ROWS)


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those predicted toxic; all columns stay."""
    make = _scoring(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = make()
        for batch in batches:
            yield batch.filter(pa.array([scorer(x) < THRESHOLD for x in texts(batch.column("text"))], pa.bool_()))

    return arrow_map(docs, run, docs.schema, TEXT_ROWS)
