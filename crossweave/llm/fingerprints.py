"""Threshold-scaled document fingerprints.

A sketch keeps every five-word shingle hash below a fixed fraction (1 / ``SCALE``) of the hash range, and the
``LEAST`` smallest hashes in any case, so that of short texts, of which the fraction would keep next to nothing,
enough is kept. Long texts have sketches of a tenth of their size. The error of a containment c is some
sqrt(c (1 - c) / n), with n the hashes of the smaller sketch up to where both are complete: 0.06 at most for texts
of like size or of a thousand words and more, 0.2 for one of a hundred words in a very long one.
Sketches of parts merge to that of the whole by union (then drop hashes over the threshold except the smallest).
Likeness is containment: the share of the smaller sketch that the other one has, which stays meaningful between
very unequal documents. It is taken below the hash up to which both sketches are complete.

Defined results: texts with fewer than five words have one shingle, all their words; texts without words have an
empty sketch, which is like another empty one (1.0) and unlike any other (0.0); null texts are empty; very long
texts are sketched whole; rows with the same doc_id follow each other in the order of their texts (null first), and
repeated rows are returned as often as they occur; a null doc_id comes last; in a table of one row the next document
is the row itself; an empty table gives an empty result; columns other than doc_id (a number) and text aren't read,
so their names can't clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossweave.llm.common import TEXT_ROWS, arrow_map, partitions

SHINGLE = 5
HASH_BITS = 40
#: One of so many hashes is kept.
SCALE = 16
#: So many of the smallest hashes are kept in any case.
LEAST = 64
#: Ranges of doc_id for each shuffle partition.
RANGES = 4
#: Word hashes held by a worker at once.
CACHE = 200_000
_MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 2**64) for k in range(SHINGLE)], dtype=np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_words = _WordHashes()


def shingle_hashes(text: str) -> np.ndarray:
    """Hashes of the shingles, of ``HASH_BITS`` bits, repeats included."""
    words = text.encode("utf-8", "surrogatepass").split()
    hashes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    mixed = np.zeros(max(0, len(words) - width + 1) if width else 0, np.uint64)
    for k in range(width):
        mixed += hashes[k : k + len(mixed)] * _MULTIPLIERS[k]
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    return mixed >> np.uint64(64 - HASH_BITS)


def sketch(text: str, scale: int = SCALE) -> np.ndarray:
    """Sorted distinct hashes below 1/scale of the range, and the least ones."""
    hashes = shingle_hashes(text)
    kept = np.unique(hashes[hashes < np.uint64(2**HASH_BITS // scale)])
    return kept if len(kept) >= LEAST else np.unique(hashes)[:LEAST]


def complete_to(values: np.ndarray, scale: int = SCALE) -> int:
    """The hash up to which a sketch has all hashes of its text."""
    return max(2**HASH_BITS // scale - 1, int(values[-1])) if len(values) >= LEAST else 2**HASH_BITS


def likeness(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Containment (of the smaller in the other) and Jaccard similarity of two sketches."""
    if not len(a) or not len(b):
        both = 1.0 if len(a) == len(b) else 0.0
        return both, both
    limit = np.uint64(min(complete_to(a), complete_to(b)))
    x, y = a[: np.searchsorted(a, limit, side="right")], b[: np.searchsorted(b, limit, side="right")]
    if not len(x) or not len(y):  # a few hashes, all above the limit
        x, y = a, b
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / min(len(x), len(y)), common / (len(x) + len(y) - common)


def render(values: np.ndarray) -> str:
    """Ten hex digits for each hash."""
    return np.ascontiguousarray(values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - HASH_BITS // 8 :]).tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many first ones of the next document, or all it has."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "jaccard_edited", "jaccard_next"]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by range, then descending doc_id; a range ends with the head of the range below it."""
    last: tuple | None = None
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.float64()]

    def row(doc: tuple, following: tuple) -> tuple:
        changed = edited(doc[2], following[2])
        other = sketch(changed)
        near, next_ = likeness(doc[3], other), likeness(doc[3], following[3])
        digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
        return doc[1], len(doc[2]), digest, render(doc[3]), render(other), near[0], next_[0], near[1], next_[1]

    for batch in batches:
        rows, size = [], 0
        kind = batch.schema.field("doc_id").type
        for bucket, tail, doc_id, text in zip(*(batch.column(n).to_pylist() for n in ("bucket", "tail", "doc_id", "text"))):
            text = text or ""
            doc = (bucket, doc_id, text, sketch(text))
            if last is not None and last[0] == bucket:
                rows.append(row(last, doc))
                size += len(rows[-1][3]) + len(rows[-1][4])
            last = None if tail else doc
            if size > 1 << 24:
                yield _batch(rows, kind, kinds)
                rows, size = [], 0
        yield _batch(rows, kind, kinds)


def _batch(rows: list[tuple], kind: pa.DataType, kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [kind, *kinds])], names=_NAMES)


def _range_of(value: Column, bounds: list[float]) -> Column:
    """How many of the sorted bounds are above a value; nulls have a range of their own, after all.

    Bounds are looked up in two steps (which group of them, then which in the group), so that a row is compared with
    some square root of them."""
    width = max(1, math.isqrt(len(bounds)))
    above = sorted(bounds, reverse=True)
    groups = [above[i : i + width] for i in range(0, len(above), width)]
    if not groups:
        return F.when(value.isNull(), F.lit(1)).otherwise(F.lit(0))
    ends = F.array(*[F.lit(float(g[-1])) for g in groups])
    fine = F.array(*[F.array(*[F.lit(float(x)) for x in g]) for g in groups])
    full = F.size(F.filter(ends, lambda x: value < x))
    rest = F.coalesce(F.size(F.filter(F.get(fine, full), lambda x: value < x)), F.lit(0))
    return F.when(value.isNull(), F.lit(len(bounds) + 1)).otherwise(full * width + F.when(full < len(groups), rest).otherwise(F.lit(len(bounds) - full * width))).cast("int")


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The order over the whole table takes one shuffle of the texts: ids are cut into ranges (quantiles of the id
    column), and the first document of each range is dealt to the range before it as well. Only the first ids
    of the ranges, some per shuffle partition, reach the driver.
    """
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    n = partitions(spark)
    bounds = sorted(set(docs.approxQuantile("doc_id", [k / (RANGES * n) for k in range(1, RANGES * n)], 1 / (16 * RANGES * n))))
    bucket = _range_of(F.col("doc_id"), bounds)
    heads = {r["b"]: r["head"] for r in docs.groupBy(bucket.alias("b")).agg(F.max("doc_id").alias("head")).collect()}
    order = sorted(heads)
    before = {b: order[i - 1] for i, b in enumerate(order)}  # the first range is what follows the last
    every = range(len(bounds) + 2)
    head = F.get(F.array(*[F.lit(heads.get(b)).cast(kind) for b in every]), F.col("bucket"))
    to = F.get(F.array(*[F.lit(before.get(b)).cast("int") for b in every]), F.col("bucket"))
    tail = F.when(head.eqNullSafe(F.col("doc_id")), F.array(F.struct(to.alias("bucket"), F.lit(True).alias("tail")))).otherwise(F.array().cast("array<struct<bucket:int,tail:boolean>>"))
    own = F.array(F.struct(F.col("bucket"), F.lit(False).alias("tail")))
    rows = docs.withColumn("bucket", bucket).select("doc_id", "text", F.explode(F.concat(own, tail)).alias("at"))
    rows = rows.select(F.col("at.bucket").alias("bucket"), F.col("at.tail").alias("tail"), "doc_id", "text")
    dealt = rows.repartition(n, "bucket").sortWithinPartitions("bucket", "tail", F.desc_nulls_last("doc_id"), "text")
    return arrow_map(dealt, _measure, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, jaccard_edited double, jaccard_next double", TEXT_ROWS)
