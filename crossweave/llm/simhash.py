"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints of 64 bits are linked at three or fewer differing bits. Of ``bands`` bands of bits, two such
fingerprints agree in all but three, so each distinct fingerprint goes to the tries of every choice of so many
bands (their bits are the path to the trie's root): four tries by 16 bits for few fingerprints, ten by 25, twenty
by 32 or thirty-five by 36 for more, so that tries stay small whatever the number (``scheme``). In a trie, pairs
of nodes are walked together from the root; each split adds to the bits that differ, and a pair over the budget is
left. A task returns a spanning forest of the links it finds, never all pairs; the forests are joined to
components by star contraction.

A trie with more than ``MAX_GROUP`` fingerprints is cut into blocks, and each pair of blocks is a task of its own:
nothing is dropped and no task grows with the group.

Defined results: null and empty texts have fingerprint zero and are linked like any other; very long texts are
read whole, in bounded memory beside the text; repeated rows and equal texts share a fingerprint; rows that share a
doc_id are linked by their texts alone; the component of rows without any doc_id is null; an empty table gives an
empty result; other columns than doc_id and text aren't read by ``components`` and are carried by ``keep_one``
whatever their names (names that differ by case alone aside).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossweave.llm.common import TEXT_ROWS, arrow_map, cut, partitions, texts, unused
from crossweave.llm.components import roots

SEED = 42
SHINGLE = 3
BUDGET = 3
#: (bands, bands that agree), from short paths to long ones.
SCHEMES = tuple((BUDGET + agree, agree) for agree in (1, 2, 3, 4))
#: Evenly spread fingerprints that a trie may have before paths get longer.
EVEN_GROUP = 256
#: Fingerprints in a task's trie, unless the trie has fewer.
MAX_GROUP = 8192
#: Node pairs with at most so many pairs of leaves are compared leaf by leaf.
LEAF_PAIRS = 16
#: Rows of whole tries that a task holds at once.
CHUNK_ROWS = 1 << 18


def shingles(text: str) -> list[bytes]:
    """Three-word shingles, repeats included; all words if there are fewer; A-Z are lower-cased."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) < SHINGLE:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(words, words[1:], words[2:])))


def fingerprint(text: str) -> int:
    """A bit is 1 if more than half of the shingles' XXH64 have it."""
    parts = shingles(text)
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(x, SEED) for x in parts], dtype="<u8")
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded, however long the text
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(x) for x in texts(batch.column("text"))], dtype=np.uint64)
        others = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in others), pa.array(prints.view(np.int64))], names=[*others, "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` with fp (the 64 bits as a signed long) in place of text."""
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return arrow_map(docs, _fingerprints, f"{kept}, fp long", TEXT_ROWS)


def trie_pairs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) within ``budget`` bits inside each range of ``values``, which is sorted within ranges."""
    a_lo, a_hi, b_lo, b_hi = starts, ends, starts, ends
    diff = np.zeros(len(starts), np.int8)
    for bit in range(63, -2, -1):
        leaf = np.ones(len(a_lo), bool) if bit < 0 else (a_hi - a_lo) * (b_hi - b_lo) <= LEAF_PAIRS
        if leaf.any():
            yield from _leaves(values, a_lo[leaf], a_hi[leaf], b_lo[leaf], b_hi[leaf], budget)
            a_lo, a_hi, b_lo, b_hi, diff = (x[~leaf] for x in (a_lo, a_hi, b_lo, b_hi, diff))
        if not len(a_lo):
            return
        ones = np.concatenate(([0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
        a_mid, b_mid = a_hi - (ones[a_hi] - ones[a_lo]), b_hi - (ones[b_hi] - ones[b_lo])
        own = a_lo == b_lo
        children = [
            (a_lo, a_mid, b_lo, b_mid, diff, slice(None)),
            (a_mid, a_hi, b_mid, b_hi, diff, slice(None)),
            (a_lo, a_mid, b_mid, b_hi, diff + 1, slice(None)),
            (a_mid, a_hi, b_lo, b_mid, diff + 1, ~own),  # a node with itself has this pair already
        ]
        parts = []
        for *five, which in children:
            five = [x[which] for x in five]
            alive = (five[0] < five[1]) & (five[2] < five[3]) & (five[4] <= budget)
            parts.append([x[alive] for x in five])
        a_lo, a_hi, b_lo, b_hi, diff = (np.concatenate(x) for x in zip(*parts))


def _leaves(values, a_lo, a_hi, b_lo, b_hi, budget):
    wide = b_hi - b_lo
    size = (a_hi - a_lo) * wide
    total, at = np.cumsum(size), 0
    while at < len(size):
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 20), side="right")))
        n = size[at:upto]
        which = np.repeat(np.arange(at, upto), n)
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        i, j = a_lo[which] + step // wide[which], b_lo[which] + step % wide[which]
        near = (np.bitwise_count(values[i] ^ values[j]) <= budget) & (i != j)
        i, j = i[near], j[near]
        yield np.minimum(i, j), np.maximum(i, j)
        at = upto


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index connected with each of n indices."""
    label = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = label[i], label[j]
            open_ = a != b
            if not open_.any():
                break
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := label[label], label):
                label = up
    return label


def _link_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by trie and fingerprint; a trie never spans two chunks."""
    held: list[tuple[np.ndarray, ...]] = []
    names = ("trie", "fp", "node")

    def links(tries: np.ndarray, prints: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
        values = prints.view(np.uint64)
        cuts = np.flatnonzero(np.concatenate(([True], tries[1:] != tries[:-1])))
        ends = np.append(cuts[1:], len(tries))
        many = ends - cuts > 1
        label = forest(len(values), trie_pairs(values, cuts[many], ends[many]))
        linked = np.flatnonzero(label != np.arange(len(values)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(nodes[label[linked]])], names=["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(tuple(batch.column(n).to_numpy(zero_copy_only=False) for n in names))
        if sum(len(x[0]) for x in held) >= CHUNK_ROWS:
            rows = [np.concatenate(x) for x in zip(*held)]
            last = int(np.searchsorted(np.cumsum(rows[0][::-1] != rows[0][-1]), 1))
            end = len(rows[0]) - last
            if end:
                yield links(*(x[:end] for x in rows))
            held = [tuple(x[end:] for x in rows)]
    if held:
        yield links(*(np.concatenate(x) for x in zip(*held)))


def scheme(n: int) -> tuple[int, int]:
    """Bands, and how many of them agree, for n distinct fingerprints."""
    return next((s for s in SCHEMES if n <= EVEN_GROUP << (64 // s[0] * s[1])), SCHEMES[-1])


def masks(bands: int, agree: int) -> list[int]:
    """The bits of every choice of ``agree`` bands, as signed longs."""
    edges = [64 * k // bands for k in range(bands + 1)]
    chosen = (sum((1 << b) - (1 << a) for a, b in c) for c in combinations(list(zip(edges, edges[1:])), agree))
    return [m - 2**64 if m >= 2**63 else m for m in chosen]


def links(prints: DataFrame, bands: int | None = None) -> DataFrame:
    """u, v: a spanning forest of the links between distinct fingerprints, as their nodes (``prints``: fp, node)."""
    n = partitions(prints.sparkSession)
    of, agree = scheme(prints.count()) if bands is None else (bands, bands - BUDGET)
    paths = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for k, m in enumerate(masks(of, agree))])
    rows = prints.select("fp", "node", F.explode(paths).alias("band"))
    large = cut(rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MAX_GROUP).select("band", F.ceil(F.col("n") / MAX_GROUP).cast("int").alias("blocks")))
    blocked = rows.join(large, "band", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    # The block of a fingerprint is read off its bits, mixed; it meets every block once.
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.least(b, own) * F.col("blocks") + F.greatest(b, own))
    tries = blocked.select("fp", "node", F.explode(meets).alias("pair"), "band").select(F.xxhash64("band", "pair").alias("trie"), "fp", "node")
    dealt = tries.repartition(n, "trie").sortWithinPartitions("trie", F.col("fp") < 0, "fp")
    return arrow_map(dealt, _link_tries, "u long, v long")


def _rooted(prints: DataFrame, first: Column) -> tuple[DataFrame, DataFrame]:
    """fp, root of each distinct fingerprint, and root, first: the least ``first`` of each component.

    Fingerprints are their own nodes, so rows that share a doc_id, or have none, are linked by their texts alone."""
    distinct = cut(prints.groupBy("fp").agg(F.min(first).alias("first")))
    tree = roots(links(distinct.select("fp", F.col("fp").alias("node")))).select(F.col("node").alias("fp"), "root")
    rooted = cut(distinct.join(tree, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    # Read back, tables meet in a plain join, whose hot keys adaptive execution can split.
    return rooted.select("fp", "root"), cut(rooted.groupBy("root").agg(F.min("first").alias("first")))


def components(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id of the component) of every document."""
    prints = cut(fingerprints(docs.select("doc_id", "text")))
    rooted, least = _rooted(prints, F.col("doc_id"))
    labels = cut(rooted.join(least, "root").select("fp", F.col("first").alias("component_id")))
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row for each component: that of its smallest doc_id (null is the largest), then of its least text hash,
    then of the least hash of all its columns; of rows that are equal in all of them, one. All columns stay."""
    key = F.sha2(F.coalesce("text", F.lit("")), 256)
    whole = F.xxhash64(*[f.name for f in docs.schema if "map<" not in f.dataType.simpleString()])
    prints = cut(fingerprints(docs.select("doc_id", "text", key.alias("key"), whole.alias("whole"))))
    _, least = _rooted(prints, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "whole"))
    kept = least.select("first.doc_id", "first.key", "first.whole")
    own, mixed = (unused(n, docs.columns) for n in ("key", "whole"))
    rows = docs.withColumns({own: key, mixed: whole})
    same = rows["doc_id"].eqNullSafe(kept["doc_id"]) & (rows[own] == kept["key"]) & (rows[mixed] == kept["whole"])
    return rows.join(kept, same, "left_semi").dropDuplicates(["doc_id", own]).drop(own, mixed)
