"""Best-fit packing of tokenised documents into fixed-length sequences.

Pieces come online; a fixed number of bins is open. A bitset has one bit for each amount of free space that an
open bin has, so the tightest bin that takes a piece is found by a shift and a lowest set bit. A new bin beyond
the fixed number closes the fullest open one. Pieces are fed in windows, the longest of a window first, which
is nearly as tight as packing all of them in order of length, in bounded memory.

Only documents longer than a sequence are cut, into full sequences after a first piece with what is over. Each
partition packs by itself and leaves at most a few sequences with space, so their number follows the number of
tokens (``PARTITION_TOKENS``) and not the session's setting.

Defined results: null and empty texts have the end token alone; texts of any length are tokenised whole; equal and
repeated rows are packed as often as they occur (which of equal pieces goes where is settled by their order in the
partition); rows that share a doc_id, or have none, are packed one by one; doc_id may be of any type; an empty
table gives an empty result; columns other than doc_id and text aren't read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossweave.llm.bpe import WORD_PATTERN, byte_alphabet, encoder
from crossweave.llm.common import TEXT_ROWS, arrow_map, store, texts

LENGTH = 1024
#: Fixed value: the id that ends a document.
END_ID = 2
OPEN_BINS = 32_768
WINDOW = 16_384
#: Tokens of a partition that packs by itself, up to so many partitions (beyond, they grow; a task holds a window and its open bins).
PARTITION_TOKENS = 1 << 24
MAX_PARTITIONS = 16_384
#: The compiled encoder's pattern engine backtracks over white space, with a stack that ends near a million characters.
_LONG_SPACE = re.compile(r"\s{10000}")


_encodings: dict[str, tiktoken.Encoding] = {}


def encoding(spec: bytes) -> tiktoken.Encoding:
    """A compiled encoder with the vocabulary of a tokenizers JSON file (its content), whose ids are merge ranks."""
    key = hashlib.sha256(spec).hexdigest()
    if key not in _encodings:
        d = json.loads(spec)
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): id_ for token, id_ in d["model"]["vocab"].items()}
        special = {x["content"]: x["id"] for x in d["added_tokens"]}
        _encodings[key] = tiktoken.Encoding(key, pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _encodings[key]


def tokeniser(spec: bytes) -> Callable[[str], bytes]:
    """A function from a whole text to its token ids as little-endian unsigned 32-bit numbers; ``bpe`` encodes texts with very long white space."""
    compiled = encoding(spec)

    def ids(text: str) -> bytes:
        if len(text) >= 10_000 and _LONG_SPACE.search(text):
            return encoder(spec).encode(text)
        return compiled.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()

    return ids


def cut_points(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, size) of the pieces of a document of n tokens."""
    over = n % length
    starts = [0, *range(over or length, n, length)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n])]


class Packer:
    """Bounded-space best fit. ``place`` gives a piece's bin (numbered from 0) and offset."""

    def __init__(self, length: int = LENGTH, open_bins: int = OPEN_BINS) -> None:
        self.length, self.open_bins = length, open_bins
        self.bits, self.open, self.made = 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]  # open bins by free space

    def place(self, size: int) -> tuple[int, int]:
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.open >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, bin_ = self.length, self.made
            self.made += 1
        if free > size:
            self.bins[free - size].append(bin_)
            self.bits |= 1 << (free - size)
            self.open += 1
        return bin_, self.length - free

    def _take(self, free: int) -> int:
        held = self.bins[free]
        bin_ = held.pop()
        if not held:
            self.bits &= ~(1 << free)
        self.open -= 1
        return bin_


def pieces(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    with open(tokenizer_path, "rb") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenise = tokeniser(spec.value)
        for batch in batches:
            rows = []
            for row, text in enumerate(texts(batch.column("text"))):
                ids = tokenise(text) + end
                rows += [(row, k, a, n, zlib.crc32(ids[4 * a : 4 * (a + n)])) for k, (a, n) in enumerate(cut_points(len(ids) // 4, length))]
            made = np.array(rows, np.int64).reshape(-1, 5)
            columns = [batch.column("doc_id").take(pa.array(made[:, 0])), pa.array(made[:, 1].astype(np.int32)), *(pa.array(made[:, k]) for k in (2, 3, 4))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long", TEXT_ROWS)


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID, open_bins: int = OPEN_BINS, window: int = WINDOW) -> DataFrame:
    """The pieces with sequence_id and offset. Only numbers are shuffled, neither texts nor tokens."""
    rows = store(pieces(docs, tokenizer_path, length, end_id))
    tokens = rows.agg(F.sum("length")).first()[0] or 0
    n = max(1, min(MAX_PARTITIONS, -(-tokens // PARTITION_TOKENS)))
    dealt = rows.repartition(n, F.xxhash64("doc_id", "piece")).sortWithinPartitions(F.xxhash64("doc_id", "piece"), "doc_id", "piece", "start", "length", "ids_crc32")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(length, open_bins)
        base = TaskContext.get().partitionId() << 40
        held: list[pa.RecordBatch] = []

        def window_out() -> pa.RecordBatch:
            batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            sizes = batch.column("length").to_numpy()
            order = np.argsort(-sizes, kind="stable")
            placed = np.empty((len(sizes), 2), np.int64)
            for i, size in zip(order.tolist(), sizes[order].tolist()):
                placed[i] = packer.place(size)
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(base + placed[:, 0]), pa.array(placed[:, 1].copy())], names=[*batch.schema.names, "sequence_id", "offset"])

        for batch in batches:
            while batch.num_rows:
                room = window - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(min(room, batch.num_rows))
                if sum(b.num_rows for b in held) >= window:
                    yield window_out()
                    held = []
        if held:
            yield window_out()

    return arrow_map(dealt, run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
