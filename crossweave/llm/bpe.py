"""Byte-level BPE encoding by backtracking over longest matches, and decoding by an offset table.

An Aho-Corasick automaton over the vocabulary gives the longest token at every position of a word in one pass.
The encoder takes the longest match, checks it against its left neighbour in a pair-compatibility table, and
falls back to shorter prefixes, or one token back, where the pair couldn't have come from the merges. Positions
that led nowhere are marked, so the time is linear in the word. The result is exactly that of applying the
merges in order.

Two tokens are compatible if no merge across their boundary comes before the merges that built them: the pieces
next to the boundary are the right edge of the left token's merge tree and the left edge of the right one's.

Words repeat, so encoded words are held in a bounded table.

Defined results: null and empty texts have no tokens; a special token of the vocabulary in a text is its own id;
texts, words and runs of white space of any length are encoded whole, in linear time, and only those of one part
of a batch (``TEXT_ROWS`` rows) are held at once; repeated rows are returned as often as they occur, and doc_id, of
any type or null, is only carried; an empty table gives an empty result; columns other than doc_id and text aren't
read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain, islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from crossweave.llm.common import TEXT_ROWS, arrow_map, texts

#: Fixed value: the word pattern of the byte-level pre-tokenizer.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of each of a worker's tables of encoded words; a full table is emptied.
CACHE = 400_000
#: Words longer than this (in code points) are encoded each time.
CACHED_LENGTH = 64


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins for bytes: printable Latin-1 stands for itself, other bytes come after U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class _Irregular(Exception):
    """A part of the text that starts with white space."""


class _Parts(dict):
    """Encoded parts of texts between single spaces."""

    def __init__(self, encode, lead: str) -> None:
        self.encode, self.lead = encode, lead

    def __missing__(self, part: str) -> bytes:
        if self.lead and (not part or part[0].isspace()):
            raise _Irregular
        ids = self.encode(self.lead + part)
        if len(part) <= CACHED_LENGTH:
            if len(self) >= CACHE:
                self.clear()
            self[part] = ids
        return ids


class BytePairEncoder:
    """Encodes and decodes by the vocabulary and merges of a tokenizers JSON file (its content)."""

    def __init__(self, spec: bytes) -> None:
        d = json.loads(spec)
        alphabet = byte_alphabet()
        raw = {id_: bytes(alphabet[c] for c in token) for token, id_ in d["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in d["added_tokens"]}
        raw |= {id_: content.encode() for content, id_ in self.special.items()}
        self.raw = [raw.get(i, b"") for i in range(max(raw) + 1)]
        ids = {token: id_ for id_, token in raw.items() if id_ not in self.special.values()}
        self.ids = ids
        self.parts: dict[int, tuple[int, int]] = {}  # the two tokens that a token was merged from
        self.rank: dict[int, int] = {}  # in what order a token is made
        self.merged: dict[tuple[int, int], int] = {}
        self.prefix: dict[int, int] = {}
        self.compatible: dict[int, bool] = {}  # by left << 20 | right
        for rank, pair in enumerate(d["model"]["merges"]):
            left, right = (bytes(alphabet[c] for c in x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            made = ids[left + right]
            self.merged.setdefault((ids[left], ids[right]), made)
            if made not in self.parts:
                self.parts[made], self.rank[made] = (ids[left], ids[right]), rank
        self.automaton = ahocorasick.Automaton()
        for token, id_ in ids.items():
            self.automaton.add_word(token.decode("latin-1"), id_)
        self.automaton.make_automaton()
        self.words = regex.compile(WORD_PATTERN)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.lengths = [len(x) for x in self.raw]
        self.offsets = np.concatenate(([0], np.cumsum(self.lengths)))
        self.bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        self.decimal = [b"%d" % i for i in range(len(self.raw))]
        self.known: dict[str, bytes] = {}
        self.first, self.rest = _Parts(self._encode_part, ""), _Parts(self._encode_part, " ")

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The pieces on one edge of a token's merge tree, each with the rank at which it is merged on."""
        edge, until = [], float("inf")
        while True:
            edge.append((token, until))
            if token not in self.parts:
                return edge
            until = self.rank[token]
            token = self.parts[token][side]

    def _fits(self, left: int, right: int) -> bool:
        key = left << 20 | right
        known = self.compatible.get(key)
        if known is None:
            known = True
            for a, a_until in self._edge(left, 1):
                for b, b_until in self._edge(right, 0):
                    made = self.merged.get((a, b))
                    # Of equal merges that overlap, the one further left goes first.
                    if made is not None and self.rank[made] < a_until and self.rank[made] <= b_until:
                        known = False
            if len(self.compatible) >= 4 * CACHE:
                self.compatible.clear()
            self.compatible[key] = known
        return known

    def _shorter(self, token: int) -> int:
        """The longest token that is a proper prefix, or -1."""
        known = self.prefix.get(token)
        if known is None:
            raw = self.raw[token]
            known = next((self.ids[raw[:n]] for n in range(len(raw) - 1, 0, -1) if raw[:n] in self.ids), -1)
            self.prefix[token] = known
        return known

    def encode_word(self, word: bytes) -> list[int]:
        """Token ids of one word of the pre-tokenizer."""
        whole = self.ids.get(word)
        if whole is not None:
            return [whole]
        n, lengths, compatible = len(word), self.lengths, self.compatible
        longest = [-1] * n
        for end, id_ in self.automaton.iter(word.decode("latin-1")):
            longest[end - lengths[id_] + 1] = id_  # ends go up, so the last one kept is the longest
        dead = bytearray(n + 1)  # positions from which the rest can't be encoded
        token = longest[0]
        out: list[int] = []
        at, last = 0, -1
        while at < n:
            end = at + lengths[token]
            if not dead[end]:
                fits = last < 0 or compatible.get(last << 20 | token)
                if fits is None:
                    fits = self._fits(last, token)
                if fits:
                    out.append(token)
                    last, at = token, end
                    if at < n:
                        token = longest[at]
                    continue
            token = self._shorter(token)
            while token < 0:  # nothing fits here: one token back
                dead[at] = 1
                token = out.pop()
                last = out[-1] if out else -1
                at -= lengths[token]
                token = self._shorter(token)
        return out

    def _encode_part(self, part: str) -> bytes:
        out = []
        plain = part.isascii() and (part.isalpha() or part[:1] == " " and part[1:].isalpha())  # one word of letters
        for word in (part,) if plain else self.words.findall(part):
            ids = self.known.get(word)
            if ids is None:
                ids = np.array(self.encode_word(word.encode("utf-8", "surrogatepass")), "<u4").tobytes()
                if len(word) <= CACHED_LENGTH:
                    if len(self.known) >= CACHE:
                        self.known.clear()
                    self.known[word] = ids
            out.append(ids)
        return b"".join(out)

    def _encode_plain(self, text: str) -> bytes:
        """A text is cut at single spaces before other characters, where the word pattern cuts it in any case."""
        parts = text.split(" ")
        try:
            return b"".join(chain((self.first[parts[0]],), map(self.rest.__getitem__, islice(parts, 1, None))))
        except _Irregular:
            return b"".join(self._with_white_space(parts))

    def _with_white_space(self, parts: list[str]) -> Iterator[bytes]:
        """Encoded parts, where those that are empty or start with white space stay with the part before them."""
        known, run = self.first, [parts[0]]
        for part in islice(parts, 1, None):
            if part and not part[0].isspace():
                yield known[" ".join(run)]
                known, run = self.rest, []
            run.append(part)
        yield known[" ".join(run)]

    def encode(self, text: str) -> bytes:
        """Token ids of a whole text, as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if self.split_special is None or not any(x in text for x in self.special):
            return self._encode_plain(text)
        parts = (np.array([self.special[x]], "<u4").tobytes() if k % 2 else self._encode_plain(x) if x else b"" for k, x in enumerate(self.split_special.split(text)))
        return b"".join(parts)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of tokens, gathered from one table by offsets."""
        starts = self.offsets[ids]
        sizes = self.offsets[ids.astype(np.int64) + 1] - starts
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.bytes[np.arange(total) + np.repeat(starts - ends + sizes, sizes)].tobytes()

    def listing(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        return b",".join(map(self.decimal.__getitem__, ids.tolist()))


_encoders: dict[str, BytePairEncoder] = {}


def encoder(spec: bytes) -> BytePairEncoder:
    """One encoder for a worker and file."""
    key = hashlib.sha256(spec).hexdigest()
    if key not in _encoders:
        _encoders[key] = BytePairEncoder(spec)
    return _encoders[key]


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text.

    The tokenizer file is read where the query is built and goes to the workers as a broadcast of its size
    (some MB, whatever the input).
    """
    with open(tokenizer_path, "rb") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(spec.value)
        for batch in batches:
            counts, listed, decoded = [], [], []
            for text in texts(batch.column("text")):
                ids = np.frombuffer(bpe.encode(text), "<u4")
                counts.append(len(ids))
                listed.append(hashlib.sha256(bpe.listing(ids)).hexdigest())
                # Bytes that are no UTF-8 are shown as the replacement character.
                decoded.append(hashlib.sha256(bpe.decode(ids).decode("utf-8", "replace").encode()).hexdigest())
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", TEXT_ROWS)
