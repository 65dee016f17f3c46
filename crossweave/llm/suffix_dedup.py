"""Removal of repeated passages by longest-previous-factor arrays.

A byte goes if a string of ``MATCH`` bytes that covers it also starts in a document with a smaller doc_id. In the
order of sorted suffixes, the longest match of a suffix with an earlier document is with its previous or its next
suffix from a smaller document; the least common prefix on the way there is the match's length. That array
(``longest_previous``) is built over the suffixes that can match at all, in parts that fit a task:

1. Every window of ``MATCH`` bytes has an anchor, the least-hashed ``GRAM`` bytes in it, so equal windows have
   equal anchors. An anchor stands for the run of windows that chose it. Tasks read documents in bounded blocks,
   and send on, for each anchor, hashes of its bytes, of the ``SIDE`` bytes on either side and of all bytes under its
   windows. Of equal runs in a block only those of the least doc_id are sent; the others are settled.
2. Anchors meet by hash. A run that a smaller document has in full is settled. Of the others, windows with ``SIDE``
   bytes or more before the anchor can only match where those bytes agree too, and the rest of them only where the
   bytes behind the anchor do: every window has one of the two. So a run has two parts, and the texts under a part's
   windows have to be compared only where anchor and side agree. (Anchors alone agree by chance ever more often in
   a larger corpus.)
3. Those texts are cut out (one shuffle of the documents) and meet by anchor and side; their suffixes are sorted and
   the longest previous factors taken. Groups of more than ``MAX_CONTEXTS`` parts are cut into windows, of which a text
   sends each different one once (with all its places) and a task only that of the least document, so that a
   group isn't too large for a task, and a text that repeats itself isn't either.
4. The settled runs of a document are united and its remaining bytes kept.

In step 3 windows are equal if their bytes are. In steps 1 and 2 whole runs are taken as equal if their hashes are:
within a block by 64 bits that mix the hashes of anchor and run, between blocks by 40 and 48 bits of the two and the
anchor's bucket. For n different runs that is wrong for some n² / 2^89 pairs by chance (0.002 of one for 10^12
runs; n² / 2^65 for the at most 10^6 runs of a block), and can be forged on purpose. The first copy of a passage
always stays.

Defined results: null and empty texts have no bytes; very long texts are read whole; a null doc_id counts as larger
than any other; of rows that share a doc_id, or have none, none is earlier than the other, and each text is cut at
its own positions (a run's ``first`` holds the text's slot above ``POSITION_BITS``); repeated rows are returned as
often as they occur; doc_id has to be a number, or a string of one (other strings count as null); an empty table
gives an empty result; ``measure`` reads doc_id and text only, and ``strip`` carries all other columns whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossweave.llm.common import TEXT_ROWS, arrow_map, give_back, partitions, store

MATCH = 50
GRAM = 20
#: Bytes on one side of the anchor: half of what a window has beside it.
SIDE = (MATCH - GRAM) // 2
#: Bytes of text in a block; one document may be longer.
BLOCK_BYTES = 12 << 20
#: Windows that are hashed at once (at most 2^20: a position takes 20 bits beside its hash).
CHUNK = 1 << 16
#: Parts of runs in one group beyond which their windows are dealt out one by one.
MAX_CONTEXTS = 4_000
#: Hash buckets for each shuffle partition.
BUCKETS = 8
NO_ID = 2**63 - 1
#: A run's first position in its text takes so many bits (Spark's strings are shorter), the text's slot those above.
POSITION_BITS = 31
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _words(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as a number; zeros follow the end."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    out = np.zeros(len(raw), np.uint64)
    for k in range(8):
        out |= padded[k : k + len(raw)].astype(np.uint64) << _U(8 * k)
    return out


def _span_hashes(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of the bytes [start, start + size), for sizes of eight or more."""
    out = sizes.astype(np.uint64) * _U(0x9E3779B97F4A7C15)
    last = sizes - 8
    for at in range(0, int(sizes.max(initial=0)), 8):
        # Words beyond the end are the last one again, which tells nothing new.
        out = (out ^ words[starts + np.minimum(at, last)]) * _U(0xD6E8FEB86659FD93)
        out ^= out >> _U(32)
    return _mix(out)


def _side_hashes(words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Hashes of 24 bits of the bytes [start, start + size), for a size of eight or more; of starts outside, of no meaning."""
    out = np.zeros(len(starts), np.uint64)
    for at in [*range(0, size - 8, 8), size - 8]:
        out = (out ^ words[np.clip(starts + at, 0, len(words) - 1)]) * _U(0xD6E8FEB86659FD93)
        out ^= out >> _U(32)
    return out & _U(2**24 - 1)


def anchors(raw: np.ndarray, ends: np.ndarray, match: int = MATCH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, anchor hash, run hash, first window, number of windows, how many of them have ``SIDE`` bytes or more before the
    anchor, hash of the side before it, hash of the side behind it) of the anchors of texts that lie end to end.

    ``ends``: where each text ends in ``raw``; no window crosses an end. A side's hash counts only where a window has that side."""
    side = (match - gram) // 2
    n = len(raw) - match + 1  # windows
    begins = np.concatenate(([0], ends[:-1])).astype(np.int64)
    found = []
    width = match - gram + 1
    for at in range(0, max(0, n), CHUNK):
        windows = min(CHUNK, n - at)
        words = _words(raw[at : at + windows + match - 1])
        grams = windows + width - 1
        hashes = words[:grams].copy()
        for k in range(8, gram, 8):
            step = min(k, gram - 8)
            hashes ^= hashes >> _U(32)
            hashes *= _U(0xD6E8FEB86659FD93)
            hashes += words[step : step + grams]
        hashes = _mix(hashes)
        least = (hashes & ~_U(2**20 - 1)) | np.arange(grams, dtype=np.uint64)  # of equal hashes the leftmost
        span = 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        chosen = (least & _U(2**20 - 1)).astype(np.int64)
        fresh = np.concatenate(([True], chosen[1:] != chosen[:-1]))
        inside = begins[np.searchsorted(begins, at) : np.searchsorted(begins, at + windows)]
        fresh[inside - at] = True
        first = np.flatnonzero(fresh)
        text = np.searchsorted(ends, first + at, side="right")
        count = np.minimum(np.append(first[1:], windows), ends[text] - match + 1 - at) - first
        some = count > 0
        first, count, text = first[some], count[some], text[some]
        place = chosen[first]
        far = np.clip(place - first - side + 1, 0, count)  # the first windows of a run lie furthest before its anchor
        sides = _side_hashes(words, place - side, side), _side_hashes(words, place + gram, side)
        found.append((text, hashes[place], _span_hashes(words, first, count + match - 1), first + at - begins[text], count, far, *sides))
    if not found:
        return tuple(np.zeros(0, np.uint64 if k in (1, 2, 6, 7) else np.int64) for k in range(8))
    return tuple(np.concatenate(x) for x in zip(*found))


def longest_previous(owners: np.ndarray, shared: np.ndarray, least: int = 0) -> np.ndarray:
    """For suffixes in sorted order, the longest match with a suffix of a smaller owner.

    ``shared[i]`` is the length that suffixes i - 1 and i have in common (``shared[0]`` is ignored). Matches below
    ``least`` may be given as too short. Previous and next smaller owners are found by pointer jumping.
    """

    def towards(owners: np.ndarray, shared: np.ndarray) -> np.ndarray:
        n = len(owners)
        to, common = np.arange(n) - 1, shared.copy()
        if n:
            common[0] = 0
        live = np.flatnonzero((to >= 0) & (common >= max(least, 1)))
        live = live[owners[to[live]] >= owners[live]]
        while len(live):
            via = to[live]
            new_to, new_common = to[via], np.minimum(common[live], common[via])
            to[live], common[live] = new_to, new_common
            go_on = (new_to >= 0) & (new_common >= max(least, 1))
            common[live[new_to < 0]] = 0
            live = live[go_on]
            live = live[owners[to[live]] >= owners[live]]
        # Where the search stopped short of a smaller owner there is no match of the length asked for.
        lost = (to < 0) | (owners[np.maximum(to, 0)] >= owners)
        common[lost] = 0
        return common

    before = towards(owners, shared)
    back = np.zeros_like(shared)
    back[1:] = shared[:0:-1]
    return np.maximum(before, towards(owners[::-1], back)[::-1])


def repeated_windows(groups: np.ndarray, owners: np.ndarray, contexts: list[bytes], match: int = MATCH) -> list[np.ndarray]:
    """For each context, which of its windows also are in a context of its group with a smaller owner."""
    sizes = np.array([len(x) for x in contexts], np.int64)
    hit, of = _windows(groups, owners, np.frombuffer(b"".join(contexts), np.uint8), sizes, match)
    return np.split(hit, np.searchsorted(of, np.arange(1, len(contexts))))


def _windows(groups: np.ndarray, owners: np.ndarray, raw: np.ndarray, sizes: np.ndarray, match: int = MATCH) -> tuple[np.ndarray, np.ndarray]:
    """For all windows of contexts that lie end to end: whether a context of the group with a smaller owner has it, and whose it is."""
    offsets = np.cumsum(sizes) - sizes
    count = sizes - match + 1
    words = _words(raw).byteswap()  # big-endian: numbers sort as bytes do
    of = np.repeat(np.arange(len(sizes)), count)
    firsts = np.cumsum(count) - count
    start = offsets[of] + np.arange(len(of)) - firsts[of]
    steps = [*range(0, match - 8, 8), match - 8]
    # A window whose hash is alone in its group matches nothing; only the others are sorted.
    mixed = groups.view(np.uint64)[of]
    for k in steps:
        mixed = (mixed ^ words[start + k]) * _U(0xD6E8FEB86659FD93)
        mixed ^= mixed >> _U(32)
    ranked = np.sort(mixed)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    some = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, mixed), len(twice) - 1)] == mixed) if len(twice) else np.zeros(0, np.int64)
    columns = [words[start[some] + k] for k in steps]
    owner, group = owners[of[some]], groups[of[some]]
    order = np.lexsort((owner, *columns[::-1], group))
    same = group[order][1:] == group[order][:-1]
    shared = np.zeros(len(order), np.int64)
    for k, column in zip(steps, columns):
        column = column[order]
        same &= column[1:] == column[:-1]
        shared[1:][same] = k + 8
    far = longest_previous(owner[order], shared, match)
    hit = np.zeros(len(of), bool)
    hit[some[order]] = far >= match
    return hit, of


#: Bytes of the hashes of anchor, run and sides between blocks.
WIDTHS = (5, 6, 3, 3)


def _bytes_of(x: np.ndarray) -> np.ndarray:
    return x.astype("<u8").view(np.uint8).reshape(len(x), 8)


def _pack(key: np.ndarray, first: np.ndarray, count: np.ndarray, *more: np.ndarray) -> bytes:
    """``more``: hashes of anchor, run and sides, and far; nothing for settled runs."""
    hashes = [_bytes_of(x)[:, :w].tobytes() for x, w in zip(more, WIDTHS)]
    rest = [_bytes_of(np.diff(key, prepend=np.int64(0))).T.tobytes(), _bytes_of(first).T.tobytes(), *(x.astype(np.uint8).tobytes() for x in (count, *more[4:]))]
    return len(key).to_bytes(4, "little") + bool(more).to_bytes() + b"".join(hashes) + zstandard.ZstdCompressor(level=1).compress(b"".join(rest))


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    """Hashes of anchor and run (of settled runs, zeros), key, first and count; of runs to compare, also hashes of sides, and far."""
    n, more, at = int.from_bytes(blob[:4], "little"), blob[4], 5
    hashes = [np.zeros((n, 8), np.uint8) for _ in WIDTHS]
    for x, w in zip(hashes if more else (), WIDTHS):
        x[:, :w] = np.frombuffer(blob, np.uint8, w * n, at).reshape(n, w)
        at += w * n
    h, c, before, behind = (x.view("<u8").ravel() for x in hashes)
    rest = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[at:]), np.uint8)
    key = np.cumsum(np.ascontiguousarray(rest[: 8 * n].reshape(8, n).T).view("<i8").ravel())
    first = np.ascontiguousarray(rest[8 * n : 16 * n].reshape(8, n).T).view("<i8").ravel()
    own = h, c, key, first, rest[16 * n : 17 * n].astype(np.int64)
    return (*own, before, behind, rest[17 * n :].astype(np.int64)) if more else own


def _block(docs: list[tuple], buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, kind, blob) of a block of (key, bytes, slot or nothing); kind 0: anchors to compare, kind 1: runs that are settled."""
    docs = sorted((d for d in docs if len(d[1]) >= MATCH), key=lambda d: d[0])
    if not docs:
        return
    ends = np.cumsum([len(d[1]) for d in docs])
    text, h, c, first, count, far, before, behind = anchors(np.frombuffer(b"".join(d[1] for d in docs), np.uint8), ends)
    key = np.array([d[0] for d in docs], np.int64)[text]
    first = first + (np.array([d[2] if len(d) > 2 else 0 for d in docs], np.int64) << POSITION_BITS)[text]
    c &= _U(2**48 - 1)
    both = h ^ _mix(c)
    order = np.argsort(both, kind="stable")  # keys rise within equal runs
    fresh = np.concatenate(([True], both[order][1:] != both[order][:-1]))
    least = np.empty_like(key)
    least[order] = key[order][fresh][np.cumsum(fresh) - 1]
    settled = key > least
    bucket = (h % _U(buckets)).astype(np.int64)
    inner = (h // _U(buckets)) & _U(2**40 - 1)
    bucket[settled] = key[settled] % buckets
    for kind, rows in ((0, np.flatnonzero(~settled)), (1, np.flatnonzero(settled))):
        rows = rows[np.argsort(bucket[rows], kind="stable")]
        cuts = np.flatnonzero(np.diff(bucket[rows], prepend=-1))
        for a, b in zip(cuts, np.append(cuts[1:], len(rows))):
            at = rows[a:b]
            yield int(bucket[at[0]]), kind, _pack(*(x[at] for x in (key, first, count, *(() if kind else (inner, c, before, behind, far)))))


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with __key (the order of owners) and __slot, which tells apart the different texts of one key: 0 where it has one only."""
    keyed = docs.withColumn("__key", F.coalesce(F.col("doc_id").try_cast("long"), F.lit(NO_ID)))
    whole = keyed.withColumn("__slot", F.lit(0).cast("long"))
    # Only a key of several rows can have several texts, so texts are read for this only where there is one.
    repeated = store(keyed.groupBy("__key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("__key"))
    if repeated.isEmpty():
        return whole
    hashed = keyed.withColumn("__h", F.xxhash64(F.coalesce("text", F.lit(""))))
    among = hashed.select("__key", "__h").join(repeated, "__key", "left_semi")
    shared = store(among.groupBy("__key").agg(F.min("__h").alias("a"), F.max("__h").alias("b")).filter("a <> b").select("__key"))
    if shared.isEmpty():
        return whole
    # Read back before they are numbered, so that the numbers stay.
    pairs = store(hashed.join(shared, "__key", "left_semi").select("__key", "__h").distinct())
    slots = store(pairs.sparkSession.createDataFrame(pairs.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])), "__key long, __h long, __slot long"))
    return hashed.join(slots, ["__key", "__h"], "left").withColumn("__slot", F.coalesce("__slot", F.lit(0))).drop("__h")


def _settle(inner, c, key, first, count, before, behind, far) -> dict[str, np.ndarray]:
    """Anchors of whole buckets: settled runs (group null), and parts of runs to compare, by group."""
    order = np.lexsort((key, c, inner))
    inner, c, key, first, count, before, behind, far = (x[order] for x in (inner, c, key, first, count, before, behind, far))
    new_h = np.concatenate(([True], inner[1:] != inner[:-1]))
    new_c = new_h | np.concatenate(([True], c[1:] != c[:-1]))
    of_c, of_h = np.cumsum(new_c) - 1, np.cumsum(new_h) - 1
    settled = key > key[new_c][of_c]
    runs = np.bincount(of_h[new_c], minlength=of_h[-1] + 1)  # different runs of each anchor
    least, most = np.minimum.reduceat(key, np.flatnonzero(new_h)), np.maximum.reduceat(key, np.flatnonzero(new_h))
    open_ = ~settled & (runs > 1)[of_h] & (least < most)[of_h]
    out = [(key[settled], first[settled], count[settled], np.full(settled.sum(), -1), np.zeros(settled.sum(), bool))]
    for side, hashes, begin, many in ((0, before, first, far), (1, behind, first + far, count - far)):
        at = np.flatnonzero(open_ & (many > 0))
        if not len(at):
            continue
        group = _mix((inner[at] << _U(24) | hashes[at]) + _U(side)) >> _U(24)
        order = np.argsort(group, kind="stable")
        at, group = at[order], group[order]
        fresh = np.concatenate(([True], group[1:] != group[:-1]))
        starts, of = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        differs = [np.minimum.reduceat(x[at], starts) < np.maximum.reduceat(x[at], starts) for x in (c, key)]
        meets = (differs[0] & differs[1])[of]
        hot = (np.bincount(of) > MAX_CONTEXTS)[of]
        at, group, hot = at[meets], group[meets], hot[meets]
        out.append((key[at], begin[at], many[at], group.view(np.int64), hot))
    return dict(zip(("key", "first", "count", "group", "hot"), map(np.concatenate, zip(*out))))


def _runs(docs: DataFrame) -> DataFrame:
    """key, first, count, grp, hot: settled runs (grp is null) and parts of runs to compare, of ``docs(key, slot, text)``."""
    n = partitions(docs.sparkSession)
    buckets = BUCKETS * n

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            rows = list(_block(held, buckets))
            for a in range(0, len(rows), 256):
                columns = list(zip(*rows[a : a + 256]))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], names=["bucket", "kind", "blob"])

        for batch in batches:
            for key, slot, text in zip(*(batch.column(k).to_pylist() for k in ("key", "slot", "text"))):
                held.append((key, text.encode("utf-8", "surrogatepass"), slot))
                size += len(held[-1][1])
                if size >= BLOCK_BYTES:
                    yield from out()
                    held, size = [], 0
                    give_back()
        yield from out()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        bucket = None

        def send(key, first, count, group, hot) -> pa.RecordBatch:
            columns = [pa.array(key), pa.array(first), pa.array(count.astype(np.int32)), pa.array(group, mask=group < 0), pa.array(hot)]
            return pa.RecordBatch.from_arrays(columns, names=["key", "first", "count", "grp", "hot"])

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                made = _settle(*(np.concatenate(x) for x in zip(*held)))
                # A group is known by its bucket and the hash within it; groups that fall together are told apart by their bytes.
                group = np.where(made["group"] >= 0, (made["group"] * buckets + bucket) & NO_ID, -1)
                yield send(made["key"], made["first"], made["count"], group, made["hot"])

        for batch in batches:
            for b, kind, blob in zip(*(batch.column(k).to_pylist() for k in ("bucket", "kind", "blob"))):
                rows = _unpack(blob)
                if kind:
                    yield send(*rows[2:], np.full(len(rows[0]), -1), np.zeros(len(rows[0]), bool))
                    continue
                if b != bucket:
                    yield from out()
                    held, bucket = [], b
                held.append(rows)
        yield from out()

    blobs = arrow_map(docs, read, "bucket int, kind int, blob binary", TEXT_ROWS)
    dealt = blobs.repartition(n, "bucket").sortWithinPartitions("bucket")
    return arrow_map(dealt, meet, "key long, first long, count int, grp long, hot boolean")


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts or binaries end to end, nulls being empty, and where each begins (and the last ends)."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]), offsets - offsets[0]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _listed(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row of each element of lists, and the elements."""
    return np.repeat(np.arange(len(column)), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)), column.flatten()


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their runs to the bytes under the runs' windows and where they start; windows of hot groups one by one, once a text and task."""
    names = ["grp", "key", "firsts", "context"]
    seen: dict[bytes, int] = {}
    for batch in batches:
        raw, offsets = _binary(batch.column("text"))
        keys = batch.column("key").to_numpy()
        row, runs = _listed(batch.column("runs"))
        grp, first, count, hot = (runs.field(k).to_numpy(zero_copy_only=False) for k in ("grp", "first", "count", "hot"))
        starts, sizes = (first & (1 << POSITION_BITS) - 1) + offsets[row], count.astype(np.int64) + MATCH - 1
        cool = np.flatnonzero(~hot)
        ends = np.concatenate(([0], np.cumsum(sizes[cool])))
        context = pa.Array.from_buffers(pa.binary(), len(cool), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw[_ranges(starts[cool], sizes[cool])])])
        each = pa.ListArray.from_arrays(pa.array(np.arange(len(cool) + 1), pa.int32()), pa.array(first[cool]))
        yield pa.RecordBatch.from_arrays([pa.array(grp[cool]), pa.array(keys[row[cool]]), each, context], names=names)
        rows, warm = [], np.flatnonzero(hot)
        for at in np.split(warm, np.flatnonzero(np.diff(row[warm])) + 1) if len(warm) else ():
            key, places = int(keys[row[at[0]]]), {}
            for run in at.tolist():
                a, n, place = int(starts[run]), int(count[run]), int(first[run])
                held = raw[a : a + n + MATCH - 1].tobytes()
                for k in range(n):
                    places.setdefault(held[k : k + MATCH], []).append(place + k)
            for window, firsts in places.items():
                if seen.get(window, key) < key:
                    rows.append((None, key, firsts, b""))  # settled: this task has it from a smaller document
                    continue
                if len(seen) >= 200_000:
                    seen.clear()
                seen[window] = key
                rows.append((int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little", signed=True), key, firsts, window))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()))], names=names)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts, sorted by group, to settled runs of windows."""
    held: list[pa.Table] = []

    def out(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        owners = table["key"].to_numpy()
        raw, offsets = _binary(table["context"].combine_chunks())
        hit, of = _windows(table["grp"].to_numpy(), owners, raw, np.diff(offsets))
        edge = np.concatenate(([True], of[1:] != of[:-1], [True]))
        begins = np.flatnonzero(hit & (edge[:-1] | ~np.concatenate(([False], hit[:-1]))))
        ends = np.flatnonzero(hit & (edge[1:] | ~np.concatenate((hit[1:], [False]))))
        context, count = of[begins], ends - begins + 1
        begins = begins - np.searchsorted(of, context)
        # Each place of a context has its hits.
        row, places = _listed(table["firsts"].combine_chunks())
        many = np.bincount(row, minlength=table.num_rows)
        first = places.to_numpy()[_ranges((np.cumsum(many) - many)[context], many[context])] + np.repeat(begins, many[context])
        columns = np.repeat(owners[context], many[context]), first, np.repeat(count, many[context]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "first", "count"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in held) >= MAX_CONTEXTS:
            table = pa.concat_tables(held)
            groups = table["grp"].to_numpy()
            end = int(np.searchsorted(groups, groups[-1]))  # the last group may go on
            if end:
                yield out(table.slice(0, end))
            held = [table.slice(end)]
    if held:
        yield out(pa.concat_tables(held))


def _merged(row: np.ndarray, first: np.ndarray, count: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin and end of the maximal runs of bytes under runs of windows, by row and place; ``sizes``: of the rows' texts."""
    base = np.cumsum(sizes + 1) - sizes - 1  # with a gap, so that no run goes on in the next row
    order = np.argsort(base[row] + first, kind="stable")
    row, begin = row[order], first[order]
    end = begin + count[order] + MATCH - 1
    reach = np.maximum.accumulate(base[row] + end)
    starts = np.flatnonzero(np.concatenate(([True], (base[row] + begin)[1:] > reach[:-1]))) if len(row) else np.zeros(0, np.int64)
    return row[starts], begin[starts], (reach[np.append(starts[1:], len(row)) - 1] - base[row[starts]] if len(row) else starts)


def _union(lists: list) -> list[tuple[int, int]]:
    """Maximal runs of bytes under runs of windows."""
    first, count = (np.array([r[k] for runs in lists if runs for r in runs], np.int64) for k in ("first", "count"))
    _, begin, end = _merged(np.zeros(len(first), np.int64), first, count, np.zeros(1, np.int64))
    return list(zip(begin.tolist(), end.tolist()))


def _cuts(batch: pa.RecordBatch, runs: str) -> tuple[list[list[tuple[int, int]]], np.ndarray, np.ndarray]:
    """For each row what to cut, the bytes of its text and where they begin."""
    _, offsets = raw = _binary(batch.column("text"))
    row, found = _listed(batch.column(runs))
    row, begin, end = _merged(row, found.field("first").to_numpy().astype(np.int64), found.field("count").to_numpy().astype(np.int64), np.diff(offsets))
    spans = list(zip(begin.tolist(), end.tolist()))
    at = np.searchsorted(row, np.arange(batch.num_rows + 1)).tolist()
    return [spans[a:b] for a, b in zip(at, at[1:])], *raw


def spans(keyed: DataFrame) -> DataFrame:
    """key, slot, runs: for each text of ``_keyed``, the runs of windows that a document with a smaller key has too."""
    n = partitions(keyed.sparkSession)
    docs = keyed.select(F.col("__key").alias("key"), F.col("__slot").alias("slot"), F.coalesce("text", F.lit("")).alias("text"))
    slot = F.shiftright("first", POSITION_BITS).alias("slot")
    runs = store(_runs(docs))
    settled = runs.filter("grp IS NULL").select("key", "first", "count")
    open_ = runs.filter("grp IS NOT NULL").groupBy("key", slot).agg(F.collect_list(F.struct("grp", "first", "count", "hot")).alias("runs"))
    cut_out = arrow_map(docs.join(open_, ["key", "slot"]).select("key", "text", "runs"), _contexts, "grp long, key long, firsts array<long>, context binary", TEXT_ROWS)
    met = store(cut_out)
    here = met.filter("grp IS NULL").select("key", F.explode("firsts").alias("first"), F.lit(1).alias("count"))
    dealt = met.filter("grp IS NOT NULL").repartition(n, "grp").sortWithinPartitions("grp")
    matched = arrow_map(dealt, _compare, "key long, first long, count int")
    every = settled.unionByName(here).unionByName(matched)
    position = F.col("first").bitwiseAND(2**POSITION_BITS - 1).alias("first")
    return every.groupBy("key", slot).agg(F.collect_list(F.struct(position, "count")).alias("runs"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        cuts, raw, offsets = _cuts(batch, "runs")
        for cut, a, b in zip(cuts, offsets.tolist(), offsets[1:].tolist()):
            text = raw[a:b].tobytes()
            rows.append((len(text), sum(b - a for a, b in cut), len(cut), hashlib.sha256(remaining(text, cut)).hexdigest()))
        columns = list(zip(*rows)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string())))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remaining(raw: bytes, cut: list[tuple[int, int]]) -> bytes:
    """The bytes outside the runs."""
    ends = [0, *(b for _, b in cut)]
    starts = [*(a for a, _ in cut), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(ends, starts))


def _joined(docs: DataFrame) -> DataFrame:
    keyed = _keyed(docs)
    found = spans(keyed).select(F.col("key").alias("__key"), F.col("slot").alias("__slot"), F.col("runs").alias("__runs"))
    return keyed.join(found, ["__key", "__slot"], "left").drop("__key", "__slot")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = _joined(docs.select("doc_id", "text")).withColumnRenamed("__runs", "runs")
    return arrow_map(rows, _digest, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string", TEXT_ROWS)


def strip(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes taken out of ``text`` (what a cut leaves of a character goes too) and ``n_chars`` to fit."""
    names = docs.columns
    others = [n for n in names if n not in ("doc_id", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, raw, offsets = _cuts(batch, "__runs")
            made = batch.column("text").to_pylist()
            for k in (k for k, cut in enumerate(every) if cut):
                made[k] = remaining(raw[offsets[k] : offsets[k + 1]].tobytes(), every[k]).decode("utf-8", "ignore")
            columns = dict(zip(others, batch.column("others").flatten())) if others else {}
            if "n_chars" in columns:
                old = columns["n_chars"]
                columns["n_chars"] = pa.array([len(t) if r else o for t, r, o in zip(made, every, old.to_pylist())], old.type)
            columns |= {"doc_id": batch.column("doc_id"), "text": pa.array(made, pa.string())}
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    # Other columns go along in one, so that their names meet no inner ones.
    packed = docs.select("doc_id", "text", *([F.struct(*others).alias("others")] if others else []))
    return arrow_map(_joined(packed), run, docs.schema, TEXT_ROWS)
