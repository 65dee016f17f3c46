import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from crossweave.llm import suffix_dedup as sd


def brute(docs):
    """(doc_id, n_bytes, n_removed, n_spans, sha) by comparing all windows."""
    least = {}
    keyed = [(sd.NO_ID if d is None else d, d, (t or "").encode()) for d, t in docs]
    for key, _, raw in keyed:
        for i in range(len(raw) - 49):
            w = raw[i : i + 50]
            least[w] = min(key, least.get(w, key))
    out = []
    for key, doc_id, raw in keyed:
        gone = bytearray(len(raw))
        for i in range(len(raw) - 49):
            if least[raw[i : i + 50]] < key:
                gone[i : i + 50] = b"\1" * 50
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        out.append((doc_id, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in sd.measure(df).collect()), key=str)


def passages(seed, n_docs):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(60)]
    shared = [" ".join(rng.choices(words, k=rng.randint(8, 60))) for _ in range(6)]
    docs = []
    for i in range(n_docs):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(shared)
            a = rng.randint(0, len(p) // 2)
            parts.append(rng.choice([p, p[a:], p[: len(p) - a], " ".join(rng.choices(words, k=rng.randint(1, 40)))]))
        docs.append((i * 3, "".join(parts)))
    docs += [(1, docs[5][1]), (1000, docs[7][1]), (1001, "x" * 300), (1002, "x" * 49), (1003, "x" * 51 + "y"), (1004, "ab" * 80), (1005, "ba" * 90)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("hot, block", [(20_000, 20 << 20), (1, 600)])
def test_against_brute_force(spark, monkeypatch, hot, block):
    monkeypatch.setattr(sd, "MAX_CONTEXTS", hot)
    monkeypatch.setattr(sd, "BLOCK_BYTES", block)
    docs = passages(4, 60)
    assert run(spark, docs) == brute(docs)


def test_blocks_and_chunks_in_process(monkeypatch):
    """The whole of steps 1 to 3 without Spark, on many random corpora."""
    for seed in range(25):
        monkeypatch.setattr(sd, "CHUNK", [37, 200, 1 << 18][seed % 3])
        docs = passages(seed, 25)
        keyed = [(d, t.encode()) for d, t in docs]
        rng = random.Random(seed)
        rng.shuffle(keyed)
        blobs, covers = {}, []
        for a in range(0, len(keyed), 9):
            for bucket, kind, blob in sd._block(keyed[a : a + 9], 5):
                rows = sd._unpack(blob)
                if kind:
                    covers += list(zip(*(x.tolist() for x in rows[2:])))
                else:
                    blobs.setdefault(bucket, []).append(rows)
        groups, owners, firsts, contexts = [], [], [], []
        text = dict(keyed)
        for bucket, rows in blobs.items():
            made = sd._settle(*(np.concatenate(x) for x in zip(*rows)))
            for key, first, count, group in zip(*(made[k].tolist() for k in ("key", "first", "count", "group"))):
                if group < 0:
                    covers.append((key, first, count))
                else:
                    groups.append(group * 5 + bucket)
                    owners.append(key)
                    firsts.append(first)
                    contexts.append(text[key][first : first + count + 49])
        if contexts:
            for key, first, hits in zip(owners, firsts, sd.repeated_windows(np.array(groups), np.array(owners), contexts)):
                covers += [(key, first + int(k), 1) for k in np.flatnonzero(hits)]
        got = []
        for key, raw in keyed:
            cut = sd._union([[{"first": f, "count": c} for k, f, c in covers if k == key]])
            got.append((key, len(raw), sum(b - a for a, b in cut), len(cut), hashlib.sha256(sd.remaining(raw, cut)).hexdigest()))
        assert sorted(got, key=str) == brute(docs), seed


def test_anchors_that_agree_by_chance_are_not_compared():
    """Texts that share bytes around an anchor, though no window, need no comparison; those that share a window on either side do."""
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    core = noise(30)

    def open_runs(docs):
        rows = [sd._unpack(blob) for a in docs for _, kind, blob in sd._block([a], 1) if not kind]
        made = sd._settle(*(np.concatenate(x) for x in zip(*rows)))
        return (made["group"] >= 0).sum()

    assert open_runs([(i, (noise(100) + core + noise(100)).encode()) for i in range(300)]) == 0
    assert open_runs([(i, (noise(100) + core + noise(100)).encode() + b"tail" * (i > 297)) for i in range(300)]) == 0
    for shared in (noise(50), noise(51), noise(64)):
        assert open_runs([(i, (noise(100) + shared + noise(100)).encode()) for i in range(3)]) >= 3


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 12)), max_size=40), st.integers(0, 6))
def test_longest_previous(rows, least):
    owners = np.array([r[0] for r in rows], np.int64)
    shared = np.array([r[1] for r in rows], np.int64)
    got = sd.longest_previous(owners, shared, least)
    for i in range(len(rows)):
        want = 0
        for j in range(len(rows)):
            if owners[j] < owners[i]:
                want = max(want, shared[min(i, j) + 1 : max(i, j) + 1].min())
        assert got[i] == want if want >= max(least, 1) else got[i] < max(least, 1)


def test_odd_documents(spark, odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert run(spark, docs) == brute(docs)
    assert sd.measure(no_docs).count() == 0
    out = sd.strip(odd_docs)
    assert out.columns == odd_docs.columns
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[2]["text"] == "" and rows[2]["n_chars"] == 0
    assert rows[1]["text"] == docs[0][1] and rows[4]["text"] is None and rows[12]["text"] == "spam " * 100
    assert sd.strip(no_docs).count() == 0


@pytest.mark.parametrize("hot", [20_000, 1])
def test_texts_that_ids_do_not_tell_apart(spark, monkeypatch, hot):
    """Null ids, and an id of several texts: long and short ones, whole copies, and passages shared in part with earlier documents and each other."""
    monkeypatch.setattr(sd, "MAX_CONTEXTS", hot)
    docs = [(None if d % 2 else d % 5, t) for d, t in passages(8, 40)]
    shared = "a passage which some documents have in common, of more than fifty bytes, and a little more than that"
    docs += [(1, "first " + shared), (None, "x" * 900 + shared[10:] + "y"), (None, "z" + shared[:70]), (None, "short"), (None, None), (7, shared + "tail"), (7, "other " * 40 + shared[5:80]), (7, "")]
    docs += [docs[-2], docs[-7]]
    got = run(spark, docs)
    assert got == brute(docs)
    assert all(removed <= size for _, size, removed, _, _ in got)


@pytest.mark.parametrize("hot", [20_000, 3])
def test_texts_that_repeat_themselves(spark, monkeypatch, hot):
    monkeypatch.setattr(sd, "MAX_CONTEXTS", hot)
    docs = [(5, "abcdefg " * 4000), (3, "x" + "abcdefg " * 900 + "tail"), (8, "abcdefg " * 700 + "another end"), (9, "bcdefg a" * 30)]
    assert run(spark, docs) == brute(docs)


def test_strip_with_clashing_columns(spark):
    from pyspark.sql import functions as F

    passage = "a passage of the text that is longer than fifty bytes, which both of them have"
    df = spark.createDataFrame([(2, "one " + passage, 1), (1, "two " + passage, 2), (None, None, None)], "doc_id long, text string, n_chars int")
    for name in ("__runs", "__key", "__slot", "__h", "runs", "others", "key", "first"):
        df = df.withColumn(name, F.lit(name))
    out = sd.strip(df)
    assert out.schema == df.schema
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[1]["text"] == "two " + passage and rows[2]["text"] == "one" and rows[2]["n_chars"] == 3 and rows[2]["__runs"] == "__runs"
    bare = sd.strip(df.select("text", "doc_id"))
    assert {r["doc_id"]: r["text"] for r in bare.collect()} == {1: "two " + passage, 2: "one", None: None}
    strings = spark.createDataFrame([("b", passage), ("2", passage + "!"), ("10", passage)], "doc_id string, text string")
    assert {r["doc_id"]: r["n_removed"] for r in sd.measure(strings).collect()} == {"2": 0, "10": len(passage), "b": len(passage)}
