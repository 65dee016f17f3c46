import hashlib

import numpy as np
from pyspark.sql import functions as F

from crossweave.llm import fingerprints


def test_order_and_edits_against_brute_force(odd_docs, spark):
    docs = odd_docs.select("doc_id", "text").unionByName(spark.range(20, 120).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.hex(F.col("id") * k) for k in range(1, 30)]).alias("text")))
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for (doc_id, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        text, following = text or "", following or ""
        k = len(text) // 3
        want.append((doc_id, len(text), hashlib.sha256((text[: len(text) - k] + following[:k]).encode()).hexdigest(), fingerprints.render(fingerprints.sketch(text))))
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = [(r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"]) for r in fingerprints.compare(docs).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_likeness(odd_docs, no_docs):
    rows = fingerprints.compare(odd_docs).collect()
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["near_next"] == 1.0 and by[2]["fingerprint"] == by[1]["fingerprint"]
    assert fingerprints.compare(no_docs).count() == 0


def test_estimates_follow_true_containment():
    words = [f"w{i}" for i in range(4000)]
    a, b = " ".join(words[:3000]), " ".join(words[2500:])
    near, _ = fingerprints.likeness(fingerprints.sketch(a), fingerprints.sketch(b))
    assert abs(near - 496 / 1496) < 0.08
    assert fingerprints.likeness(fingerprints.sketch(""), fingerprints.sketch("")) == (1.0, 1.0)
    assert fingerprints.likeness(fingerprints.sketch("a b"), fingerprints.sketch("")) == (0.0, 0.0)


def test_sketches_merge():
    text = " ".join(f"w{i * i % 997}" for i in range(900))
    whole = fingerprints.sketch(text)
    words = text.split()
    parts = [fingerprints.sketch(" ".join(words[k : k + 104])) for k in range(0, 900, 100)]
    limit = np.uint64(2**fingerprints.HASH_BITS // fingerprints.SCALE)
    merged = np.unique(np.concatenate(parts))
    assert np.array_equal(merged[merged < limit], whole[whole < limit])
    assert np.array_equal(merged[: fingerprints.LEAST], whole[: fingerprints.LEAST])


def test_short_texts_are_compared_exactly():
    words = [f"w{i}" for i in range(40)]
    for n in (5, 8, 12, 19):
        a, b = " ".join(words[:n]), " ".join(words[2 : n + 2])
        x, y = ({tuple(t.split()[i : i + 5]) for i in range(n - 4)} for t in (a, b))
        near, jaccard = fingerprints.likeness(fingerprints.sketch(a), fingerprints.sketch(b))
        assert near == len(x & y) / len(x) and jaccard == len(x & y) / len(x | y)
    long = " ".join(f"v{i}" for i in range(3000))
    inside = " ".join(f"v{i}" for i in range(100, 400))
    assert abs(fingerprints.likeness(fingerprints.sketch(inside), fingerprints.sketch(long))[0] - 1) < 1e-9


def test_ranges(spark):
    for n in (0, 1, 2, 3, 10, 57):
        bounds = [float(7 * k) for k in range(n)]
        rows = spark.range(-5, 420).select("id", fingerprints._range_of(F.col("id"), bounds).alias("b")).collect()
        assert all(r["b"] == sum(r["id"] < x for x in bounds) for r in rows)
        assert spark.sql("SELECT cast(null AS long) AS x").select(fingerprints._range_of(F.col("x"), bounds)).first()[0] == n + 1


def test_error_of_containment():
    """Against exact shingle sets, for texts of 100 to 4,000 words that share a part."""
    import random

    rng = random.Random(11)
    errors, large = [], []
    for k in range(200):
        n = rng.choice([100, 300, 1000, 4000])
        shared = rng.randint(0, n)
        a = [f"w{k}x{i}" for i in range(n)]
        b = a[:shared] + [f"v{k}x{i}" for i in range(rng.choice([50, 500, 3000]))]
        x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
        near, _ = fingerprints.likeness(fingerprints.sketch(" ".join(a)), fingerprints.sketch(" ".join(b)))
        errors.append(near - len(x & y) / min(len(x), len(y)))
        if min(len(x), len(y)) > 900:
            large.append(errors[-1])
    assert np.sqrt(np.mean(np.square(errors))) < 0.1 and abs(np.mean(errors)) < 0.02
    assert len(large) > 20 and np.sqrt(np.mean(np.square(large))) < 0.06


def test_long_texts_have_small_sketches():
    text = " ".join(f"word{i}" for i in range(20_000))
    assert len(fingerprints.render(fingerprints.sketch(text))) < len(text) / 10
