import math
import random
import zlib
from collections import defaultdict

import numpy as np

from crossweave.llm import toxicity as tx
from tests.llm.conftest import WORDS


def corpus(n, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(5, 80))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(["Vile,", "rotten", "nasty.", "foul"]))
        rows.append((i, " ".join(words)))
        if i % 2 or i % 3 == 0:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def test_learning_against_a_plain_version():
    rng = random.Random(2)
    examples = [(sorted(rng.sample(range(50), rng.randint(1, 8))), rng.randint(0, 1)) for _ in range(300)]
    model = tx.Ftrl(size=50, alpha=0.5, beta=1.0, l1=0.3, l2=0.1)
    z, n = defaultdict(float), defaultdict(float)

    def weight(i, l1):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((1.0 + math.sqrt(n[i])) / 0.5 + (0.1 if l1 else 0.0))

    for at, y in examples:
        model.learn(np.array(at), y)
        w = {i: weight(i, 0.3) for i in at} | {"bias": weight("bias", 0)}
        p = 1 / (1 + math.exp(-sum(w.values())))
        for i in w:
            g = p - y
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.5 * w[i]
            n[i] += g * g
    at, weights = model.sparse()
    want = {i: weight(i, 0.3) for i in range(50) if weight(i, 0.3)}
    assert dict(zip(at.tolist(), weights.tolist())).keys() == want.keys()
    assert np.allclose(weights, [want[i] for i in at.tolist()])
    assert abs(model.bias() - weight("bias", 0)) < 1e-9


def test_held_out_accuracy(spark):
    rows, labels = corpus(1500)
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in tx.score(docs, known).collect()}
    assert len(got) == len(rows)
    for r in got.values():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    truth = {i: any(w in t for w in ("Vile", "rotten", "nasty", "foul")) for i, t in rows}
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) > 0.97 * len(held)
    clean = {r["doc_id"] for r in tx.keep_clean(docs, known).collect()}
    assert clean == {i for i, r in got.items() if not r["predicted"]}


def test_held_out_labels_are_not_read(spark):
    rows, labels = corpus(400)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    a, b = ({r["doc_id"]: r["score"] for r in tx.score(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()} for x in (labels, flipped))
    assert a == b


def test_odd_tables(spark, odd_docs, no_docs):
    schema = "doc_id long, quality int, toxic int"
    none = spark.createDataFrame([], schema)
    assert {r["score"] for r in tx.score(odd_docs, none).collect()} == {0.0}
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (12, 0, 1), (3, 1, 0), (8, None, 1), (9, 1, None), (None, 1, 1), (99, 0, 1), (10, 1, 0), (7, 1, 1)], schema)
    rows = tx.score(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert tx.score(no_docs, labels).count() == 0 and tx.keep_clean(no_docs, labels).count() == 0
    assert tx.keep_clean(odd_docs, labels).columns == odd_docs.columns
