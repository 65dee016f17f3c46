import random

import numpy as np
import xxhash

from crossweave.llm import simhash


def brute_fp(text):
    words, word = [], b""
    for c in (text or "").encode() + b" ":
        if c in b" \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = b""
        else:
            word += bytes([c + 32 if 65 <= c <= 90 else c])
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    label = {k: k for k in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if label[b] < label[a] and (prints[a] ^ prints[b]).bit_count() <= 3:
                    label[a], changed = label[b], True
    return label


def test_fingerprints_against_brute_force(odd_docs):
    for r in odd_docs.select("text").collect():
        assert simhash.fingerprint(r["text"] or "") == brute_fp(r["text"])


def test_spark_hash_is_the_same(spark):
    got = spark.sql("SELECT xxhash64('one two three') AS h").first()["h"]
    assert got & (2**64 - 1) == xxhash.xxh64_intdigest(b"one two three", 42)


def clustered(n, seed=3):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(n // 20)]
    out = set()
    while len(out) < n:
        x = rng.choice(centres)
        for _ in range(rng.randint(0, 6)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


def test_trie_pairs_against_all_pairs():
    values = np.array(clustered(400), np.uint64)
    found = set()
    for i, j in simhash.trie_pairs(values, np.array([0]), np.array([len(values)])):
        pairs = list(zip(i.tolist(), j.tolist()))
        assert not found & set(pairs)
        found |= set(pairs)
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if (int(values[i]) ^ int(values[j])).bit_count() <= 3}
    assert found == want


def test_components_with_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MAX_GROUP", 8)  # every band value becomes several block pairs
    values = clustered(200, 5) + [int.from_bytes(b"\xff" * 8, "big"), 0, 1, 3, 7, 15]
    values += [0xABCD << 48 | 1 << k for k in range(40)]
    prints = {i: v for i, v in enumerate(dict.fromkeys(values))}
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    df = spark.createDataFrame([(signed(v), i) for i, v in prints.items()], "fp long, node long")
    from crossweave.llm.components import roots

    tree = {r["node"]: r["root"] for r in roots(simhash.links(df)).collect()}
    got = {}
    for i in prints:
        got.setdefault(tree.get(i, i), set()).add(i)
    want = {}
    for i, root in brute_components(prints).items():
        want.setdefault(root, set()).add(i)
    assert got == want


def test_documents(odd_docs, no_docs):
    rows = [(r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.components(odd_docs).collect()]
    assert len(rows) == odd_docs.count()
    ids = {d: c for d, _, c in rows}
    assert ids[1] == ids[2] == 1
    assert ids[4] == ids[5] == ids[6] == 4
    prints = {d: f for d, f, _ in rows if d is not None}
    want = brute_components(prints)
    assert all(ids[d] == want[d] for d in prints)
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(set(want.values()))
    assert simhash.components(no_docs).count() == 0
    assert simhash.keep_one(no_docs).count() == 0


def test_rows_without_ids(spark):
    text = " ".join(f"w{i}" for i in range(4000))
    near = text + " more"
    assert 0 < (brute_fp(text) ^ brute_fp(near)).bit_count() <= 3
    rows = [(None, text), (None, text), (None, "quite another text, " * 9), (5, near), (9, near + " x")]
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got.count((None, 5)) == 2 and (None, None) in got and (5, 5) in got


def test_keep_one_of_rows_that_ids_do_not_tell_apart(spark):
    texts = [" ".join(f"{k}{i}" for i in range(300)) for k in "abcde"]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (5, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (3, texts[4]), (9, None), (None, "")]
    got = sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, texts[0]), (5, texts[1]), (None, texts[2]), (7, texts[3]), (3, texts[4]), (9, None)], key=str)
    # A doc_id of two texts doesn't join their components.
    ids = {(r["doc_id"], r["fp"] & (2**64 - 1)): r["component_id"] for r in simhash.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert ids[7, brute_fp(texts[3])] == 7 and ids[7, brute_fp(texts[4])] == ids[3, brute_fp(texts[4])] == 3


def test_schemes(spark):
    assert [simhash.scheme(n) for n in (0, 10**6, 10**9, 10**11, 10**13)] == [(4, 1), (4, 1), (5, 2), (6, 3), (7, 4)]
    for bands, agree in simhash.SCHEMES:
        found = [m & (2**64 - 1) for m in simhash.masks(bands, agree)]
        rng = random.Random(bands)
        for _ in range(300):
            bits = sum(1 << b for b in rng.sample(range(64), 3))
            assert any(not bits & m for m in found)
    prints = {i: v for i, v in enumerate(clustered(150, 9))}
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    df = spark.createDataFrame([(signed(v), i) for i, v in prints.items()], "fp long, node long")
    from crossweave.llm.components import roots

    want = brute_components(prints)
    for bands, _ in simhash.SCHEMES[1:]:
        tree = {r["node"]: r["root"] for r in roots(simhash.links(df, bands)).collect()}
        assert {i: tree.get(i, i) for i in prints} == want


def test_a_long_path(spark):
    from crossweave.llm.components import roots

    order = list(range(10_000))
    random.Random(4).shuffle(order)
    df = spark.createDataFrame(list(zip(order, order[1:])), "u long, v long").repartition(4)
    tree = roots(df).collect()
    assert len(tree) == 9_999 and {r["root"] for r in tree} == {0}


def test_keep_one_is_settled_by_all_columns(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text, c, "x", "y") for c in "cabd"] + [(1, text, "a", "x", "y")]
    schema = "doc_id long, text string, source string, key string, whole string"
    first = [simhash.keep_one(spark.createDataFrame(r, schema)).collect() for r in (rows, rows[::-1])]
    assert len(first[0]) == 1 and first[0] == first[1] and first[0][0]["key"] == "x" and first[0][0]["whole"] == "y"
