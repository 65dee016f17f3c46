import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from crossweave.llm import bpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
reference = Tokenizer.from_file(PATH)
ours = bpe.encoder(open(PATH, "rb").read())
compiled = packing.encoding(open(PATH, "rb").read())


def same(text):
    want = reference.encode(text, add_special_tokens=False).ids
    assert compiled.encode(text, allowed_special="all") == want
    assert np.frombuffer(ours.encode(text), "<u4").tolist() == want
    assert ours.decode(np.array(want, "<u4")).decode("utf-8", "replace") == reference.decode(want, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    same(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=" \n\t\r\x0b\x1c\x1d\x85\xa0 aA1é,.'s", max_size=40))
def test_white_space(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aAbe-=_ \xe9", min_size=1, max_size=200))
def test_runs(text):
    same(text)


def test_words_and_special_tokens():
    rng = random.Random(1)
    letters = "etaoinshrdlucmfwypvbgkqjxzéèüß"
    for _ in range(300):
        same(" ".join("".join(rng.choices(letters, k=rng.randint(1, 30))) for _ in range(20)))
    same("a<|endoftext|>b <|endoftext|><|endoftext|> c")
    for text in ("", " ", "  ", " a", "a ", "a  b   c", "\n\n x \n y", "a\n b\n  c"):
        same(text)


def test_long_words():
    rng = random.Random(2)
    same("ab" * 20_000)
    same("".join(rng.choices("etaoin", k=30_000)))
    same("-" * 5000 + "=" * 5000)


@pytest.mark.parametrize("text", ["x" + " " * 1_000_000 + "x", "\n" * 1_000_000, "a" + " \n\t\r\xa0" * 200_000 + "b", ("y" + " " * 3) * 250_000])
def test_long_white_space(text):
    want = np.array(reference.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert ours.encode(text) == want
    assert packing.tokeniser(open(PATH, "rb").read())(text) == want


@pytest.mark.parametrize("unit", [" ", "\n", " \t\n", "x", "y   "])
def test_time_is_linear(unit):
    import time

    def took(n):
        best = 9e9
        for _ in range(2):
            start = time.process_time()
            ours.encode("a" + unit * (n // len(unit)) + "b")
            best = min(best, time.process_time() - start)
        return best

    assert took(800_000) < 8 * took(200_000)


def test_pieces_of_long_white_space(spark):
    rows = [(1, "x" + " " * 1_200_000 + "x"), (2, "\n" * 1_000_000), (3, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["n"] for r in packing.pack(df, PATH).groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    assert found == {i: len(reference.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows}
    assert {r["doc_id"]: r["n_tokens"] + 1 for r in bpe.round_trip(df, PATH).collect()} == found


def test_every_token_is_its_own_encoding():
    alphabet = {b: c for c, b in bpe.byte_alphabet().items()}
    for id_, raw in enumerate(ours.raw[:50256]):
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            continue
        if len(ours.words.findall(text)) == 1:
            assert reference.encode(text, add_special_tokens=False).ids == [id_]


def test_small_tables(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    fresh = bpe.BytePairEncoder(open(PATH, "rb").read())
    text = "one two, three\nfour one two five six seven eight nine"
    assert np.frombuffer(fresh.encode(text), "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids


def test_documents(odd_docs, no_docs):
    got = sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(odd_docs, PATH).collect()), key=str)
    want = []
    for r in odd_docs.collect():
        ids = reference.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.round_trip(no_docs, PATH).count() == 0


@pytest.mark.parametrize("open_bins, window", [(2, 3), (50, 1), (packing.OPEN_BINS, packing.WINDOW)])
def test_packing(odd_docs, open_bins, window):
    import zlib
    from collections import defaultdict

    rows = packing.pack(odd_docs, PATH, open_bins=open_bins, window=window).collect()
    texts = defaultdict(list)
    for r in odd_docs.collect():
        texts[r["doc_id"]].append(r["text"])
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert set(by) == set(texts)
    for doc_id, own in by.items():
        ids = reference.encode(texts[doc_id][0] or "", add_special_tokens=False).ids + [2]
        copies = len(texts[doc_id])
        assert sum(r["length"] for r in own) == copies * len(ids)
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
            assert 1 <= r["length"] <= 1024 and (r["piece"] == 0 or r["length"] == 1024)
        assert len(own) == copies * -(-len(ids) // 1024)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024


def test_packer_is_tight():
    rng = random.Random(3)
    sizes = [rng.randint(1, 1024) for _ in range(5000)]
    packer = packing.Packer(open_bins=500)
    used = {}
    for size in sizes:
        bin_, offset = packer.place(size)
        assert offset == used.get(bin_, 0) and offset + size <= 1024
        used[bin_] = offset + size
        assert packer.open <= 500
    assert packer.made < 1.04 * sum(sizes) / 1024


def test_packing_nothing(no_docs):
    assert packing.pack(no_docs, PATH).count() == 0
