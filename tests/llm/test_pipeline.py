import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from crossweave.llm import packing, toxicity
from tests.llm.conftest import SCHEMA, prose
from tests.llm.test_quality_rules import brute as brute_counts
from tests.llm.test_simhash import brute_components, brute_fp

MATCH = 50


def corpus():
    passage = "This is a passage of well over fifty characters that many of the documents have word for word. "
    docs, labels = [], []
    for i in range(120):
        text = prose(i, 60 + i)
        if i % 5 == 0:
            text += " vile rotten"
        if i % 7 == 0:
            text = passage + text
        if i % 11 == 0:
            text = prose(i, 20)
        docs.append((i, text, "en", f"h{i % 4}", len(text)))
        labels.append((i, 1, int(i % 5 == 0)))
    docs += [(200 + i, docs[i][1], "en", "h1", docs[i][4]) for i in (1, 2, 3)] + [(210, docs[4][1] + " end", "en", "h2", 9)]
    return docs, labels


def test_every_stage_against_brute_force(spark, tmp_path):
    docs, labels = corpus()
    folder = str(tmp_path)
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "simhash", "suffix_dedup", "packing"]

    df = spark.read.parquet(f"{folder}/documents.parquet")
    names = df.columns
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(df, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    want = {d[0]: d for d in docs if scores[d[0]] < 0.3}
    assert not any(i % 5 == 0 and i < 200 and i in want and i % 11 for i in range(120))
    out = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, folder)
        df.write.parquet(f"{folder}/out-{name}")
        df = spark.read.parquet(f"{folder}/out-{name}")
        assert df.columns == names
        out[name] = {r["doc_id"]: r["text"] for r in df.collect()}
        assert len(out[name]) == df.count()

    assert out["toxicity"] == {i: d[1] for i, d in want.items()}

    # Every host has the same share of good documents, so only the base rules reject.
    def failed(text):
        n, _, _, _, repeats = brute_counts(text)
        return n < 50 or 100 * repeats > 50 * n

    want = {i: t for i, t in out["toxicity"].items() if not failed(t)}
    assert out["quality_rules"] == want and len(want) < len(out["toxicity"])

    root = brute_components({i: brute_fp(t) for i, t in want.items()})
    want = {i: t for i, t in want.items() if root[i] == i}
    assert out["simhash"] == want and not {201, 202, 203} & set(want)

    least = {}
    for i, t in want.items():
        raw = t.encode()
        for k in range(len(raw) - MATCH + 1):
            w = raw[k : k + MATCH]
            least[w] = min(i, least.get(w, i))
    cut = {}
    for i, t in want.items():
        raw, gone = t.encode(), set()
        for k in range(len(raw) - MATCH + 1):
            if least[raw[k : k + MATCH]] < i:
                gone.update(range(k, k + MATCH))
        cut[i] = bytes(c for k, c in enumerate(raw) if k not in gone).decode()
    assert out["suffix_dedup"] == cut and any(len(cut[i]) < len(want[i]) for i in cut)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = corpus_pipeline.run(spark, folder).collect()
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == set(cut)
    sequences = defaultdict(int)
    for i, own in pieces.items():
        ids = tokenizer.encode(cut[i], add_special_tokens=False).ids + [2]
        for r, (a, n) in zip(sorted(own, key=lambda r: r["piece"]), packing.cut_points(len(ids)), strict=True):
            assert (r["start"], r["length"]) == (a, n)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes())
            sequences[r["sequence_id"]] += n
    assert max(sequences.values()) <= 1024 and sum(sequences.values()) == sum(r["length"] for r in rows)


def test_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_columns_with_clashing_names(spark, odd_docs, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(i, 1, int(i == 12)) for i in (1, 2, 3, 8, 9, 10, 12)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    df = odd_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, folder)
        assert df.columns == odd_docs.columns
    corpus_pipeline.STAGES[-1][1](spark, df, folder).collect()
