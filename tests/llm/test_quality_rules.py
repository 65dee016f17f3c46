from collections import Counter

from crossweave.llm import quality_rules


def brute(text):
    text = text or ""
    words, word = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if any(c not in " \t\n\x0b\x0c\r" for c in x)]
    dup = sum(1 for i, x in enumerate(lines) if x in lines[:i])
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_counts_against_brute_force(odd_docs):
    docs = odd_docs.select("doc_id", "text", "source").collect()
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality_rules.score(odd_docs).collect())
    assert got == Counter((r["doc_id"], *brute(r["text"])) for r in docs)


def test_verdicts(odd_docs, no_docs, spark):
    rows = quality_rules.score(odd_docs).collect()
    assert all(not r["kept"] for r in rows if r["base_failed"])
    assert {r["doc_id"] for r in rows if r["base_failed"]} >= {4, 5, 6, 7, 12}
    assert quality_rules.score(no_docs).count() == 0
    assert quality_rules.keep(no_docs).count() == 0
    kept = quality_rules.keep(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in rows if r["kept"])


def test_bad_host_takes_all_its_documents(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "short", "bad") for i in range(99)] + [(99, good, "bad")] + [(100 + i, good, f"h{i % 5}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r["doc_id"] for r in quality_rules.score(docs).filter("kept").collect()}
    assert kept == set(range(100, 200))
    assert {r["doc_id"] for r in quality_rules.keep(docs).collect()} == kept


def test_prior_leaves_out_chance(spark):
    """Many small hosts with one rate: their spread is chance, and shrinking is nearly whole."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(3)
    rows = [(f"h{h}", rng.random() < 0.3) for h in range(400) for _ in range(5)]
    got = quality_rules.host_verdicts(spark.createDataFrame(rows, "host string, base_failed boolean")).agg(F.min("shrunk_rate"), F.max("shrunk_rate")).first()
    assert 0.2 < got[0] <= got[1] < 0.45
    rows = [(f"h{h}", i < 45 * (h % 2)) for h in range(40) for i in range(50)]
    got = {r["host"]: r for r in quality_rules.host_verdicts(spark.createDataFrame(rows, "host string, base_failed boolean")).collect()}
    assert got["h1"]["shrunk_rate"] > 0.88 and got["h0"]["shrunk_rate"] < 0.02
    one = quality_rules.host_verdicts(spark.createDataFrame([("a", True)] * 3 + [("a", False)], "host string, base_failed boolean")).first()
    assert abs(one["shrunk_rate"] - 0.75) < 1e-9
