import random
import re

from crossweave.llm import license_scan as ls


def brute(text, templates=ls.TEMPLATES):
    text = text or ""
    parts = {*text.split("\n"), *re.split(r"\n[ \t\r]*\n", text), text}
    found, matched = {}, 0
    for part in parts:
        own, hit = set(ls.bigrams(part)), False
        for name, body in templates.items():
            other = set(ls.bigrams(body))
            dice = 2 * len(own & other) / (len(own) + len(other)) if own else 0
            if dice >= 0.8 - 1e-9:
                found[name], hit = max(dice, found.get(name, 0)), True
        matched += hit
    own, windows = ls.words(text), set()
    pairs = [f"{a} {b}" for a, b in zip(own, own[1:])]
    places = {}
    for name, gram, before in ls.anchors(templates, 0.8):
        places.setdefault(gram, []).append((name, before))
    for start, name in {(max(0, i - before), name) for i, g in enumerate(pairs) for name, before in places.get(g, [])}:
        other = set(ls.bigrams(templates[name]))
        part = set(pairs[start : start + len(ls.words(templates[name])) - 1])
        dice = 2 * len(part & other) / (len(part) + len(other))
        if dice >= 0.8 - 1e-9:
            found[name] = max(dice, found.get(name, 0))
            windows.add((name, start))
    best = min(found, key=lambda n: (-found[n], n)) if found else None
    return best, round(found[best], 6) if found else 0.0, ",".join(sorted(found)) or None, matched, len(windows)


def mangled(rng):
    text = rng.choice(list(ls.TEMPLATES.values()))
    words = text.split()
    for _ in range(rng.randint(0, max(1, len(words) // 6))):
        i = rng.randrange(len(words))
        words[i : i + 1] = rng.choice([[], [words[i].upper()], ["extra", words[i]], [words[i] + "\n"], ["*", words[i] + ","]])
    return rng.choice(["\n", " ", "\n\n"]).join(["", " ".join(words), ""])


def test_against_brute_force(spark, odd_docs, no_docs):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice([mangled(rng), "Some other words here, of the usual kind.\n"]) for _ in range(rng.randint(1, 4)))) for i in range(150)]
    rows += [(200 + i, t) for i, t in enumerate(ls.TEMPLATES.values())] + [(300, None), (301, ""), (302, "mit"), (302, "mit"), (303, ls.TEMPLATES["mit"] + "\n" + "word " * 50_000)]
    rows += [(400 + i, r["text"]) for i, r in enumerate(odd_docs.collect())]
    got = sorted(((r["doc_id"], r["license"], r["similarity"], r["licenses"], r["n_matches"], r["n_windows"]) for r in ls.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted(((i, *brute(t)) for i, t in rows), key=str)
    assert sum(r[1] is not None for r in got) > 50
    assert ls.scan(odd_docs).count() == odd_docs.count() and ls.scan(no_docs).count() == 0


def test_guard_words_miss_no_match():
    rng = random.Random(6)
    guards = set(ls.guard_words(ls.TEMPLATES, 0.8))
    for _ in range(1000):
        text = mangled(rng)
        assert brute(text)[0] is None or guards & set(ls.words(text))


def test_anchors_miss_no_window():
    """Every stretch of a text that is like a template has an anchor of it."""
    rng = random.Random(7)
    of = {}
    for name, gram, _ in ls.anchors(ls.TEMPLATES, 0.8):
        of.setdefault(name, set()).add(gram)
    for _ in range(400):
        own = ls.words(mangled(rng))
        pairs = [f"{a} {b}" for a, b in zip(own, own[1:])]
        for name, body in ls.TEMPLATES.items():
            other, long = set(ls.bigrams(body)), len(ls.words(body)) - 1
            for start in range(max(1, len(pairs) - long + 1)):
                part = set(pairs[start : start + long])
                if 2 * len(part & other) >= 0.8 * (len(part) + len(other)):
                    assert part & of[name]


def test_notices_wherever_they_are(spark):
    t, prose = ls.TEMPLATES, "Some words about other things that have nothing to do with it, "
    texts = {
        "gpl-3.0-header": prose + "\n\n" + t["gpl-3.0-header"].replace("version. ", "version.\n\n") + "\n\n" + prose,
        "mit-text": "/*\n" + re.sub(r"(.{0,60})( |$)", r" * \1\n", t["mit-text"] + " " + t["mit-disclaimer"]) + " */\ncode code code",
        "bsd-3-clause": prose + t["bsd-3-clause"] + " " + t["bsd-disclaimer"] + prose,
        "apache-2.0": prose * 20 + "Licensed under the Apache License, Version 2.0. " + prose * 20,
        "mpl-2.0-header": prose + t["mpl-2.0-header"] + prose,
        "unlicense": prose + re.sub(r"(.{0,40}) ", r"\1\n", t["unlicense"]) + prose,
        "zlib": prose + t["zlib"],
        "agpl-3.0-header": t["agpl-3.0-header"].replace(" ", "\n"),
        "lgpl-3.0-header": prose + t["lgpl-3.0-header"],
        None: prose * 50 + " a license, a warranty, a copyright, permission and redistribution, free software",
    }
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts.values())], "doc_id long, text string")
    got = {r["doc_id"]: r for r in ls.scan(df).collect()}
    for i, name in enumerate(texts):
        assert (name is None and got[i]["license"] is None) or name in got[i]["licenses"].split(","), (name, got[i])


def test_plan_has_no_python_and_no_shuffle(odd_docs):
    plan = ls.scan(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange|Join", plan)
