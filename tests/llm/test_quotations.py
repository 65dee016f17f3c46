import re

import duckdb

from crossweave.llm import oracles, quotations

SCHEMA = "conv_id long, turn long, role string, text string"
A, B, C = "The first question is about birds.", "An answer: they fly   south in autumn.", "And what of the ones that stay?"
ROWS = [
    (1, 0, "user", A),
    (1, 1, "assistant", f"> {A}\n\n{B}"),
    (1, 2, "user", f"On Monday, someone wrote:\n> > {A.upper()}\n> {B}\n{C}"),
    (1, 3, "assistant", f">> {B}\n> {C}\nSome do stay, in fact.\n\n\n\nMany of them."),
    (1, 4, "user", "No quotation at all here."),
    (2, 0, "user", f"{A}\n> {A}\nnothing new"),
    (2, 1, "user", "> Some do stay, in fact.\nReally? So many birds?"),
    (2, 1, "user", "> Some do stay, in fact.\nReally? So many birds?"),
    (2, 2, "assistant", "> Nobody ever said this thing.\n> short\n>\n> Really? So many birds?"),
    (3, 0, "system", None),
    (3, 1, "user", ""),
    (3, 2, None, ">>>\n> \n>" ),
    (3, 3, "user", "On and on they wrote:\nwithout any quotation"),
    (None, 1, "user", f"> {A}\nfrom nowhere"),
    (4, None, "user", f"> {A}\nfrom no turn"),
    (0, 5, "user", "Really? So many birds?"),
    (6, 0, "user", "One line of three here.\nAnother line of the three.\nAnd a third one, the last."),
    (6, 1, "user", "> Another line of the three.\nOnly the second."),
    (6, 2, "user", "> Another line of the three. And a third\n> one, the last.\nWrapped, and not a whole passage."),
    (6, 3, "user", "> One line of three here. Another line\n> of the three. And a third one,\n> the last.\nWrapped anew."),
    (6, 4, "user", "Yes, do it"),
    (6, 5, "user", "> Yes, do it\nGood."),
    (7, 0, "user", "> Yes, do it\nfrom another conversation"),
    (7, 1, "user", "> unknown words of nobody\n> And a third one, the last.\n> Another line of the three.\nSome lines."),
    (5, 0, "user", "line of a long message here\n" * 3000 + f"> {A}\n" * 500),
]


def as_rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


def test_against_recursive_sql(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = quotations.link(df)
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    want = con.execute(oracles.OP4)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert as_rows(got) == sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in want.fetchall()), key=str)


def test_links(spark):
    rows = {(r["conv_id"], r["turn"]): r for r in quotations.link(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    reply = {k: (r["reply_conv"], r["reply_turn"]) for k, r in rows.items()}
    assert reply[1, 1] == (1, 0) and reply[1, 2] == (1, 1) and reply[1, 3] == (1, 2) and reply[1, 4] == (None, None)
    assert reply[2, 0] == (1, 0) and reply[2, 1] == (None, None) and reply[2, 2] == (0, 5) or reply[2, 2] == (2, 1)
    assert rows[1, 3]["depth"] == 3 and (rows[1, 3]["thread_conv"], rows[1, 3]["thread_turn"]) == (1, 0)
    assert reply[6, 1] == (6, 0) and reply[6, 3] == (6, 0) and reply[6, 5] == (6, 4) and reply[7, 0] == (None, None) and reply[7, 1] == (6, 0)
    assert rows[7, 1]["n_quotes"] == 1 and rows[2, 2]["n_quotes"] == 2
    assert rows[1, 2]["content"] == C and rows[1, 2]["max_level"] == 2
    assert rows[1, 3]["content"] == "Some do stay, in fact.\n\nMany of them."
    assert rows[3, 3]["content"] == "On and on they wrote:\nwithout any quotation"


def test_odd_tables(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("content", F.lit("clash")).withColumn("level", F.lit("clash"))
    assert quotations.link(df).count() == len(ROWS)
    assert quotations.link(df.limit(0)).count() == 0


def test_plan_has_no_python(spark):
    plan = quotations.parse(spark.createDataFrame(ROWS, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
