"""Chat formatting by quotation linking.

A message's lines have a quote level, the number of marks ``>`` they start with. Runs of lines of one level are
passages; their text without marks, in lower case with single spaces, is hashed, so that wrapping doesn't matter,
and so is each line of a passage of several, as many replies quote only some lines. A passage or line at level one
or more is linked to the message that has the same passage or line unquoted: the earliest of its own conversation if
it is earlier, else the earliest of all (by conv_id, turn) if that is earlier and the text has ``MIN_CHARS``
characters or more (shorter ones, as "Yes, do it", are everywhere). A message replies to the original of its first
linked passage or line of the lowest level, whole passages before their first lines. Replies make threads: a message's thread is named by the message at its
root, and messages come in reply order by (thread, depth, conv_id, turn), each after what it replies to. The
content is the message without quoted lines and without the line that announces a quotation.

All on DataFrame functions. Originals are summed up to one row for each hash (and conversation) before they are
joined, so a passage that most messages have isn't met by each of them; roots are found by pointer jumping over
the replies alone. Nothing gathers a conversation in one task.

Defined results: null texts are empty; very long texts are parsed whole; messages without conv_id or turn are never
linked and name no thread (null); rows that share (conv_id, turn) are one message for links and are returned as often
as they occur; of equal originals the earliest counts; an empty table gives an empty result; columns other than
conv_id, turn, role and text aren't read, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossweave.llm.common import store

MIN_CHARS = 12
#: A line of this form just before a quotation announces it.
ANNOUNCE = r"^On .+ wrote:[ \t]*$"
_MARKS = r"^((?:[ \t]*>)+)"


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 1), "[^>]", ""))


def _bare(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(line, _MARKS, ""), r"[ \t\r]+", " "))


def _bound(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def parse(messages: DataFrame) -> DataFrame:
    """The messages with ``__passages`` (at, level, text of each passage), ``__lines`` (the same of each line of a passage of several) and ``__content``."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    marked = F.transform(lines, lambda x: F.struct(_level(x).alias("level"), _bare(x).alias("bare"), x.alias("line")))
    # Blank lines end a passage.
    levels = lambda m: F.transform(m, lambda x: F.when(x["bare"] == "", F.lit(-1)).otherwise(x["level"]))
    nothing = F.array().cast("array<struct<at:int,level:int,short:boolean,hash:string>>")

    def hashed(at: Column, level: Column, text: Column) -> Column:
        return F.struct(at.alias("at"), level.alias("level"), (F.length(text) < MIN_CHARS).alias("short"), F.md5(text).alias("hash"))

    def passages(m: Column) -> Column:
        def runs(l: Column) -> Column:
            every = F.sequence(F.lit(1), F.size(l))
            begins = F.filter(every, lambda i: (F.get(l, i - 1) >= 0) & ~F.get(l, i - 2).eqNullSafe(F.get(l, i - 1)))
            ends = F.filter(every, lambda i: (F.get(l, i - 1) >= 0) & ~F.get(l, i).eqNullSafe(F.get(l, i - 1)))
            made = F.zip_with(begins, ends, lambda a, b: hashed(a, F.get(l, a - 1), F.lower(F.array_join(F.transform(F.slice(m, a, b - a + 1), lambda x: x["bare"]), " "))))
            several = F.filter(every, lambda i: (F.get(l, i - 1) >= 0) & (F.get(l, i - 2).eqNullSafe(F.get(l, i - 1)) | F.get(l, i).eqNullSafe(F.get(l, i - 1))))
            single = F.transform(several, lambda i: hashed(i, F.get(l, i - 1), F.lower(F.get(m, i - 1)["bare"])))
            return F.struct(F.coalesce(made, nothing).alias("whole"), F.coalesce(single, nothing).alias("lines"))

        return _bound(levels(m), runs)

    def content(m: Column) -> Column:
        kept = F.filter(m, lambda x, i: (x["level"] == 0) & ~(x["line"].rlike(ANNOUNCE) & (F.coalesce(F.get(m, i + 1)["level"], F.lit(0)) > 0)))
        return F.regexp_replace(F.regexp_replace(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"), r"^\s+|\s+\z", ""), r"\n{3,}", "\n\n")

    both = messages.select("conv_id", "turn", "role", _bound(marked, lambda m: F.struct(passages(m).alias("p"), content(m).alias("c"))).alias("made"))
    return both.select("conv_id", "turn", "role", F.col("made.p.whole").alias("__passages"), F.col("made.p.lines").alias("__lines"), F.col("made.c").alias("__content"))


def replies(parsed: DataFrame) -> DataFrame:
    """conv, turn, to_conv, to_turn: what each message that quotes another replies to."""
    units = F.explode(F.concat(F.transform("__passages", lambda p: F.struct(p.alias("p"), F.lit(0).alias("part"))), F.transform("__lines", lambda p: F.struct(p.alias("p"), F.lit(1).alias("part")))))
    known = parsed.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select(F.col("conv_id").alias("conv"), F.col("turn").alias("turn"), units.alias("u"))
    flat = known.select("conv", "turn", "u.p.*", "u.part")
    quoted = flat.filter("level > 0")
    own = flat.filter("level = 0").join(quoted.select("hash").distinct(), "hash", "left_semi")
    # Read back, originals meet quotations in plain joins, whose hot passages adaptive execution can split.
    here = store(own.groupBy("hash", "conv", "short").agg(F.min("turn").alias("here_turn")))
    first = store(here.filter("NOT short").groupBy("hash").agg(F.min(F.struct(F.col("conv").alias("conv"), F.col("here_turn").alias("turn"))).alias("first")))
    met = quoted.join(here.drop("short"), ["hash", "conv"], "left").join(first, "hash", "left")
    same = F.col("here_turn") < F.col("turn")
    before = F.col("first") < F.struct(F.col("conv").alias("conv"), F.col("turn").alias("turn"))
    target = F.when(same, F.struct(F.col("conv").alias("conv"), F.col("here_turn").alias("turn"))).when(before, F.col("first"))
    linked = met.withColumn("to", target).filter("to IS NOT NULL")
    chosen = linked.groupBy("conv", "turn").agg(F.min(F.struct("level", "at", "part", "to")).alias("best"))
    return chosen.select("conv", "turn", F.col("best.to.conv").alias("to_conv"), F.col("best.to.turn").alias("to_turn"))


def threads(links: DataFrame) -> DataFrame:
    """conv, turn, to_conv, to_turn, thread_conv, thread_turn, depth of each reply. Originals come first in (conv_id, turn), so there are no circles."""
    now = store(links.withColumns({"thread_conv": F.col("to_conv"), "thread_turn": F.col("to_turn"), "depth": F.lit(1)}))
    while True:
        above = now.select(F.col("conv").alias("thread_conv"), F.col("turn").alias("thread_turn"), F.col("thread_conv").alias("up_conv"), F.col("thread_turn").alias("up_turn"), F.col("depth").alias("up_depth"))
        joined = now.join(above, ["thread_conv", "thread_turn"], "left")
        up = F.col("up_depth").isNotNull()
        now = store(joined.select("conv", "turn", "to_conv", "to_turn", F.when(up, F.col("up_conv")).otherwise(F.col("thread_conv")).alias("thread_conv"), F.when(up, F.col("up_turn")).otherwise(F.col("thread_turn")).alias("thread_turn"), (F.col("depth") + F.coalesce("up_depth", F.lit(0))).alias("depth"), up.alias("moved")))
        if not now.filter("moved").limit(1).count():
            return now.drop("moved")
        now = now.drop("moved")


def link(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, content, n_quotes, max_level, reply_conv, reply_turn, thread_conv, thread_turn, depth of every message."""
    parsed = store(parse(messages.select("conv_id", "turn", "role", "text")))  # read several times, parsed once
    tree = threads(replies(parsed))
    tree = tree.select(*[F.col(c).alias(f"__{c}") for c in tree.columns])
    quotes = F.filter("__passages", lambda p: p["level"] > 0)
    rows = parsed.join(tree, (F.col("conv_id") == F.col("__conv")) & (F.col("turn") == F.col("__turn")), "left")
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    return rows.select(
        "conv_id",
        "turn",
        "role",
        F.col("__content").alias("content"),
        F.size(quotes).cast("long").alias("n_quotes"),
        F.coalesce(F.array_max(F.transform(quotes, lambda p: p["level"])), F.lit(0)).cast("int").alias("max_level"),
        F.col("__to_conv").alias("reply_conv"),
        F.col("__to_turn").alias("reply_turn"),
        F.when(known, F.coalesce("__thread_conv", "conv_id")).alias("thread_conv"),
        F.when(known, F.coalesce("__thread_turn", "turn")).alias("thread_turn"),
        F.coalesce("__depth", F.lit(0)).cast("int").alias("depth"),
    )
