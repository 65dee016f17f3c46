"""Host-level quality rules.

A document fails the base rules if it is short or mostly repeats itself. The share of failures of each
host (the ``source`` column) is shrunk towards all hosts by a beta prior whose two parameters are fitted to
the hosts' own rates by their first two moments, without the spread that small hosts have by chance. A host whose
shrunk rate is over ``reject_rate`` is rejected with everything on it.

Defined results: null and empty texts have no words, so they fail; very long texts are counted whole; a null host
is a host of its own; rows are judged one by one, whatever their doc_id (null, repeated, of any type), and repeated
rows are counted and returned as often as they occur; a host at the rate itself stays; an empty table gives an empty
result; ``score`` reads doc_id, text and source only, and ``keep`` carries all other columns whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossweave.llm.common import TEXT_ROWS, arrow_map, cut, store, texts

#: The symbols that are counted.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
#: More than this share (in percent) of repeated words fails.
MAX_REPEAT_PERCENT = 50
#: Hosts with a shrunk failure rate above this are rejected.
REJECT_RATE = 0.5
#: The least correlation of a host's documents that is told from none; the prior weighs at most its inverse in documents.
LEAST_CORRELATION = 1e-6
#: Host verdicts are broadcast up to this many hosts (some 10 MB); beyond, they are joined by a shuffle.
BROADCAST_HOSTS = 100_000
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that are found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    distinct = set(windows)
    if len(distinct) == len(windows):
        return 0
    seen: set = set()
    twice: set = set()
    for window in windows:
        (twice if window in seen else seen).add(window)
    total, upto = 0, 0
    for i, window in enumerate(windows):
        if window in twice:
            total += i + 3 - max(i, upto)
            upto = i + 3
    return total


def base_counts(text: str) -> tuple[int, int, int, int, int, bool]:
    """The counts of one text, in the order of ``BASE``."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n_words = len(words)
    joined = b"".join(words)
    # Continuation bytes are no code points of their own.
    word_chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "surrogatepass"))
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeats = repeated_words(words)
    failed = n_words < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n_words
    return n_words, word_chars, n_symbols, len(lines) - len(set(lines)), repeats, failed


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 5 + [pa.bool_()]
    names = [x.split()[0] for x in BASE.split(", ")]
    for batch in batches:
        rows = [base_counts(x) for x in texts(batch.column("text"))]
        columns = list(zip(*rows)) if rows else [()] * 6
        kept = [(n, batch.column(n)) for n in batch.schema.names if n not in ("text", *names)]
        made = [(n, pa.array(c, k)) for n, c, k in zip(names, columns, kinds)]
        yield pa.RecordBatch.from_arrays([a for _, a in kept + made], names=[n for n, _ in kept + made])


def base_rules(docs: DataFrame) -> DataFrame:
    """doc_id, source and the base counts of every document."""
    slim = docs.select("doc_id", F.col("source").cast("string").alias("host"), "text")
    kind = slim.schema["doc_id"].dataType.simpleString()
    return arrow_map(slim, _count, f"doc_id {kind}, host string, {BASE}", TEXT_ROWS)


def host_verdicts(base: DataFrame, reject_rate: float = REJECT_RATE) -> DataFrame:
    """host, n_docs, n_failed, shrunk_rate, host_kept: one row per host, from counts that are summed before the shuffle."""
    return _judged(base.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed")), reject_rate)


def _judged(hosts: DataFrame, reject_rate: float) -> DataFrame:
    rate = F.col("n_failed") / F.col("n_docs")
    moments = hosts.agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("spread"), F.avg(1 / F.col("n_docs")).alias("small"))
    mean = F.coalesce(F.col("mean"), F.lit(0.0))
    # Of rates of beta-binomial hosts the expected spread is m (1 - m) (c + (1 - c) avg(1 / n)), with c = 1 / (strength + 1).
    chance = mean * (1 - mean)
    correlation = F.when((chance > 0) & (F.col("small") < 1), (F.col("spread") / chance - F.col("small")) / (1 - F.col("small"))).otherwise(F.lit(0.0))
    strength = 1 / F.least(F.greatest(correlation, F.lit(LEAST_CORRELATION)), F.lit(1.0)) - 1
    prior = moments.select((mean * strength).alias("alpha"), ((1 - mean) * strength).alias("beta"))
    shrunk = (F.col("n_failed") + F.col("alpha")) / (F.col("n_docs") + F.col("alpha") + F.col("beta"))
    # The prior is one row, whatever the input.
    return hosts.join(F.broadcast(prior)).select("host", "n_docs", "n_failed", shrunk.alias("shrunk_rate"), (shrunk <= reject_rate).alias("host_kept"))


def _join_verdicts(base: DataFrame, hosts: DataFrame) -> DataFrame:
    hosts = cut(hosts)
    # A bounded list goes to every task; a longer one is shuffled, where adaptive execution splits hot hosts.
    few = hosts.count() <= BROADCAST_HOSTS
    return base.join(F.broadcast(hosts) if few else hosts, base["host"].eqNullSafe(hosts["host"])).drop(hosts["host"])


def score(docs: DataFrame, reject_rate: float = REJECT_RATE) -> DataFrame:
    """The base counts of every document and whether it is kept."""
    base = cut(base_rules(docs))
    joined = _join_verdicts(base, host_verdicts(base, reject_rate))
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("host_kept"))


def keep(docs: DataFrame, reject_rate: float = REJECT_RATE) -> DataFrame:
    """``docs`` without the rejected documents; all columns stay.

    Texts are read once: what passes the base rules is stored, and the failures of a host are its rows less those."""
    passing = store(arrow_map(docs, _keep_passing, docs.schema, TEXT_ROWS))
    host = F.col("source").cast("string").alias("host")
    every = docs.select(host, F.lit(1).alias("n_docs"), F.lit(1).alias("n_failed"))
    counts = every.unionAll(passing.select(host, F.lit(0), F.lit(-1))).groupBy("host").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_failed").alias("n_failed"))
    hosts = cut(_judged(counts, reject_rate))
    kept_hosts = hosts.filter("host_kept").select("host")
    few = hosts.count() <= BROADCAST_HOSTS
    on = passing["source"].cast("string").eqNullSafe(kept_hosts["host"])
    return passing.join(F.broadcast(kept_hosts) if few else kept_hosts, on, "left_semi")


def _keep_passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array([not base_counts(x)[5] for x in texts(batch.column("text"))], pa.bool_()))
