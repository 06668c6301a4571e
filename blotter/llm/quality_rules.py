"""Quality rules with host-level verdicts.

Every text is measured in its scan task.  Failures of the base rules are counted
by host (here the ``source`` column), hosts' failure rates are shrunk towards the
corpus by a beta prior whose two parameters come from all hosts (method of
moments on the rates), and a host whose shrunk rate is high is rejected: its
verdict is joined back to its documents.  The only shuffles are counts by host
and that join, in which a host is one row.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blotter.llm.common import map_slices, pick, step

SYMBOLS = "#*$%&|<>"
#: Base rules: fewer words than this, or more than this share (in percent) of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 10, 20
WINDOW = 5
#: A host is rejected if its shrunk failure rate is above this.
HOST_LIMIT = 0.5
MEASURES = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more in the list."""
    n = len(words) - window + 1
    if n < 2 or len(set(words)) == len(words):
        return 0
    grams = list(zip(*(words[i:n + i] for i in range(window)), strict=True))
    if len(set(grams)) == n:
        return 0
    count = Counter(grams)
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(np.fromiter((count[g] > 1 for g in grams), bool, n))
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover) > 0).sum())


def duplicate_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def measure(docs: DataFrame, host: str = "source") -> DataFrame:
    """MEASURES, a row per input row, from whole texts; a null text has no words."""
    rows = pick(docs, "doc_id", "text", host).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col(host).cast("string").alias("host"))

    def make():
        def work(batch):
            out = []
            for text in batch.column(1).to_pylist():
                data = text.encode()
                words = data.split()
                # code points of a word: its bytes but for the continuation bytes
                chars = sum(map(len, words)) if text.isascii() else len(b"".join(words).decode())
                out.append((len(words), chars, sum(map(data.count, SYMBOL_BYTES)), duplicate_lines(data), repeated_words(words)))
            n = dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), zip(*out, strict=True), strict=True))
            return {"doc_id": batch.column(0), "host": batch.column(2), **n}
        return work

    return map_slices(rows, make, MEASURES)


SYMBOL_BYTES = [c.encode() for c in SYMBOLS]


def base_failed() -> F.Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def host_verdicts(measured: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """host, docs, failed, rate (shrunk), rejected; rows without a host are one host, named null.

    Prior: with m and v the mean and variance of the hosts' failure rates (hosts weigh the same), a + b =
    m (1 - m) / v - 1 and a = m (a + b).  Where the rates do not vary, or vary more than a beta law can
    (v >= m (1 - m)), a + b is 1 000 000 or 1: full or little shrinking.
    """
    hosts = measured.groupBy("host").agg(F.count("*").alias("docs"), F.sum(base_failed().cast("long")).alias("failed"))
    hosts = step(hosts, "hosts")
    p = hosts.select((F.col("failed") / F.col("docs")).alias("r")).agg(F.avg("r").alias("m"), F.var_pop("r").alias("v")).first()
    m = 0.0 if p["m"] is None else p["m"]
    spread = m * (1 - m)
    weight = 1e6 if not p["v"] else min(1e6, max(1.0, spread / p["v"] - 1))
    rate = (F.col("failed") + F.lit(m * weight)) / (F.col("docs") + F.lit(weight))
    return hosts.withColumn("rate", rate).withColumn("rejected", F.col("rate") > F.lit(limit))


def judge(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """MEASURES and base_failed, host_rate, kept; a row per input row.

    A document that fails a base rule goes; of the others, those of a rejected host go.
    """
    measured = step(measure(docs, host), "measures")
    verdicts = host_verdicts(measured, limit).select(F.col("host").alias("_host"), F.col("rate").alias("host_rate"), "rejected")
    # hosts are few next to documents but not bounded: Spark broadcasts them if they are small, and splits a hot host's rows if not
    return (measured.join(verdicts, F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host")
            .withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & ~F.col("rejected")).drop("rejected"))
