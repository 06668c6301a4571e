"""Seeded exact sampling, top-k bucketing and row alignment.

``sample_exact`` returns the n rows with the smallest md5(key ':' seed):
exact n, independent of partitioning and plan, and reproducible in any SQL
engine that has md5.  A global ``orderBy().limit(n)`` would merge n rows from
every partition in one task; instead a hash threshold (pushed into the scan
stage, no shuffle) keeps about 1.1 n candidates first, and only those are
sorted.  If too few survive, the threshold doubles; nothing is dropped.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blotter.functions import fixed
from blotter.operators.explore import frequency

#: Keys up to which a key set is broadcast.
BROADCAST_KEYS = 1_000_000
_HEX_DIGITS = 15  # 60 bits fit a signed long
_SPACE = 16 ** _HEX_DIGITS


def sample_hash(key_col: str, seed: int = fixed.RANDOM_STATE) -> Column:
    return F.md5(F.concat(F.col(f"`{key_col}`").cast("string"), F.lit(f":{seed}")))


def sample_exact(df: DataFrame, n: int, key_col: str, seed: int = fixed.RANDOM_STATE,
                 total: int | None = None) -> DataFrame:
    """Exactly min(n, rows) rows, chosen by seeded hash order."""
    h = sample_hash(key_col, seed)
    keyed = df.withColumn("__h", h)
    total = df.count() if total is None else total
    if n >= total:
        return keyed.drop("__h")
    frac = min(1.0, (n + 6.0 * math.sqrt(n) + 10.0) / total)
    prefix = F.conv(F.substring("__h", 1, _HEX_DIGITS), 16, 10).cast("long")
    while True:
        threshold = int(frac * _SPACE)
        cand = keyed.where(prefix < F.lit(threshold)) if frac < 1.0 else keyed
        if frac >= 1.0 or cand.count() >= n:
            break
        frac = min(1.0, frac * 2.0)
    return cand.orderBy("__h", F.col(f"`{key_col}`")).limit(n).drop("__h")


def top_k_bucket(df: DataFrame, col: str, k: int = fixed.TOP_CATEGORIES, other: str = "Other",
                 keep_other: bool = True, out_col: str | None = None) -> DataFrame:
    """Keep the k most frequent values, the rest become ``other`` or are
    dropped (O5).  The top list has exactly k rows, so it is broadcast."""
    out_col = out_col or col
    top = frequency(df, col, k).select(F.col(f"`{col}`").alias("__top"))
    joined = df.join(F.broadcast(top), F.col(f"`{col}`") == F.col("__top"), "left" if keep_other else "inner")
    value = F.coalesce(F.col("__top"), F.lit(other)) if keep_other else F.col("__top")
    return joined.withColumn(out_col, value).drop("__top")


def align_semi(df: DataFrame, keys: DataFrame, key: str, keys_bounded: bool = False) -> DataFrame:
    """Rows of ``df`` whose key appears in ``keys`` (J4).  ``keys_bounded``
    marks a key set expected to be small (a sample): it is counted, and
    broadcast if it has at most ``BROADCAST_KEYS`` keys."""
    k = keys.select(key).distinct()
    small = keys_bounded and k.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return df.join(F.broadcast(k) if small else k, key, "left_semi")
