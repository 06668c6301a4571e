"""Exact quantiles without funnelling a column through one task.

Spark's exact ``percentile`` keeps every distinct value of a group in one
aggregation buffer, so a global median of a high-cardinality column ends up
in a single task.  Here the rank is found by bucket refinement instead:

1. one scan computes approximate cut points (``percentile_approx``) for every
   open interval;
2. one scan counts rows per bucket (``Bucketizer`` = JVM binary search) with
   min / max per bucket, and the bucket holding each wanted rank is kept;
3. once an interval holds at most ``max_local`` rows (or a single value), its
   value histogram is small enough to read and the rank is resolved exactly.

Each pass shrinks an interval by about ``buckets``; the driver only ever sees
cut points, bucket counts and bounded slices.  Interpolation follows pandas /
NumPy "linear": value at (n - 1) * p between the two neighbouring ranks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class _Slice:
    col: str
    lo: float | None  # inclusive lower bound, None = -inf
    hi: float | None  # exclusive upper bound, None = +inf (inclusive when hi_closed)
    offset: int  # number of values below lo
    size: int  # number of values in the slice
    hi_closed: bool = False
    ranks: list[int] = field(default_factory=list)

    def cond(self, v):
        c = F.lit(True)
        if self.lo is not None:
            c = c & (v >= F.lit(self.lo))
        if self.hi is not None:
            c = c & ((v <= F.lit(self.hi)) if self.hi_closed else (v < F.lit(self.hi)))
        return c


def _values(df: DataFrame, col: str):
    v = F.col(f"`{col}`").cast("double")
    return v


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float],
                    max_local: int = 100_000, buckets: int = 1000,
                    accuracy: int = 10_000) -> dict[str, list[float | None]]:
    """Exact linear-interpolated quantiles of the non-null values per column."""
    if not cols:
        return {}
    counts_row = df.agg(*[F.count_if(_values(df, c).isNotNull() & ~F.isnan(_values(df, c)))
                          .alias(f"n{i}") for i, c in enumerate(cols)]).collect()[0]
    n_of = {c: int(counts_row[f"n{i}"]) for i, c in enumerate(cols)}

    wanted: dict[str, dict[float, tuple[int, int, float]]] = {}
    open_slices: list[_Slice] = []
    for c in cols:
        n = n_of[c]
        wanted[c] = {}
        if n == 0:
            continue
        ranks = set()
        for p in probs:
            h = (n - 1) * p
            lo = int(math.floor(h))
            hi = min(lo + 1, n - 1)
            wanted[c][p] = (lo, hi, h - lo)
            ranks.update((lo, hi))
        open_slices.append(_Slice(c, None, None, 0, n, ranks=sorted(ranks)))

    resolved: dict[tuple[str, int], float] = {}
    while open_slices:
        small = [s for s in open_slices if s.size <= max_local]
        big = [s for s in open_slices if s.size > max_local]
        if small:
            _resolve_small(df, small, resolved)
        open_slices = _refine(df, big, buckets, accuracy, resolved) if big else []

    out: dict[str, list[float | None]] = {}
    for c in cols:
        vals = []
        for p in probs:
            if p not in wanted[c]:
                vals.append(None)
                continue
            lo, hi, frac = wanted[c][p]
            a, b = resolved[(c, lo)], resolved[(c, hi)]
            vals.append(a + (b - a) * frac if frac else a)
        out[c] = vals
    return out


def _stacked(df: DataFrame, items: list[tuple[int, object, object]]) -> DataFrame:
    cols = []
    for sid, x, v in items:
        cols += [F.lit(sid), x, v]
    named = [c.alias(f"__a{i}") for i, c in enumerate(cols)]
    n = len(items)
    return (df.select(*named)
            .select(F.expr(f"stack({n}, {', '.join(f'__a{i}' for i in range(len(cols)))}) AS (sid, x, v)"))
            .where(F.col("v").isNotNull()))


def _stack(df: DataFrame, slices: list[_Slice]) -> DataFrame:
    """(sid, v) for every value inside an open slice, one scan."""
    items = []
    for i, s in enumerate(slices):
        v = _values(df, s.col)
        items.append((i, F.lit(0), F.when(v.isNotNull() & ~F.isnan(v) & s.cond(v), v)))
    return _stacked(df, items).select("sid", "v")


def _resolve_small(df: DataFrame, slices: list[_Slice], resolved: dict) -> None:
    hist = (_stack(df, slices).groupBy("sid", "v").count()
            .orderBy("sid", "v").collect())
    per = {}
    for r in hist:
        per.setdefault(r["sid"], []).append((r["v"], r["count"]))
    for i, s in enumerate(slices):
        cum = s.offset
        rows = per.get(i, [])
        pending = sorted(s.ranks)
        j = 0
        for v, cnt in rows:
            cum += cnt
            while j < len(pending) and pending[j] < cum:
                resolved[(s.col, pending[j])] = float(v)
                j += 1


def _refine(df: DataFrame, slices: list[_Slice], buckets: int, accuracy: int,
            resolved: dict) -> list[_Slice]:
    fracs = [k / buckets for k in range(1, buckets)]
    # cut points only steer the search (exactness comes from the bucket counts):
    # take them from a Bernoulli sample of about 20 values per bucket
    frac = min(1.0, max(20.0 * buckets / max(1, s.size) for s in slices))
    src = df.sample(False, frac, 17) if frac < 1.0 else df
    cut_row = src.agg(*[
        F.percentile_approx(F.when(s.cond(_values(src, s.col)), _values(src, s.col)),
                            fracs, accuracy).alias(f"c{i}")
        for i, s in enumerate(slices)]).collect()[0]
    splits_array, in_cols, out_cols = [], [], []
    scan = df
    for i, s in enumerate(slices):
        cuts = sorted({float(x) for x in (cut_row[f"c{i}"] or []) if x is not None and not math.isnan(x)})
        lo = -math.inf if s.lo is None else s.lo
        cuts = [c for c in cuts if c > lo and (s.hi is None or c < s.hi)]
        if not cuts:  # the slice is dominated by its lowest value: split that value off
            cuts = [math.nextafter(lo, math.inf) if s.lo is not None else 0.0]
        splits_array.append([-math.inf] + cuts + [math.inf])
        v = _values(df, s.col)
        scan = scan.withColumn(f"__in{i}", F.when(v.isNotNull() & ~F.isnan(v) & s.cond(v), v))
        in_cols.append(f"__in{i}")
        out_cols.append(f"__b{i}")
    bucketed = Bucketizer(splitsArray=splits_array, inputCols=in_cols, outputCols=out_cols,
                          handleInvalid="keep").transform(scan)
    items = [(i, F.col(f"__b{i}").cast("int"), F.col(f"__in{i}")) for i in range(len(slices))]
    stats = (_stacked(bucketed, items).withColumnRenamed("x", "b")
             .groupBy("sid", "b")
             .agg(F.count("*").alias("n"), F.min("v").alias("mn"), F.max("v").alias("mx"))
             .orderBy("sid", "b").collect())
    per = {}
    for r in stats:
        per.setdefault(r["sid"], []).append(r)
    nxt: list[_Slice] = []
    for i, s in enumerate(slices):
        splits = splits_array[i]
        cum = s.offset
        groups: dict[int, _Slice] = {}
        pending = sorted(s.ranks)
        j = 0
        for r in per.get(i, []):
            start = cum
            cum += r["n"]
            while j < len(pending) and pending[j] < cum:
                rank = pending[j]
                j += 1
                if r["mn"] == r["mx"]:
                    resolved[(s.col, rank)] = float(r["mn"])
                    continue
                b = r["b"]
                if b not in groups:
                    lo = s.lo if b == 0 else splits[b]
                    hi = splits[b + 1]
                    last = b + 1 == len(splits) - 1
                    groups[b] = _Slice(
                        s.col, lo,
                        s.hi if last else (None if math.isinf(hi) else hi),
                        start, r["n"], hi_closed=s.hi_closed if last else False)
                groups[b].ranks.append(rank)
        nxt.extend(groups.values())
    return nxt


def median_of(df: DataFrame, cols: list[str], **kw) -> dict[str, float | None]:
    return {c: v[0] for c, v in exact_quantiles(df, cols, [0.5], **kw).items()}
