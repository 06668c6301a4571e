"""Data quality and cleaning.

Every profile is one aggregate pass; medians come from the exact,
distributed quantile search in :mod:`blotter.operators.stats` and are applied
as literals, so the fill needs no join at all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from blotter.functions import temporal as tf
from blotter.operators.stats import median_of
from blotter.session import materialize


def _q(c: str) -> str:
    return f"`{c}`"


def null_profile(df: DataFrame, decimals: int = 2) -> DataFrame:
    """Missing count and % per column, only columns with missing values (A1)."""
    cols = df.columns
    aggs = [F.count("*").alias("__total")] + [
        F.count_if(F.col(_q(c)).isNull()).alias(f"__n{i}") for i, c in enumerate(cols)]
    wide = df.agg(*aggs)
    stacked = wide.select(
        "__total",
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__n{i}").alias("missing_count"))
                            for i, c in enumerate(cols)])).alias("s"))
    return (stacked.select(
        "s.column", "s.missing_count",
        tf.percent(F.col("s.missing_count"), F.col("__total"), decimals).alias("missing_pct"))
        .where(F.col("missing_count") > 0))


def duplicate_count(df: DataFrame) -> DataFrame:
    """Total rows, distinct rows, duplicate rows and column count (A2).

    One shuffle on the full row; map-side partial counts absorb hot rows.
    """
    ncols = len(df.columns)
    return (df.groupBy(*[F.col(_q(c)) for c in df.columns]).count()
            .agg(F.sum("count").cast("long").alias("total_rows"),
                 F.count("*").alias("distinct_rows"),
                 F.sum(F.col("count") - 1).cast("long").alias("duplicate_rows"))
            .withColumn("total_columns", F.lit(ncols)))


def dropna_subset(df: DataFrame, subset: list[str]) -> DataFrame:
    """Drop rows missing any column of ``subset``."""
    return df.dropna(how="any", subset=subset)


def dropna_any(df: DataFrame) -> DataFrame:
    """Drop rows with a missing value in any column."""
    return df.dropna(how="any")


def dropped_rows(df: DataFrame) -> DataFrame:
    """Rows before / after the any-null drop as one aggregate (P3 report)."""
    any_null = F.lit(False)
    for c in df.columns:
        any_null = any_null | F.col(_q(c)).isNull()
    return df.agg(F.count("*").alias("rows_before"),
                  F.count_if(~any_null).alias("rows_after"),
                  F.count_if(any_null).alias("rows_dropped"))


def fill_median(df: DataFrame, cols: list[str], medians: dict | None = None, approx: bool = False) -> DataFrame:
    """Fill missing values with each column's exact median.

    Filled columns become double, since a median may end in .5.  ``approx``
    takes ``percentile_approx`` medians in one pass instead.
    """
    if medians is None and approx:
        row = df.agg(*[F.percentile_approx(F.col(_q(c)).cast("double"), 0.5).alias(f"m{i}")
                       for i, c in enumerate(cols)]).collect()[0]
        medians = {c: row[f"m{i}"] for i, c in enumerate(cols)}
    medians = median_of(df, cols) if medians is None else medians
    out = df
    for c in cols:
        m = medians.get(c)
        filled = F.col(_q(c)).cast("double")
        if m is not None:
            filled = F.coalesce(filled, F.lit(float(m)))
        out = out.withColumn(c, filled)
    return out


def fill_constant(df: DataFrame, values: dict) -> DataFrame:
    """Fill missing values with constants (P5)."""
    return df.fillna(values)


def dedup_rows(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Exact-row dedup; missing values compare equal."""
    return df.dropDuplicates(subset) if subset else df.dropDuplicates()


def audited(df: DataFrame, steps: list[tuple[str, Callable[[DataFrame], DataFrame]]], path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(result, audit): ``df`` after the steps, written (to ``path`` or the scratch folder), and (step_no, step, rows) (A3).

    Each step's rows are counted by ``observe`` in the very pass that cleans and writes, so the audit costs no further scan.
    """
    seen = []

    def watch(frame: DataFrame, name: str) -> DataFrame:
        seen.append((name, Observation()))
        return frame.observe(seen[-1][1], F.count(F.lit(1)).alias("rows"))

    out = watch(df, "input")
    for name, step in steps:
        out = watch(step(out), name)
    if path is None:
        out = materialize(out, "audited")
    else:
        out.write.mode("overwrite").parquet(path)
        out = df.sparkSession.read.parquet(path)
    rows = [(i, name, o.get["rows"]) for i, (name, o) in enumerate(seen)]
    return out, df.sparkSession.createDataFrame(rows, "step_no int, step string, rows long")


def cleaning_audit(df: DataFrame, steps: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """The audit of :func:`audited`: row count after each cleaning step as (step_no, step, rows) (A3)."""
    return audited(df, steps)[1]


def range_checks(df: DataFrame, cols: list[str]) -> DataFrame:
    """min / max per column in one pass, stacked to (column, min, max) as text."""
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.min(_q(c)).cast("string").alias(f"mn{i}"), F.max(_q(c)).cast("string").alias(f"mx{i}")]
    wide = df.agg(*aggs)
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"mn{i}").alias("min_value"), F.col(f"mx{i}").alias("max_value"))
        for i, c in enumerate(cols)])).alias("s")).select("s.*")


def clean_incidents(raw: DataFrame, coord_cols=("Latitude", "Longitude"),
                    median_cols=("District", "Ward", "Community Area"),
                    constant_fills=None) -> DataFrame:
    """Stage 1 cleaning: coordinate drop, median fill, constant fill, dedup.

    Medians are taken after the coordinate drop and before dedup.
    """
    constant_fills = {"Location Description": "UNKNOWN"} if constant_fills is None else constant_fills
    kept = dropna_subset(raw, list(coord_cols))
    present = [c for c in median_cols if c in kept.columns]
    filled = fill_median(kept, present)
    filled = fill_constant(filled, {k: v for k, v in constant_fills.items() if k in filled.columns})
    return dedup_rows(filled)
