"""Feature engineering.

Fitted statistics (min / max, mean / sd, bin edges) come from one aggregate
job each and are applied as literals inside codegen'd expressions, so the
transform is a narrow map over the table: no join, no shuffle.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blotter.functions import fixed
from blotter.operators.ranking import number_sorted
from blotter.functions import temporal as tf


def _c(c) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def encode_temporal(df: DataFrame, day_col: str = "Day_of_Week", season_col: str = "Season",
                    weekend_col: str = "Is_Weekend") -> DataFrame:
    """Day -> 0..6, season -> 0..3 (absent -> 0), weekend flag -> 0/1."""
    return (df.withColumn("DayOfWeek_Num", tf.ordinal_of(_c(day_col), fixed.DAY_ORDER))
            .withColumn("Season_Num", tf.ordinal_of(_c(season_col), fixed.SEASON_ORDER))
            .withColumn("Is_Weekend_Num", _c(weekend_col).cast("int")))


def label_codes(df: DataFrame, col: str) -> DataFrame:
    """(value, code): distinct values as text, missing as "nan", numbered in ascending order."""
    return number_sorted(df.select(F.coalesce(_c(col).cast("string"), F.lit("nan")).alias("value")), "value", "code")


def label_encode(df: DataFrame, cols: list[str], suffix: str = "_Enc", return_models: bool = False):
    """Codes 0..n-1 by sorted class name; missing is the class "nan" (E2).

    The distinct labels of a column are sorted and numbered in ranges on the executors and joined back: a column
    with as many labels as rows is a shuffle, not a list on the driver; Spark broadcasts a small code table by its
    size.  ``return_models`` also gives {column: (value, code) table} for persistence (S10).
    """
    out, models = df, {}
    for i, c in enumerate(cols):
        codes = models[c] = label_codes(df, c)
        side = codes.select(F.col("value").alias(f"__v{i}"), F.col("code").cast("int").alias(f"{c}{suffix}"))
        out = out.withColumn(f"__t{i}", F.coalesce(_c(c).cast("string"), F.lit("nan"))).join(side, F.col(f"__t{i}") == F.col(f"__v{i}"), "left").drop(f"__t{i}", f"__v{i}")
    return (out, models) if return_models else out


def min_max(df: DataFrame, cols: list[str]) -> dict[str, tuple[float | None, float | None]]:
    """min and max of several columns in one aggregate pass."""
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.min(_c(c).cast("double")).alias(f"mn{i}"), F.max(_c(c).cast("double")).alias(f"mx{i}")]
    r = df.agg(*aggs).collect()[0]
    return {c: (r[f"mn{i}"], r[f"mx{i}"]) for i, c in enumerate(cols)}


def cut_edges(mn: float | None, mx: float | None, bins: int) -> list[float] | None:
    """Equal-width edges as the right-closed pandas cut builds them."""
    if mn is None or mx is None:
        return None
    if mn == mx:
        pad = 0.001 * abs(mn) if mn != 0 else 0.001
        return [float(x) for x in np.linspace(mn - pad, mx + pad, bins + 1, endpoint=True)]
    edges = np.linspace(mn, mx, bins + 1, endpoint=True)
    edges[0] -= (mx - mn) * 0.001
    return [float(x) for x in edges]


def bin_expr(col, edges: list[float] | None) -> Column:
    """Right-closed bin number = count of inner edges strictly below x."""
    if edges is None:
        return F.lit(None).cast("int")
    x = _c(col).cast("double")
    total = F.lit(0)
    for e in edges[1:-1]:
        total = total + (x > F.lit(e)).cast("int")
    return F.when(x.isNotNull() & (x > F.lit(edges[0])) & (x <= F.lit(edges[-1])), total)


def equal_width_bins(df: DataFrame, cols: dict[str, str], bins: int = fixed.GRID_BINS,
                     fill: int | None = 0, stats: dict | None = None) -> DataFrame:
    """Equal-width binning of several columns (E3); ``cols`` maps input -> output."""
    stats = min_max(df, list(cols)) if stats is None else stats
    out = df
    for c, name in cols.items():
        e = bin_expr(c, cut_edges(stats[c][0], stats[c][1], bins))
        out = out.withColumn(name, F.coalesce(e, F.lit(fill)) if fill is not None else e)
    return out


def grid_id(lat_bin: str, lon_bin: str, lon_bins: int = fixed.GRID_BINS) -> Column:
    """Cell id of two bin numbers."""
    return _c(lat_bin) * F.lit(lon_bins) + _c(lon_bin)


def minmax_scale(df: DataFrame, cols: dict[str, str], stats: dict | None = None) -> DataFrame:
    """(x - min) / (max - min); a constant column scales to 0 (E5)."""
    stats = min_max(df, list(cols)) if stats is None else stats
    out = df
    for c, name in cols.items():
        mn, mx = stats[c]
        x = _c(c).cast("double")
        if mn is None:
            out = out.withColumn(name, F.lit(None).cast("double"))
        elif mx == mn:
            out = out.withColumn(name, F.when(x.isNotNull(), F.lit(0.0)))
        else:
            out = out.withColumn(name, (x - F.lit(mn)) / F.lit(mx - mn))
    return out


def fit_standard(df: DataFrame, cols: list[str]) -> dict[str, tuple[float | None, float | None]]:
    aggs = []
    for i, c in enumerate(cols):
        x = _c(c).cast("double")
        aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
    r = df.agg(*aggs).collect()[0]
    return {c: (r[f"m{i}"], r[f"s{i}"]) for i, c in enumerate(cols)}


def standard_scale(df: DataFrame, cols: dict[str, str], stats: dict | None = None) -> DataFrame:
    """(x - mean) / population sd; zero sd scales to 0."""
    stats = fit_standard(df, list(cols)) if stats is None else stats
    out = df
    for c, name in cols.items():
        m, s = stats[c]
        x = _c(c).cast("double")
        if m is None:
            out = out.withColumn(name, F.lit(None).cast("double"))
        elif not s:
            out = out.withColumn(name, F.when(x.isNotNull(), F.lit(0.0)))
        else:
            out = out.withColumn(name, (x - F.lit(m)) / F.lit(s))
    return out


FEATURE_COLS = [
    "Hour", "DayOfWeek_Num", "Month", "Season_Num", "Is_Weekend_Num",
    "Primary Type_Enc", "Location Description_Enc", "Crime_Severity_Score", "Arrest", "Domestic",
    "Lat_Scaled", "Lon_Scaled", "Lat_Bin", "Lon_Bin", "Grid_ID",
    "District", "Beat", "Community Area", "Ward",
]

META_COLS = [
    "ID", "Date", "Primary Type", "Description", "Location Description", "Season", "Day_of_Week",
    "Latitude", "Longitude", "Year", "Arrest", "Domestic", "Crime_Severity_Score",
]


def engineer(cleaned: DataFrame, lat: str = "Latitude", lon: str = "Longitude",
             categoricals=("Primary Type", "Location Description"), bins: int = fixed.GRID_BINS) -> DataFrame:
    """Stage 3 derived columns on the cleaned table.

    Two fitting passes: one aggregate for the coordinate ranges (shared by
    binning and scaling) and one multi-column label index.
    """
    out = encode_temporal(cleaned)
    out = label_encode(out, [c for c in categoricals if c in out.columns])
    stats = min_max(cleaned, [lat, lon])
    out = equal_width_bins(out, {lat: "Lat_Bin", lon: "Lon_Bin"}, bins, stats=stats)
    out = out.withColumn("Grid_ID", grid_id("Lat_Bin", "Lon_Bin", bins))
    return minmax_scale(out, {lat: "Lat_Scaled", lon: "Lon_Scaled"}, stats=stats)


def feature_matrix(engineered: DataFrame, feature_cols: list[str] | None = None,
                   meta_cols: list[str] | None = None, key: str = "row_key",
                   bool_cols=("Arrest", "Domestic")) -> tuple[DataFrame, DataFrame]:
    """Numeric matrix (booleans as 0/1, rows with any NULL dropped) and the
    metadata of the same rows, both carrying ``key`` (E7, P1, P3, P7, J4).

    The metadata is selected from the same filtered rows, so no join is
    needed to align them.
    """
    feature_cols = FEATURE_COLS if feature_cols is None else feature_cols
    meta_cols = META_COLS if meta_cols is None else meta_cols
    feats = []
    for c in feature_cols:
        col = _c(c).cast("int") if c in bool_cols else _c(c)
        feats.append(col.alias(f"__f_{c}"))
    wide = engineered.select(_c(key), *feats, *[_c(m).alias(f"__m_{m}") for m in meta_cols])
    any_null = F.lit(False)
    for c in feature_cols:
        any_null = any_null | F.col(f"`__f_{c}`").isNull()
    kept = wide.where(~any_null)
    X = kept.select(key, *[F.col(f"`__f_{c}`").alias(c) for c in feature_cols])
    meta = kept.select(key, *[F.col(f"`__m_{m}`").alias(m) for m in meta_cols])
    return X, meta


def feature_rows(engineered: DataFrame, extra=("Primary Type", "Season"), feature_cols: list[str] | None = None,
                 key: str = "row_key", bool_cols=("Arrest", "Domestic")) -> DataFrame:
    """The rows of :func:`feature_matrix` with some metadata beside the features, from one scan."""
    names = FEATURE_COLS if feature_cols is None else feature_cols
    cols = [(_c(c).cast("int") if c in bool_cols else _c(c)).alias(c) for c in names]
    some_null = F.lit(False)
    for c in names:
        some_null = some_null | _c(c).isNull()
    return engineered.where(~some_null).select(_c(key), *cols, *[_c(m) for m in extra])
