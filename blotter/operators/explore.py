"""Exploratory aggregates.

Tie rule everywhere: larger count first, then key ascending.  Every
aggregate runs as partial + final hash aggregation, so a key holding a third
of the rows is combined map-side before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blotter.functions import fixed
from blotter.functions import temporal as tf
from blotter.operators.stats import exact_quantiles


def _c(c) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def frequency(df: DataFrame, col: str, n: int | None = None, name: str = "count") -> DataFrame:
    """value_counts: missing keys skipped, count descending, key ascending (A4, O1, O2)."""
    out = (df.where(_c(col).isNotNull()).groupBy(_c(col).alias(col)).agg(F.count("*").alias(name))
           .orderBy(F.desc(name), F.asc(col)))
    return out.limit(n) if n is not None else out


def counts_by(df: DataFrame, key, name: str = "key", count_name: str = "count") -> DataFrame:
    """Count per key in key order, missing keys skipped."""
    k = _c(key)
    return (df.select(k.alias(name)).where(F.col(name).isNotNull())
            .groupBy(name).agg(F.count("*").alias(count_name)).orderBy(name))


def share_of_total(df: DataFrame, col: str, decimals: int = 1) -> DataFrame:
    """Count and % of total per value (A7).  The total is one aggregate, joined as a single row."""
    counts = frequency(df, col)
    total = F.lit(df.where(_c(col).isNotNull()).count())
    return counts.withColumn("pct", tf.percent(F.col("count"), total, decimals)).orderBy(F.desc("count"), col)


def overall_rates(df: DataFrame, flags: list[str], decimals: int | None = None) -> DataFrame:
    """Mean of boolean columns in %."""
    aggs = []
    for f in flags:
        r = F.avg(_c(f).cast("double")) * 100.0
        aggs.append((r if decimals is None else F.bround(r, decimals)).alias(f"{f}_rate"))
    return df.agg(*aggs)


def rate_by_group(df: DataFrame, group: str, flag: str, n: int = 15,
                  decimals: int | None = 2) -> DataFrame:
    """Boolean rate in % per group, top n descending."""
    r = F.avg(_c(flag).cast("double")) * 100.0
    if decimals is not None:
        r = F.bround(r, decimals)
    out = (df.where(_c(group).isNotNull()).groupBy(_c(group).alias(group))
           .agg(r.alias("rate"), F.count("*").alias("n"))
           .orderBy(F.desc("rate"), F.asc(group)))
    return out.limit(n) if n else out


def describe_columns(df: DataFrame, cols: list[str], decimals: int = 3, approx: bool = False) -> DataFrame:
    """count, mean, sample sd, min, quartiles, max per column (A10).

    Quartiles are exact (pandas' linear interpolation) unless ``approx``, which
    takes them from ``percentile_approx`` in the same single pass."""
    spark = df.sparkSession
    aggs = []
    for i, c in enumerate(cols):
        x = _c(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    if approx:
        aggs += [F.percentile_approx(_c(c).cast("double"), [0.25, 0.5, 0.75]).alias(f"q{i}")
                 for i, c in enumerate(cols)]
    basic = df.agg(*aggs).collect()[0]
    quart = ({c: list(basic[f"q{i}"] or [None] * 3) for i, c in enumerate(cols)} if approx
             else exact_quantiles(df, cols, [0.25, 0.5, 0.75]))
    rows = []
    for i, c in enumerate(cols):
        q = quart.get(c, [None, None, None])
        rows.append((c, int(basic[f"n{i}"]), basic[f"m{i}"], basic[f"s{i}"], basic[f"lo{i}"],
                     q[0], q[1], q[2], basic[f"hi{i}"]))
    schema = ("column string, count long, mean double, std double, min double, q25 double, "
              "q50 double, q75 double, max double")
    out = spark.createDataFrame(rows, schema)
    return out.select("column", "count", *[F.bround(c, decimals).alias(c)
                                           for c in ["mean", "std", "min", "q25", "q50", "q75", "max"]])


def distinct_counts(df: DataFrame, cols: list[str], approx: bool = False) -> DataFrame:
    """Number of distinct non-missing values per column."""
    fn = F.approx_count_distinct if approx else F.count_distinct
    return df.agg(*[fn(_c(c)).alias(f"{c}_distinct") for c in cols])


def distinct_sorted(df: DataFrame, col: str, add_all: bool = False) -> DataFrame:
    """Sorted distinct option list, optionally with "All" first."""
    vals = df.where(_c(col).isNotNull()).select(_c(col).cast("string").alias("option")).distinct()
    vals = vals.withColumn("position", F.lit(1))
    if add_all:
        vals = df.sparkSession.range(1).select(F.lit("All").alias("option"), F.lit(0).alias("position")) \
            .unionByName(vals)
    return vals.orderBy("position", "option").drop("position")


def top_n_rows(df: DataFrame, order_cols: list, n: int = 5) -> DataFrame:
    """First n rows in a stated order (P14); the order makes it deterministic."""
    return df.orderBy(*order_cols).limit(n)


def filter_isin(df: DataFrame, col: str, values: list | None, negate: bool = False) -> DataFrame:
    """Membership filter; an empty list keeps every row."""
    if not values:
        return df
    cond = _c(col).isin(*values)
    return df.where(~cond if negate else cond)


def filter_choice(df: DataFrame, col: str, chosen: str | None) -> DataFrame:
    """Equality filter where "All" (or None) passes everything."""
    if chosen is None or chosen == "All":
        return df
    return df.where(_c(col) == F.lit(chosen))


def dow_hour_heatmap(df: DataFrame, ts_col: str, type_col: str | None = None,
                     chosen: str | None = None) -> DataFrame:
    """Day-of-week x hour incident counts in week order.

    Day number and name come straight from the timestamp, so ordering needs
    no join; one shuffle on (day, hour) after map-side partial counts.
    """
    src = filter_choice(df, type_col, chosen) if type_col else df
    t = _c(ts_col)
    return (src.where(t.isNotNull())
            .groupBy(tf.day_number(t).alias("day_no"), tf.day_name(t).alias("day_of_week"),
                     tf.hour_of(t).alias("hour"))
            .agg(F.count("*").alias("count"))
            .orderBy("day_no", "hour"))


def peak(df: DataFrame, key, name: str = "key") -> DataFrame:
    """Arg-max key and its count, ties to the smaller key."""
    return counts_by(df, key, name).orderBy(F.desc("count"), F.asc(name)).limit(1)


def mode_per_group(df: DataFrame, group: str, value: str) -> DataFrame:
    """Most frequent value per group, ties to the smaller value.

    Counts per (group, value) are pre-aggregated, then the winner is a
    ``min(struct(-count, value))`` aggregate: partial + final, no window
    sort, so a hot group never lands whole in one task.
    """
    counts = (df.where(_c(group).isNotNull() & _c(value).isNotNull())
              .groupBy(_c(group).alias(group), _c(value).alias(value)).agg(F.count("*").alias("n")))
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col(f"`{value}`").alias("v")))
    return (counts.groupBy(group).agg(best.alias("b"))
            .select(group, F.col("b.v").alias(f"mode_{value}"), (-F.col("b.neg")).alias("mode_count")))


def domain_counts(df: DataFrame, col: str, domain: list[str], name: str = "value") -> DataFrame:
    """Counts for every domain value in domain order, absent -> NULL."""
    spark: SparkSession = df.sparkSession
    dim = spark.createDataFrame([(i, v) for i, v in enumerate(domain)], f"position int, {name} string")
    counts = (df.where(_c(col).isNotNull()).groupBy(_c(col).alias(name)).agg(F.count("*").alias("count")))
    # both sides are tiny after aggregation; the preserved side is the fixed domain
    return dim.join(counts, name, "left").orderBy("position").drop("position")


def dow_counts_complete(df: DataFrame, day_col: str) -> DataFrame:
    return domain_counts(df, day_col, fixed.DAY_ORDER, "day_of_week")


def group_profile(df: DataFrame, group: str, type_col: str, flag: str,
                  score: str | None = None, hour: str | None = None,
                  decimals: int = 2) -> DataFrame:
    """Cluster profile (A15, A16): size (rows with a type), dominant type, flag
    rate %, mean score / hour, all rounded to ``decimals``; the day-part label
    is judged on the rounded mean hour."""
    aggs = [F.count(_c(type_col)).alias("size"),
            F.bround(F.avg(_c(flag).cast("double")) * 100.0, decimals).alias(f"{flag}_rate")]
    if score:
        aggs.append(F.bround(F.avg(_c(score)), decimals).alias(f"mean_{score}"))
    if hour:
        aggs.append(F.bround(F.avg(_c(hour)), decimals).alias("mean_hour"))
    prof = df.groupBy(_c(group).alias(group)).agg(*aggs)
    dom = mode_per_group(df, group, type_col)
    out = prof.join(dom.select(group, F.col(f"mode_{type_col}").alias("dominant_type")), group, "left")
    if hour:
        out = out.withColumn("period", tf.period_label(F.col("mean_hour"), decimals))
    return out.orderBy(group)


def cluster_hour_counts(df: DataFrame, cluster: str, hour) -> DataFrame:
    """Counts per (cluster, hour) in key order."""
    return (df.groupBy(_c(cluster).alias("cluster"), _c(hour).alias("hour")).agg(F.count("*").alias("count"))
            .orderBy("cluster", "hour"))


def schema_listing(df: DataFrame) -> DataFrame:
    """Column names and Spark types in table order (P14, the ``dtypes`` listing)."""
    rows = [(i, name, dtype) for i, (name, dtype) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string")
