"""Catalogue part 1: exploratory aggregates, lookups, time features, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from blotter.functions import fixed
from blotter.functions import temporal as tf
from blotter.operators import explore as ex
from blotter.operators import prepare, sampling
from blotter.plans import sqlparts as sq
from blotter.plans import tables as T
from blotter.plans.registry import query

# --- A13 / A14 / O3 ----------------------------------------------------------


@query("dow_hour_heatmap", f"""
SELECT {sq.weekday('ts')} AS day_no, dayname(ts) AS day_of_week, CAST(hour(ts) AS INTEGER) AS hour,
       count(*) AS count
FROM events WHERE ts IS NOT NULL GROUP BY 1, 2, 3 ORDER BY 1, 3""")
def dow_hour_heatmap(spark, sf):
    return ex.dow_hour_heatmap(T.table(spark, sf, "events"), "ts")


@query("heatmap_filtered", f"""
SELECT {sq.weekday('ts')} AS day_no, dayname(ts) AS day_of_week, CAST(hour(ts) AS INTEGER) AS hour,
       count(*) AS count
FROM events WHERE ts IS NOT NULL AND event_type = 'error' GROUP BY 1, 2, 3 ORDER BY 1, 3""")
def heatmap_filtered(spark, sf):
    return ex.dow_hour_heatmap(T.table(spark, sf, "events"), "ts", "event_type", "error")


@query("peak_hour", """
SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS count
FROM events WHERE ts IS NOT NULL GROUP BY 1 ORDER BY count DESC, hour LIMIT 1""")
def peak_hour(spark, sf):
    return ex.peak(T.table(spark, sf, "events"), tf.hour_of("ts"), "hour")


# --- A4 / A5 / A6 / A7 / O1 / O2 -----------------------------------------------


@query("type_counts_topn", """
SELECT p_brand, count(*) AS count FROM part WHERE p_brand IS NOT NULL
GROUP BY 1 ORDER BY count DESC, p_brand LIMIT 10""")
def type_counts_topn(spark, sf):
    return ex.frequency(T.table(spark, sf, "part"), "p_brand", 10)


@query("event_type_counts", """
SELECT event_type, count(*) AS count FROM events WHERE event_type IS NOT NULL
GROUP BY 1 ORDER BY count DESC, event_type""")
def event_type_counts(spark, sf):
    return ex.frequency(T.table(spark, sf, "events"), "event_type")


@query("severity_counts", """
SELECT p_size, count(*) AS count FROM part WHERE p_size IS NOT NULL GROUP BY 1 ORDER BY 1""")
def severity_counts(spark, sf):
    return ex.counts_by(T.table(spark, sf, "part"), "p_size", "p_size")


@query("season_share", f"""
WITH s AS (SELECT {sq.season_case('month(o_orderdate)')} AS season FROM orders),
c AS (SELECT season, count(*) AS count FROM s WHERE season IS NOT NULL GROUP BY 1)
SELECT season, count,
       round_even(CAST(count AS DOUBLE) * 100.0 / CAST(sum(count) OVER () AS DOUBLE), 1) AS pct
FROM c ORDER BY count DESC, season""")
def season_share(spark, sf):
    o = T.table(spark, sf, "orders").select(tf.season_of_month(tf.month_of("o_orderdate")).alias("season"))
    return ex.share_of_total(o, "season", 1)


@query("hourly_counts", """
SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS count FROM events
WHERE ts IS NOT NULL GROUP BY 1 ORDER BY 1""")
def hourly_counts(spark, sf):
    return ex.counts_by(T.table(spark, sf, "events"), tf.hour_of("ts"), "hour")


@query("monthly_counts", """
SELECT CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS count FROM orders
WHERE o_orderdate IS NOT NULL GROUP BY 1 ORDER BY 1""")
def monthly_counts(spark, sf):
    return ex.counts_by(T.table(spark, sf, "orders"), tf.month_of("o_orderdate"), "month")


@query("yearly_counts", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS count FROM orders
WHERE o_orderdate IS NOT NULL GROUP BY 1 ORDER BY 1""")
def yearly_counts(spark, sf):
    return ex.counts_by(T.table(spark, sf, "orders"), tf.year_of("o_orderdate"), "year")


# --- A8 / A9 -----------------------------------------------------------------------


@query("overall_rates", f"""
WITH {sq.INCIDENTS.strip()}
SELECT round_even(avg(CAST("Arrest" AS DOUBLE)) * 100.0, 6) AS "Arrest_rate",
       round_even(avg(CAST("Domestic" AS DOUBLE)) * 100.0, 6) AS "Domestic_rate"
FROM incidents""")
def overall_rates(spark, sf):
    return ex.overall_rates(T.incidents(spark, sf), ["Arrest", "Domestic"], 6)


@query("rate_by_type_top15", """
WITH j AS (SELECT p.p_brand, l.l_returnflag FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)
SELECT p_brand, round_even(avg(CAST(l_returnflag = 'R' AS DOUBLE)) * 100.0, 2) AS rate, count(*) AS n
FROM j WHERE p_brand IS NOT NULL GROUP BY 1 ORDER BY rate DESC, p_brand LIMIT 15""")
def rate_by_type_top15(spark, sf):
    li = T.table(spark, sf, "lineitem").select("l_partkey", (F.col("l_returnflag") == "R").alias("returned"))
    part = T.table(spark, sf, "part").select("p_partkey", "p_brand")
    j = li.join(part, li.l_partkey == part.p_partkey)
    return ex.rate_by_group(j, "p_brand", "returned", 15, 2)


# --- A10 / A11 / A12 / P13 / P14 ------------------------------------------------------

_DESCRIBE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _describe_sql(cols):
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS \"column\", count({x}) AS count, round_even(avg({x}), 3) AS mean, "
            f"round_even(stddev_samp({x}), 3) AS std, round_even(min({x}), 3) AS min, "
            f"round_even(quantile_cont({x}, 0.25), 3) AS q25, round_even(quantile_cont({x}, 0.5), 3) AS q50, "
            f"round_even(quantile_cont({x}, 0.75), 3) AS q75, round_even(max({x}), 3) AS max FROM lineitem")
    return "\nUNION ALL\n".join(parts)


@query("describe_columns", _describe_sql(_DESCRIBE_COLS))
def describe_columns(spark, sf):
    return ex.describe_columns(T.table(spark, sf, "lineitem"), _DESCRIBE_COLS, 3)


@query("distinct_counts", """
SELECT count(DISTINCT event_type) AS event_type_distinct, count(DISTINCT user_id) AS user_id_distinct
FROM events""")
def distinct_counts(spark, sf):
    return ex.distinct_counts(T.table(spark, sf, "events"), ["event_type", "user_id"])


@query("distinct_sorted", """
SELECT option FROM (
  SELECT 'All' AS option, 0 AS position
  UNION ALL
  SELECT DISTINCT CAST(event_type AS VARCHAR) AS option, 1 AS position FROM events WHERE event_type IS NOT NULL
) ORDER BY position, option""")
def distinct_sorted(spark, sf):
    return ex.distinct_sorted(T.table(spark, sf, "events"), "event_type", add_all=True)


@query("range_checks", """
SELECT 'ts' AS "column", CAST(min(ts) AS VARCHAR) AS min_value, CAST(max(ts) AS VARCHAR) AS max_value FROM events
UNION ALL
SELECT 'user_id', CAST(min(user_id) AS VARCHAR), CAST(max(user_id) AS VARCHAR) FROM events
UNION ALL
SELECT 'event_type', min(event_type), max(event_type) FROM events""")
def range_checks(spark, sf):
    from blotter.operators.quality import range_checks as rc
    return rc(T.table(spark, sf, "events"), ["ts", "user_id", "event_type"])


@query("top_n_rows", """
SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 5""")
def top_n_rows(spark, sf):
    return ex.top_n_rows(T.table(spark, sf, "orders"), ["o_orderdate", "o_orderkey"], 5)


# --- P8 / P9 / J3 -------------------------------------------------------------------


@query("filter_isin", """
SELECT event_id, event_type, value FROM events WHERE event_type IN ('click', 'view')""")
def filter_isin(spark, sf):
    ev = T.table(spark, sf, "events").select("event_id", "event_type", "value")
    return ex.filter_isin(ev, "event_type", ["click", "view"])


@query("filter_not_isin", """
SELECT event_id, event_type, value FROM events WHERE NOT (event_type IN ('click', 'view'))""")
def filter_not_isin(spark, sf):
    ev = T.table(spark, sf, "events").select("event_id", "event_type", "value")
    return ex.filter_isin(ev, "event_type", ["click", "view"], negate=True)


def _day_values_sql():
    return ", ".join(f"({i}, '{d}')" for i, d in enumerate(fixed.DAY_ORDER))


@query("dow_counts_complete", f"""
WITH dim(position, day_of_week) AS (VALUES {_day_values_sql()}),
c AS (SELECT dayname(ts) AS day_of_week, count(*) AS count FROM events
      WHERE dayname(ts) IN ('Monday', 'Wednesday') GROUP BY 1)
SELECT dim.day_of_week, c.count FROM dim LEFT JOIN c ON dim.day_of_week = c.day_of_week
ORDER BY dim.position""")
def dow_counts_complete(spark, sf):
    """The page's multiselect filter (P8, here on weekdays) followed by the
    week completion (J3): days without rows come back with a NULL count."""
    ev = T.table(spark, sf, "events").withColumn("day_of_week", tf.day_name("ts"))
    return ex.dow_counts_complete(ex.filter_isin(ev, "day_of_week", ["Monday", "Wednesday"]), "day_of_week")


# --- W2 / O5 / W1 / W3 --------------------------------------------------------------


@query("mode_per_group", """
WITH c AS (SELECT CAST(hour(ts) AS INTEGER) AS hour, event_type, count(*) AS n FROM events
           WHERE ts IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY hour ORDER BY n DESC, event_type) AS rn FROM c)
SELECT hour, event_type AS mode_event_type, n AS mode_count FROM r WHERE rn = 1""")
def mode_per_group(spark, sf):
    ev = T.table(spark, sf, "events").withColumn("hour", tf.hour_of("ts"))
    return ex.mode_per_group(ev, "hour", "event_type")


@query("top_k_bucket", """
WITH top AS (SELECT p_name FROM part WHERE p_name IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, p_name LIMIT 8)
SELECT p.p_partkey, COALESCE(t.p_name, 'Other') AS p_name_bucket
FROM part p LEFT JOIN top t ON p.p_name = t.p_name""")
def top_k_bucket(spark, sf):
    part = T.table(spark, sf, "part").select("p_partkey", "p_name")
    return sampling.top_k_bucket(part, "p_name", 8, out_col="p_name_bucket").select("p_partkey", "p_name_bucket")


@query("top_k_bucket_drop", """
WITH top AS (SELECT p_name FROM part WHERE p_name IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, p_name LIMIT 8)
SELECT p.p_partkey, t.p_name AS p_name_bucket FROM part p JOIN top t ON p.p_name = t.p_name""")
def top_k_bucket_drop(spark, sf):
    part = T.table(spark, sf, "part").select("p_partkey", "p_name")
    return (sampling.top_k_bucket(part, "p_name", 8, keep_other=False, out_col="p_name_bucket")
            .select("p_partkey", "p_name_bucket"))


@query("cumulative_share", """
WITH c AS (SELECT p_type AS key, count(*) AS n FROM part WHERE p_type IS NOT NULL GROUP BY 1),
r AS (SELECT key, n, row_number() OVER (ORDER BY n DESC, key) AS position,
             CAST(n AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE) AS share FROM c),
s AS (SELECT *, sum(share) OVER (ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM r)
SELECT CAST(position AS INTEGER) AS position, key, round_even(share, 6) AS share, round_even(cum, 6) AS cum_share,
       CAST(min(CASE WHEN cum >= 0.7 THEN position END) OVER () AS INTEGER) AS n70,
       CAST(min(CASE WHEN cum >= 0.8 THEN position END) OVER () AS INTEGER) AS n80
FROM s ORDER BY position""")
def cumulative_share(spark, sf):
    from blotter.operators.reduce import cumulative_share as cs
    counts = ex.frequency(T.table(spark, sf, "part"), "p_type", name="n")
    return cs(counts, "p_type", "n").withColumnRenamed("p_type", "key")


@query("topk_abs_per_group", """
WITH r AS (SELECT l_linenumber, l_orderkey, l_partkey, l_suppkey, l_quantity,
                  round_even(abs(l_extendedprice * (l_discount - 0.05)), 6) AS score,
                  row_number() OVER (PARTITION BY l_linenumber
                                     ORDER BY abs(l_extendedprice * (l_discount - 0.05)) DESC,
                                              l_orderkey, l_partkey, l_suppkey, l_quantity) AS rank
           FROM lineitem)
SELECT l_linenumber, l_orderkey, l_partkey, l_suppkey, l_quantity, score, CAST(rank AS INTEGER) AS rank
FROM r WHERE rank <= 5""")
def topk_abs_per_group(spark, sf):
    from blotter.operators.reduce import top_k_per_group
    li = T.table(spark, sf, "lineitem").select(
        "l_linenumber", "l_orderkey", "l_partkey", "l_suppkey", "l_quantity",
        F.abs(F.col("l_extendedprice") * (F.col("l_discount") - F.lit(0.05))).alias("absval"))
    out = top_k_per_group(li, "l_linenumber", [F.desc("absval"), "l_orderkey", "l_partkey", "l_suppkey",
                                               "l_quantity"], 5)
    return out.select("l_linenumber", "l_orderkey", "l_partkey", "l_suppkey", "l_quantity",
                      F.bround("absval", 6).alias("score"), "rank")


# --- C1-C6 / J1 / J2 / E1 ------------------------------------------------------------


@query("parse_timestamp", """
SELECT event_id, strftime(ts, '%-m/%-d/%Y %-I:%M:%S %p') AS ts_text, date_trunc('second', ts) AS parsed
FROM events""")
def parse_timestamp(spark, sf):
    ev = T.table(spark, sf, "events").select(
        "event_id", F.date_format("ts", fixed.RAW_TIMESTAMP_FORMAT).alias("ts_text"))
    return ev.withColumn("parsed", tf.parse_timestamp("ts_text"))


@query("temporal_features", f"""
SELECT event_id, CAST(hour(ts) AS INTEGER) AS "Hour", dayname(ts) AS "Day_of_Week",
       CAST(month(ts) AS INTEGER) AS "Month", COALESCE(isodow(ts) >= 6, false) AS "Is_Weekend",
       {sq.season_case('month(ts)')} AS "Season"
FROM events""")
def temporal_features(spark, sf):
    ev = T.table(spark, sf, "events").select("event_id", "ts")
    return prepare.add_temporal_features(ev, "ts", parse_text=False).drop("ts")


@query("season_lookup", f"""
SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) AS month, {sq.season_case('month(o_orderdate)')} AS season
FROM orders""")
def season_lookup(spark, sf):
    o = T.table(spark, sf, "orders").select("o_orderkey", tf.month_of("o_orderdate").alias("month"))
    return o.withColumn("season", tf.season_of_month("month"))


@query("severity_lookup", f"""
WITH {sq.INCIDENTS.strip()}
SELECT "ID", "Primary Type", {sq.severity_case('"Primary Type"')} AS "Crime_Severity_Score" FROM incidents""")
def severity_lookup(spark, sf):
    inc = T.incidents(spark, sf).select("ID", "Primary Type")
    return prepare.add_severity(inc)


@query("encode_temporal", f"""
WITH {sq.INCIDENTS.strip()},
t AS (SELECT "ID", dayname("Date") AS dow, {sq.season_case('month("Date")')} AS season,
             COALESCE(isodow("Date") >= 6, false) AS wk FROM incidents)
SELECT "ID", {sq.ordinal_case('dow', fixed.DAY_ORDER)} AS "DayOfWeek_Num",
       {sq.ordinal_case('season', fixed.SEASON_ORDER)} AS "Season_Num",
       CAST(wk AS INTEGER) AS "Is_Weekend_Num"
FROM t""")
def encode_temporal(spark, sf):
    from blotter.operators.features import encode_temporal as enc
    inc = T.incidents(spark, sf).select("ID", "Date")
    t = prepare.add_temporal_features(inc, "Date", parse_text=False)
    return enc(t).select("ID", "DayOfWeek_Num", "Season_Num", "Is_Weekend_Num")


# --- O4 / J4 ------------------------------------------------------------------------


@query("sample_exact", """
SELECT event_id, event_type, value FROM events
ORDER BY md5(CAST(event_id AS VARCHAR) || ':42'), event_id LIMIT 3000""")
def sample_exact(spark, sf):
    ev = T.table(spark, sf, "events").select("event_id", "event_type", "value")
    return sampling.sample_exact(ev, fixed.SILHOUETTE_SAMPLE, "event_id", fixed.RANDOM_STATE)


@query("sample_exact_orders", """
SELECT o_orderkey, o_totalprice FROM orders
ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':42'), o_orderkey LIMIT 3000""")
def sample_exact_orders(spark, sf):
    o = T.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return sampling.sample_exact(o, fixed.SILHOUETTE_SAMPLE, "o_orderkey", fixed.RANDOM_STATE)


@query("align_semi", """
WITH s AS (SELECT event_id FROM events ORDER BY md5(CAST(event_id AS VARCHAR) || ':42'), event_id LIMIT 3000)
SELECT e.event_id, e.ts, e.user_id FROM events e WHERE e.event_id IN (SELECT event_id FROM s)""")
def align_semi(spark, sf):
    ev = T.table(spark, sf, "events")
    keys = sampling.sample_exact(ev.select("event_id"), fixed.SILHOUETTE_SAMPLE, "event_id")
    return sampling.align_semi(ev.select("event_id", "ts", "user_id"), keys, "event_id", keys_bounded=True)


@query("schema_listing")
def schema_listing(spark, sf):
    return ex.schema_listing(T.table(spark, sf, "orders"))
