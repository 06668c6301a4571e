"""Catalogue part 2: scans and sinks, quality and cleaning, features, run log."""

from __future__ import annotations

from pyspark.sql import functions as F

from blotter.functions import fixed
from blotter.operators import features as fe
from blotter.operators import prepare, quality
from blotter.plans import sqlparts as sq
from blotter.plans import tables as T
from blotter.plans.registry import query
from blotter.session import materialize, scratch_dir
from blotter.sources import cache, io, publish, runs

# --- S1 / S2 / S5 / S6 / S3 / S7 / J5 ------------------------------------------------

_ORDER_TYPES = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string",
                "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}


@query("scan_csv_roundtrip", "SELECT * FROM orders")
def scan_csv_roundtrip(spark, sf):
    orders = T.table(spark, sf, "orders")
    path = scratch_dir(spark, "csv")
    io.write_csv(orders, path)
    back = io.read_raw_csv(spark, path, types=_ORDER_TYPES, drop_index=False)
    return back.select(*orders.columns)


@query("scan_typed", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders")
def scan_typed(spark, sf):
    return io.read_table(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_orderdate", "o_totalprice"])


@query("scan_optional", """
SELECT event_type, count(*) AS count FROM events GROUP BY 1""")
def scan_optional(spark, sf):
    ev = T.table(spark, sf, "events")
    absent = io.load_optional(spark, f"{sf}/events_archive_absent.parquet", ev.schema)
    return absent.unionByName(ev).groupBy("event_type").agg(F.count("*").alias("count"))


@query("features_meta_join", """
SELECT CAST(event_id AS VARCHAR) AS row_key, event_type, CAST(hour(ts) AS INTEGER) AS "Hour", value
FROM events""")
def features_meta_join(spark, sf):
    ev = io.with_row_key(T.table(spark, sf, "events"), "event_id")
    base = scratch_dir(spark, "stage")
    io.write_table(ev.select("row_key", F.hour("ts").alias("Hour"), "value"), f"{base}/features")
    io.write_table(ev.select("row_key", "event_type", "ts"), f"{base}/metadata")
    X = io.read_table(spark, f"{base}/features")
    meta = io.read_table(spark, f"{base}/metadata")
    return meta.join(X, "row_key", "inner").select("row_key", "event_type", "Hour", "value")


@query("published_pair", """
SELECT CAST(event_id AS VARCHAR) AS row_key, event_type, CAST(hour(ts) AS INTEGER) AS "Hour", value
FROM events""")
def published_pair(spark, sf):
    """Features and metadata as one version; a later writer that died after its first table changes nothing."""
    ev = io.with_row_key(T.table(spark, sf, "events"), "event_id")
    path = scratch_dir(spark, "published")
    publish.publish({"features": ev.select("row_key", F.hour("ts").alias("Hour"), "value"),
                     "metadata": ev.select("row_key", "event_type", "ts")}, path)
    io.write_table(ev.select("row_key", F.lit(-1).alias("Hour"), "value"), f"{path}/v-unfinished/features")
    X, meta = (publish.read_published(spark, path, t) for t in ("features", "metadata"))
    return meta.join(X, "row_key", "inner").select("row_key", "event_type", "Hour", "value")


@query("scan_rejects", """
WITH o AS (SELECT o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 AS cut, o_orderkey % 19 = 0 AS odd, o_orderkey % 23 = 0 AS gap FROM orders)
SELECT 'accepted' AS kind, CAST(NULL AS VARCHAR) AS "column", count(*) FILTER (WHERE NOT cut) AS count FROM o
UNION ALL SELECT 'rejected', NULL, count(*) FILTER (WHERE cut) FROM o
UNION ALL SELECT 'failed', 'o_orderkey', 0
UNION ALL SELECT 'missing', 'o_orderkey', 0
UNION ALL SELECT 'failed', 'o_totalprice', count(*) FILTER (WHERE NOT cut AND odd) FROM o
UNION ALL SELECT 'missing', 'o_totalprice', count(*) FILTER (WHERE NOT cut AND gap AND NOT odd) FROM o""")
def scan_rejects(spark, sf):
    """Raw lines with a field too few or too many, and with prices that are no number, counted by the scan."""
    key, path = F.col("o_orderkey"), scratch_dir(spark, "raw-lines")
    price = F.when(key % 19 == 0, F.lit("twelve")).when(key % 23 == 0, F.lit("NaN")).otherwise(F.col("o_totalprice").cast("string"))
    line = F.concat_ws(",", key.cast("string"), price, F.when(key % 13 != 0, F.lit("a")), F.when((key % 17 == 0), F.lit("b,c")))
    line = F.when((key % 13 == 0) & (key % 17 == 0), F.concat_ws(",", key.cast("string"), price)).otherwise(line)
    lines = T.table(spark, sf, "orders").select(line.alias("o_orderkey,o_totalprice,note"))
    lines.write.option("header", True).option("quote", "").option("sep", "\u0001").csv(path)
    _, _, report = io.scan_with_rejects(spark, path, {"o_orderkey": "bigint", "o_totalprice": "double"}, drop_index=False)
    return report


# --- A1 / A2 / A3 / P2-P6 / A19 (documents LEFT JOIN labels) ---------------------------

_DOCS = sq.DOCS_LABELLED.strip()


@query("null_profile", f"""
WITH {_DOCS},
c AS (SELECT count(*) AS total, count(*) - count(doc_id) AS n_doc_id, count(*) - count(lang) AS n_lang,
             count(*) - count(source) AS n_source, count(*) - count(n_chars) AS n_n_chars,
             count(*) - count(quality) AS n_quality, count(*) - count(toxic) AS n_toxic FROM docs),
u AS (SELECT 'doc_id' AS "column", n_doc_id AS missing_count, total FROM c UNION ALL
      SELECT 'lang', n_lang, total FROM c UNION ALL SELECT 'source', n_source, total FROM c UNION ALL
      SELECT 'n_chars', n_n_chars, total FROM c UNION ALL SELECT 'quality', n_quality, total FROM c UNION ALL
      SELECT 'toxic', n_toxic, total FROM c)
SELECT "column", missing_count,
       round_even(CAST(missing_count AS DOUBLE) * 100.0 / CAST(total AS DOUBLE), 2) AS missing_pct
FROM u WHERE missing_count > 0""")
def null_profile(spark, sf):
    return quality.null_profile(T.documents_labelled(spark, sf), 2)


@query("duplicate_count", """
WITH g AS (SELECT text, lang, count(*) AS n FROM documents GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS distinct_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows,
       2 AS total_columns FROM g""")
def duplicate_count(spark, sf):
    return quality.duplicate_count(T.table(spark, sf, "documents").select("text", "lang"))


@query("duplicate_count_lineitem", """
WITH g AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS distinct_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows,
       2 AS total_columns FROM g""")
def duplicate_count_lineitem(spark, sf):
    return quality.duplicate_count(T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"))


@query("dedup_rows", "SELECT DISTINCT text, lang FROM documents")
def dedup_rows(spark, sf):
    return quality.dedup_rows(T.table(spark, sf, "documents").select("text", "lang"))


@query("dropna_subset", f"""
WITH {_DOCS} SELECT doc_id, lang, quality, toxic FROM docs WHERE quality IS NOT NULL""")
def dropna_subset(spark, sf):
    d = T.documents_labelled(spark, sf).select("doc_id", "lang", "quality", "toxic")
    return quality.dropna_subset(d, ["quality"])


@query("dropna_any", f"""
WITH {_DOCS} SELECT * FROM docs
WHERE doc_id IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL AND n_chars IS NOT NULL
  AND quality IS NOT NULL AND toxic IS NOT NULL""")
def dropna_any(spark, sf):
    return quality.dropna_any(T.documents_labelled(spark, sf))


@query("dropped_rows", f"""
WITH {_DOCS}
SELECT count(*) AS rows_before,
       count(*) FILTER (WHERE quality IS NOT NULL AND toxic IS NOT NULL AND lang IS NOT NULL
                        AND source IS NOT NULL AND n_chars IS NOT NULL AND doc_id IS NOT NULL) AS rows_after,
       count(*) FILTER (WHERE quality IS NULL OR toxic IS NULL OR lang IS NULL OR source IS NULL
                        OR n_chars IS NULL OR doc_id IS NULL) AS rows_dropped
FROM docs""")
def dropped_rows(spark, sf):
    return quality.dropped_rows(T.documents_labelled(spark, sf))


@query("fill_median", f"""
WITH {_DOCS},
m AS (SELECT quantile_cont(CAST(quality AS DOUBLE), 0.5) AS mq, quantile_cont(CAST(toxic AS DOUBLE), 0.5) AS mt,
             quantile_cont(CAST(n_chars AS DOUBLE), 0.5) AS mn FROM docs)
SELECT doc_id, COALESCE(CAST(quality AS DOUBLE), m.mq) AS quality, COALESCE(CAST(toxic AS DOUBLE), m.mt) AS toxic,
       COALESCE(CAST(n_chars AS DOUBLE), m.mn) AS n_chars
FROM docs, m""")
def fill_median(spark, sf):
    d = T.documents_labelled(spark, sf).select("doc_id", "quality", "toxic", "n_chars")
    return quality.fill_median(d, ["quality", "toxic", "n_chars"])


@query("fill_constant", f"""
WITH {_DOCS} SELECT doc_id, COALESCE(quality, -1) AS quality, COALESCE(toxic, -1) AS toxic FROM docs""")
def fill_constant(spark, sf):
    d = T.documents_labelled(spark, sf).select("doc_id", "quality", "toxic")
    return quality.fill_constant(d, {"quality": -1, "toxic": -1})


@query("cleaning_audit", f"""
WITH {_DOCS},
s0 AS (SELECT lang, source, quality, toxic FROM docs),
s1 AS (SELECT * FROM s0 WHERE quality IS NOT NULL),
s2 AS (SELECT DISTINCT * FROM s1)
SELECT 0 AS step_no, 'input' AS step, count(*) AS rows FROM s0
UNION ALL SELECT 1, 'after_dropna', count(*) FROM s1
UNION ALL SELECT 2, 'after_dedup', count(*) FROM s2""")
def cleaning_audit(spark, sf):
    s0 = T.documents_labelled(spark, sf).select("lang", "source", "quality", "toxic")
    return quality.cleaning_audit(s0, [("after_dropna", lambda d: quality.dropna_subset(d, ["quality"])), ("after_dedup", quality.dedup_rows)])


# --- E2-E6 ---------------------------------------------------------------------------


@query("label_encode", """
SELECT event_id,
       CAST(dense_rank() OVER (ORDER BY COALESCE(event_type, 'nan')) - 1 AS INTEGER) AS event_type_Enc,
       CAST(dense_rank() OVER (ORDER BY COALESCE(CAST(user_id AS VARCHAR), 'nan')) - 1 AS INTEGER) AS user_id_Enc
FROM events""")
def label_encode(spark, sf):
    ev = T.table(spark, sf, "events").select("event_id", "event_type", "user_id")
    return fe.label_encode(ev, ["event_type", "user_id"]).select("event_id", "event_type_Enc", "user_id_Enc")


def _bins_sql(table, cols, key_cols):
    stats = ", ".join(f"min(CAST({c} AS DOUBLE)) AS mn_{c}, max(CAST({c} AS DOUBLE)) AS mx_{c}" for c in cols)
    exprs = []
    for c, name in cols.items():
        step = f"((s.mx_{c} - s.mn_{c}) / 20.0)"
        exprs.append(f"COALESCE({sq.bin_sum(f'CAST(t.{c} AS DOUBLE)', f's.mn_{c}', step, 20)}, 0) AS {name}")
    keys = ", ".join(f"t.{k}" for k in key_cols)
    return f"WITH s AS (SELECT {stats} FROM {table}) SELECT {keys}, {', '.join(exprs)} FROM {table} t, s"


@query("equal_width_bins", _bins_sql("lineitem", {"l_extendedprice": "price_bin", "l_discount": "discount_bin"},
                                     ["l_orderkey", "l_linenumber"]))
def equal_width_bins(spark, sf):
    li = T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    return fe.equal_width_bins(li, {"l_extendedprice": "price_bin", "l_discount": "discount_bin"}, 20) \
        .select("l_orderkey", "l_linenumber", "price_bin", "discount_bin")


_PLANE_SQL = """plane AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y
                 FROM embeddings)"""


@query("grid_cells", f"""
WITH {_PLANE_SQL},
s AS (SELECT min(x) AS mn_x, max(x) AS mx_x, min(y) AS mn_y, max(y) AS mx_y FROM plane),
b AS (SELECT COALESCE({sq.bin_sum('p.x', 's.mn_x', '((s.mx_x - s.mn_x) / 20.0)', 20)}, 0) AS xb,
             COALESCE({sq.bin_sum('p.y', 's.mn_y', '((s.mx_y - s.mn_y) / 20.0)', 20)}, 0) AS yb FROM plane p, s),
g AS (SELECT CAST(xb * 20 + yb AS INTEGER) AS grid_id, count(*) AS count FROM b GROUP BY 1)
SELECT grid_id, count, count(*) OVER () AS occupied_cells FROM g""")
def grid_cells(spark, sf):
    plane = T.embedding_plane(spark, sf)
    b = fe.equal_width_bins(plane, {"x": "xb", "y": "yb"}, 20).withColumn("grid_id", fe.grid_id("xb", "yb", 20))
    counts = b.groupBy("grid_id").agg(F.count("*").alias("count"))
    from pyspark.sql import Window
    # the window runs over the occupied cells only (at most bins x bins rows)
    return counts.withColumn("occupied_cells", F.count("*").over(Window.partitionBy()))


@query("minmax_scale", f"""
WITH {_PLANE_SQL},
s AS (SELECT min(x) AS mn_x, max(x) AS mx_x, min(y) AS mn_y, max(y) AS mx_y FROM plane)
SELECT vec_id, (x - mn_x) / (mx_x - mn_x) AS x_scaled, (y - mn_y) / (mx_y - mn_y) AS y_scaled FROM plane, s""")
def minmax_scale(spark, sf):
    plane = T.embedding_plane(spark, sf)
    return fe.minmax_scale(plane, {"x": "x_scaled", "y": "y_scaled"}).select("vec_id", "x_scaled", "y_scaled")


@query("standard_scale", """
WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq_, avg(l_extendedprice) AS mp,
                  stddev_pop(l_extendedprice) AS sp FROM lineitem)
SELECT l_orderkey, l_linenumber, round_even((l_quantity - mq) / sq_, 6) AS quantity_std,
       round_even((l_extendedprice - mp) / sp, 6) AS price_std FROM lineitem, s""")
def standard_scale(spark, sf):
    li = T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    out = fe.standard_scale(li, {"l_quantity": "quantity_std", "l_extendedprice": "price_std"})
    return out.select("l_orderkey", "l_linenumber", F.bround("quantity_std", 6).alias("quantity_std"),
                      F.bround("price_std", 6).alias("price_std"))


# --- E7: whole stage 1 + stage 3 on the incident-shaped events table --------------------


def cleaned_incidents(spark, sf):
    inc = T.incidents(spark, sf)
    cleaned = quality.clean_incidents(inc)
    cleaned = prepare.add_severity(prepare.add_temporal_features(cleaned, "Date", parse_text=False))
    # stage boundary: the cleaned table is written once (as the stage-1 output),
    # so the fitting passes of stage 3 do not repeat the dedup shuffle
    return materialize(cleaned, "cleaned")


def engineered_incidents(spark, sf):
    eng = fe.engineer(cleaned_incidents(spark, sf))
    return io.with_row_key(eng, "ID")


def feature_matrix_sql():
    enc = "CAST(dense_rank() OVER (ORDER BY COALESCE({c}, 'nan')) - 1 AS INTEGER)"
    lat_step, lon_step = "((s.la1 - s.la0) / 20.0)", "((s.lo1 - s.lo0) / 20.0)"
    lat_bin = f"COALESCE({sq.bin_sum('c.\"Latitude\"', 's.la0', lat_step, 20)}, 0)"
    lon_bin = f"COALESCE({sq.bin_sum('c.\"Longitude\"', 's.lo0', lon_step, 20)}, 0)"
    return f"""
WITH {sq.INCIDENTS.strip()},
base AS (SELECT * FROM incidents WHERE "Latitude" IS NOT NULL AND "Longitude" IS NOT NULL),
med AS (SELECT quantile_cont("District", 0.5) AS md, quantile_cont("Ward", 0.5) AS mw,
               quantile_cont("Community Area", 0.5) AS mc FROM base),
cleaned AS (SELECT DISTINCT b."ID", b."Date", b."Primary Type", b."Description",
                   COALESCE(b."Location Description", 'UNKNOWN') AS "Location Description", b."Arrest", b."Domestic",
                   b."Beat", COALESCE(b."District", med.md) AS "District", COALESCE(b."Ward", med.mw) AS "Ward",
                   COALESCE(b."Community Area", med.mc) AS "Community Area", b."Year", b."Latitude", b."Longitude"
            FROM base b, med),
s AS (SELECT min("Latitude") AS la0, max("Latitude") AS la1, min("Longitude") AS lo0, max("Longitude") AS lo1
      FROM cleaned),
f AS (
  SELECT CAST(c."ID" AS VARCHAR) AS row_key,
         CAST(hour(c."Date") AS INTEGER) AS "Hour",
         {sq.ordinal_case('dayname(c."Date")', fixed.DAY_ORDER)} AS "DayOfWeek_Num",
         CAST(month(c."Date") AS INTEGER) AS "Month",
         {sq.ordinal_case(sq.season_case('month(c."Date")'), fixed.SEASON_ORDER)} AS "Season_Num",
         CAST(COALESCE(isodow(c."Date") >= 6, false) AS INTEGER) AS "Is_Weekend_Num",
         {enc.format(c='c."Primary Type"')} AS "Primary Type_Enc",
         {enc.format(c='c."Location Description"')} AS "Location Description_Enc",
         {sq.severity_case('c."Primary Type"')} AS "Crime_Severity_Score",
         CAST(c."Arrest" AS INTEGER) AS "Arrest", CAST(c."Domestic" AS INTEGER) AS "Domestic",
         (c."Latitude" - s.la0) / (s.la1 - s.la0) AS "Lat_Scaled",
         (c."Longitude" - s.lo0) / (s.lo1 - s.lo0) AS "Lon_Scaled",
         {lat_bin} AS "Lat_Bin", {lon_bin} AS "Lon_Bin",
         CAST({lat_bin} * 20 + {lon_bin} AS INTEGER) AS "Grid_ID",
         c."District", c."Beat", c."Community Area", c."Ward"
  FROM cleaned c, s)
SELECT * FROM f WHERE "Hour" IS NOT NULL AND "Month" IS NOT NULL AND "Beat" IS NOT NULL
  AND "District" IS NOT NULL AND "Ward" IS NOT NULL AND "Community Area" IS NOT NULL
  AND "Lat_Scaled" IS NOT NULL AND "Lon_Scaled" IS NOT NULL"""


@query("feature_matrix", feature_matrix_sql())
def feature_matrix(spark, sf):
    X, _ = fe.feature_matrix(engineered_incidents(spark, sf))
    return X


@query("feature_pipeline_saved", feature_matrix_sql())
def feature_pipeline_saved(spark, sf):
    """The feature matrix by a pipeline that was fitted, saved and loaded again."""
    from blotter.operators import feature_pipeline as fp
    path, cleaned = scratch_dir(spark, "pipeline"), cleaned_incidents(spark, sf)
    io.save_model(fp.fit_features(cleaned), path)
    X, _ = fe.feature_matrix(io.with_row_key(fp.load_features(spark, path).transform(cleaned), "ID"))
    return X


@query("feature_metadata", f"""
WITH {sq.INCIDENTS.strip()}
SELECT CAST("ID" AS VARCHAR) AS row_key, "ID", "Primary Type", "Latitude", "Longitude", "Year",
       {sq.season_case('month("Date")')} AS "Season", dayname("Date") AS "Day_of_Week",
       {sq.severity_case('"Primary Type"')} AS "Crime_Severity_Score"
FROM incidents WHERE "Latitude" IS NOT NULL AND "Longitude" IS NOT NULL AND "Beat" IS NOT NULL
  AND "Date" IS NOT NULL""")
def feature_metadata(spark, sf):
    _, meta = fe.feature_matrix(engineered_incidents(spark, sf))
    return meta.select("row_key", "ID", "Primary Type", "Latitude", "Longitude", "Year", "Season", "Day_of_Week",
                       "Crime_Severity_Score")


# --- S11 / S12 / M1 / U1 / U4 / P11: a run log derived from the events table ---------------


def _event_runs(spark, sf):
    ev = T.table(spark, sf, "events")
    agg = ev.groupBy("event_type").agg(
        F.count_distinct("user_id").alias("users"), F.avg("value").alias("mean_value"),
        F.max("value").alias("max_value"), F.avg((F.col("value") > 100).cast("double")).alias("big_share"))
    experiment = F.when(F.col("event_type").isin("click", "view"), "browse").otherwise("convert")
    convert = experiment == "convert"
    return runs.make_runs(
        agg, experiment, F.col("event_type"),
        params={"event_type": F.col("event_type"), "users": F.col("users"),
                "big_share_gate": F.when(convert, F.lit("100"))},
        metrics={"mean_value": F.col("mean_value"), "max_value": F.col("max_value"),
                 "big_share": F.when(convert, F.col("big_share"))})


def _logged_runs(spark, sf):
    path = scratch_dir(spark, "runs")
    recs = _event_runs(spark, sf)
    for exp in ("browse", "convert"):  # one append per experiment
        runs.log_runs(recs.where(F.col("experiment") == exp), path)
    return runs.read_runs(spark, path)


_RUNS_SQL = """
r AS (SELECT event_type, count(DISTINCT user_id) AS users, avg(value) AS mean_value, max(value) AS max_value,
             avg(CAST(value > 100 AS DOUBLE)) AS big_share,
             CASE WHEN event_type IN ('click', 'view') THEN 'browse' ELSE 'convert' END AS experiment
      FROM events GROUP BY event_type)"""


@query("run_log_flatten", f"""
WITH {_RUNS_SQL.strip()}
SELECT experiment, event_type AS run_name, 'FINISHED' AS status,
       CASE WHEN experiment = 'convert' THEN '100' END AS big_share_gate, event_type,
       CAST(users AS VARCHAR) AS users,
       round_even(CASE WHEN experiment = 'convert' THEN big_share END, 4) AS metric_big_share,
       round_even(max_value, 4) AS metric_max_value, round_even(mean_value, 4) AS metric_mean_value
FROM r""")
def run_log_flatten(spark, sf):
    return runs.flatten_runs(_logged_runs(spark, sf))


@query("run_log_repeated", f"""
WITH {_RUNS_SQL.strip()}
SELECT experiment, event_type AS run_name, 'plots/' || experiment AS artifact, CAST(1 AS BIGINT) AS times, CAST(users AS VARCHAR) AS users
FROM r""")
def run_log_repeated(spark, sf):
    """Runs with artifacts, appended twice, compacted and appended again, are one run each."""
    path, recs = scratch_dir(spark, "runs"), materialize(_event_runs(spark, sf), "run-records")
    for again in range(3):
        for exp in ("browse", "convert"):
            runs.log_runs(recs.where(F.col("experiment") == exp).withColumn("artifacts", F.array(F.lit(f"plots/{exp}"))), path)
        if again:
            runs.compact_runs(spark, path)
    logged = runs.read_runs(spark, path)
    named = logged.select("experiment", "run_name", F.explode("artifacts").alias("artifact"), F.col("params")["users"].alias("users"))
    return named.groupBy("experiment", "run_name", "artifact", "users").agg(F.count("*").alias("times"))


@query("union_ragged", f"""
WITH {_RUNS_SQL.strip()}
SELECT experiment, event_type AS run_name, 'FINISHED' AS status,
       CASE WHEN experiment = 'convert' THEN '100' END AS big_share_gate, event_type,
       CAST(users AS VARCHAR) AS users,
       round_even(CASE WHEN experiment = 'convert' THEN big_share END, 4) AS metric_big_share,
       round_even(max_value, 4) AS metric_max_value, round_even(mean_value, 4) AS metric_mean_value
FROM r""")
def union_ragged(spark, sf):
    logged = _logged_runs(spark, sf)
    per_exp = [runs.flatten_runs(logged.where(F.col("experiment") == e)) for e in ("browse", "convert")]
    out = runs.union_ragged(per_exp)
    return out.select("experiment", "run_name", "status", "big_share_gate", "event_type", "users",
                      "metric_big_share", "metric_max_value", "metric_mean_value")


@query("run_metric_compare", f"""
WITH {_RUNS_SQL.strip()}
SELECT event_type AS run_name, experiment, round_even(big_share, 4) AS metric_big_share,
       (SELECT count(*) FROM r) AS runs_total
FROM r WHERE experiment = 'convert'""")
def run_metric_compare(spark, sf):
    flat = runs.flatten_runs(_logged_runs(spark, sf))
    return runs.metric_compare(flat, "metric_big_share")


@query("scan_raw_csv_index", "SELECT * FROM orders")
def scan_raw_csv_index(spark, sf):
    """Raw-CSV scan (S1): a pandas-style file whose first, unnamed column is a
    row index; the scan drops it and casts the text fields with try_cast."""
    orders = T.table(spark, sf, "orders")
    path = scratch_dir(spark, "rawcsv")
    io.write_csv(orders.select(F.col("o_orderkey").alias(""), *orders.columns), path)
    back = io.read_raw_csv(spark, path, types=_ORDER_TYPES, drop_index=True)
    return back.select(*orders.columns)


@query("season_weekend_checks", f"""
SELECT list_sort(list_distinct(list({sq.season_case('month(ts)')}))) AS seasons,
       count(*) FILTER (WHERE isodow(ts) >= 6) AS weekend_rows,
       CAST(min(hour(ts)) AS INTEGER) AS min_hour, CAST(max(hour(ts)) AS INTEGER) AS max_hour,
       CAST(min(month(ts)) AS INTEGER) AS min_month, CAST(max(month(ts)) AS INTEGER) AS max_month,
       min(CAST(ts AS DATE)) AS first_date, max(CAST(ts AS DATE)) AS last_date
FROM events""")
def season_weekend_checks(spark, sf):
    """Stage-1 sanity values in one pass (A12): seasons present, weekend
    rows, hour / month ranges and the date range."""
    ev = T.table(spark, sf, "events")
    t = prepare.add_temporal_features(ev.select("ts"), "ts", parse_text=False)
    return t.agg(F.array_sort(F.collect_set("Season")).alias("seasons"),
                 F.count_if("Is_Weekend").alias("weekend_rows"),
                 F.min("Hour").alias("min_hour"), F.max("Hour").alias("max_hour"),
                 F.min("Month").alias("min_month"), F.max("Month").alias("max_month"),
                 F.min(F.to_date("ts")).alias("first_date"), F.max(F.to_date("ts")).alias("last_date"))


# --- S1 + stage 1: raw text to the cleaned table -----------------------------------------

#: Incident types given to order priorities: listed severities, and one that is not.
_TYPE_OF = {"1-URGENT": "HOMICIDE", "2-HIGH": "ROBBERY", "3-MEDIUM": "THEFT", "4-NOT SPECIFIED": 'OTHER, "MIXED"'}
_TYPE_ELSE = "NARCOTICS"


def write_incident_csv(spark, sf, path):
    """``orders`` as a raw incident file: an unnamed index, text dates of all seasons, quotes and commas within
    fields, integers with gaps (``111.0``), missing coordinates and districts, and repeated rows."""
    o, key = T.table(spark, sf, "orders"), F.col("o_orderkey")
    kind = F.lit(_TYPE_ELSE)
    for priority, name in _TYPE_OF.items():
        kind = F.when(F.col("o_orderpriority") == priority, F.lit(name)).otherwise(kind)
    when = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(hours=(key % 24).cast("int"))
    raw = o.select(
        key.alias("ID"), F.date_format(when, "MM/dd/yyyy hh:mm:ss a").alias("Date"), kind.alias("Primary Type"),
        F.concat(F.lit('status "'), F.col("o_orderstatus"), F.lit('", order')).alias("Description"),
        F.when(key % 5 != 0, F.concat(F.lit("ZONE, "), (key % 4).cast("string"))).alias("Location Description"),
        (key % 3 == 0).alias("Arrest"), (key % 4 == 0).alias("Domestic"),
        F.when(key % 17 != 0, F.concat((key % 300).cast("string"), F.lit(".0"))).alias("Beat"),
        F.when(key % 7 != 0, (key % 25).cast("double")).alias("District"), F.when(key % 6 != 0, (key % 50).cast("double")).alias("Ward"),
        F.when(key % 9 != 0, (key % 77).cast("double")).alias("Community Area"), F.year("o_orderdate").alias("Year"),
        F.when(key % 11 != 0, F.col("o_totalprice")).alias("Latitude"), (key % 1000).cast("double").alias("Longitude"))
    raw = raw.unionByName(raw.filter("ID % 13 = 0"))
    io.write_csv(raw.select(F.col("ID").alias(""), *raw.columns), path)


_CASES = " ".join(f"WHEN o_orderpriority = '{k}' THEN '{v}'" for k, v in _TYPE_OF.items())


@query("stage1_from_csv", f"""
WITH r AS (
  SELECT o_orderkey AS "ID", CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS "Date",
         CASE {_CASES} ELSE '{_TYPE_ELSE}' END AS "Primary Type", 'status "' || o_orderstatus || '", order' AS "Description",
         COALESCE(CASE WHEN o_orderkey % 5 <> 0 THEN 'ZONE, ' || CAST(o_orderkey % 4 AS VARCHAR) END, 'UNKNOWN') AS "Location Description",
         o_orderkey % 3 = 0 AS "Arrest", o_orderkey % 4 = 0 AS "Domestic",
         CAST(CASE WHEN o_orderkey % 17 <> 0 THEN o_orderkey % 300 END AS INTEGER) AS "Beat",
         CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 25 AS DOUBLE) END AS d,
         CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderkey % 50 AS DOUBLE) END AS w,
         CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderkey % 77 AS DOUBLE) END AS c,
         CAST(year(o_orderdate) AS INTEGER) AS "Year", CAST(o_totalprice AS DOUBLE) AS "Latitude", CAST(o_orderkey % 1000 AS DOUBLE) AS "Longitude"
  FROM orders WHERE o_orderkey % 11 <> 0),
copies AS (SELECT * FROM r UNION ALL SELECT * FROM r WHERE "ID" % 13 = 0),
m AS (SELECT quantile_cont(d, 0.5) AS d, quantile_cont(w, 0.5) AS w, quantile_cont(c, 0.5) AS c FROM copies)
SELECT r."ID", "Date", "Primary Type", "Description", "Location Description", "Arrest", "Domestic", "Beat", COALESCE(r.d, m.d) AS "District",
       COALESCE(r.w, m.w) AS "Ward", COALESCE(r.c, m.c) AS "Community Area", "Year", "Latitude", "Longitude",
       CAST(hour("Date") AS INTEGER) AS "Hour", dayname("Date") AS "Day_of_Week", CAST(month("Date") AS INTEGER) AS "Month",
       isodow("Date") >= 6 AS "Is_Weekend", {sq.season_case('month("Date")')} AS "Season", {sq.severity_case('"Primary Type"')} AS "Crime_Severity_Score"
FROM r, m""")
def stage1_from_csv(spark, sf):
    """Raw CSV text through the whole of stage 1."""
    path = scratch_dir(spark, "incidents-csv")
    write_incident_csv(spark, sf, path)
    return prepare.preprocess(io.read_raw_csv(spark, path))


@query("cached_scan", "SELECT o_orderstatus, count(*) AS orders, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def cached_scan(spark, sf):
    """Two questions over one cached scan."""
    o = cache.cached_table(spark, f"{sf}/orders.parquet", ["o_orderstatus", "o_custkey"])
    n = o.groupBy("o_orderstatus").agg(F.count("*").alias("orders"))
    return n.join(o.groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("customers")), "o_orderstatus")


_MONTH_CASE = "CASE " + " ".join(f"WHEN month(o_orderdate) = {i + 1} THEN '{n}'" for i, n in enumerate(fixed.MONTH_NAMES)) + " END"


@query("monthly_names", f"SELECT CAST(month(o_orderdate) AS INTEGER) AS month, {_MONTH_CASE} AS month_name, count(*) AS count FROM orders GROUP BY 1, 2")
def monthly_names(spark, sf):
    """Counts per month with its short name."""
    o = T.table(spark, sf, "orders").groupBy(F.month("o_orderdate").alias("month")).agg(F.count("*").alias("count"))
    names = F.create_map(*[x for i, n in enumerate(fixed.MONTH_NAMES) for x in (F.lit(i + 1), F.lit(n))])
    return o.select("month", names[F.col("month")].alias("month_name"), "count")
