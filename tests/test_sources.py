import datetime as dt

from pyspark.sql import functions as F

from blotter.session import scratch_dir
from blotter.sources import io, runs


def test_ragged_runs_flatten_and_compare(spark):
    path = scratch_dir(spark, "test-runs")
    a = spark.createDataFrame([("geo", "KMeans_k2", 2, 0.48, None)], "e string, r string, k int, sil double, eps double")
    b = spark.createDataFrame([("geo", "DBSCAN", None, -1.0, 0.02)], "e string, r string, k int, sil double, eps double")
    for df in (a, b):
        runs.log_runs(runs.make_runs(df, F.col("e"), F.col("r"),
                                     {"k": F.col("k"), "eps": F.col("eps")},
                                     {"silhouette": F.col("sil"), "eps_metric": F.col("eps")}), path)
    flat = runs.flatten_runs(runs.read_runs(spark, path))
    rows = {r["run_name"]: r for r in flat.collect()}
    assert rows["KMeans_k2"]["k"] == "2" and rows["KMeans_k2"]["eps"] is None
    assert rows["DBSCAN"]["k"] is None and rows["DBSCAN"]["eps"] == "0.02"
    assert rows["KMeans_k2"]["metric_silhouette"] == 0.48 and rows["KMeans_k2"]["metric_eps_metric"] is None
    assert runs.metric_columns(flat) == ["metric_eps_metric", "metric_silhouette"]
    cmp = runs.metric_compare(flat, "metric_eps_metric").collect()
    assert [(r["run_name"], r["runs_total"]) for r in cmp] == [("DBSCAN", 2)]
    u = runs.union_ragged([flat.select("run_name", "k"), flat.select("run_name", "eps")])
    assert set(u.columns) == {"run_name", "k", "eps"} and u.count() == 4


def test_absent_log_and_optional_table_are_empty(spark):
    assert runs.read_runs(spark, "/nonexistent/blotter-runs").count() == 0
    assert io.load_optional(spark, "/nonexistent/x.parquet", runs.RUN_SCHEMA).count() == 0


def test_csv_round_trip_keeps_nulls_and_types(spark):
    df = spark.createDataFrame([(1, None, 2.5, dt.datetime(2020, 1, 5, 23, 30, 0, 123456)), (2, "b", None, None)],
                               "k long, s string, x double, t timestamp_ntz")
    path = scratch_dir(spark, "test-csv")
    io.write_csv(df, path)
    back = io.read_raw_csv(spark, path, types={"k": "bigint", "x": "double", "t": "timestamp_ntz"}, drop_index=False)
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in df.collect())


def test_row_key_distinguishes_nulls(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("a", "")], "p string, q string")
    keys = [r[0] for r in io.with_row_key(df).select("row_key").collect()]
    assert len(set(keys)) == 3
