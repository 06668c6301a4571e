"""Published versions, the run log's commits, the scan cache, rejected lines, the saved pipeline, prefix sums."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from blotter.functions import fixed
from blotter.operators import feature_pipeline as fp
from blotter.operators import features as fe
from blotter.operators import reduce as rd
from blotter.sources import files, io, publish, runs
from blotter.sources.cache import ScanCache


def _record(spark, name, started=None, **more):
    one = spark.range(1)
    return runs.make_runs(one, F.lit("e"), F.lit(name), {"k": F.lit(2)}, {"s": F.lit(0.5)}, started=started, **more)


def test_a_repeated_append_is_one_run(spark, tmp_path):
    path, t = f"{tmp_path}/log", dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    for _ in range(2):
        runs.log_runs(_record(spark, "a", t, artifacts=["p/1.png"], model="m/1"), path)
    runs.log_runs(_record(spark, "a", t + dt.timedelta(1)), path)
    got = runs.read_runs(spark, path).orderBy("started").collect()
    assert [(r.artifacts, r.model) for r in got] == [(["p/1.png"], "m/1"), ([], None)]
    # the same run within another batch
    runs.log_runs(_record(spark, "a", t, artifacts=["p/1.png"], model="m/1").unionByName(_record(spark, "b", t)), path)
    assert runs.read_runs(spark, path).count() == 3
    runs.log_runs(_record(spark, "a").limit(0), path)
    runs.compact_runs(spark, path)
    assert len(files.names(spark, path)) == 1 and runs.read_runs(spark, path).count() == 3
    runs.log_runs(_record(spark, "b", t), path)
    assert runs.read_runs(spark, path).count() == 3


def test_an_uncommitted_batch_is_not_read_and_a_retry_completes_it(spark, tmp_path):
    path, rec = f"{tmp_path}/log", _record(spark, "a")
    runs.log_runs(rec, path)
    runs.log_runs(_record(spark, "b"), path)
    name = runs._batch_name(rec)
    files.delete(spark, f"{path}/{name}/_SUCCESS")
    assert [r.run_name for r in runs.read_runs(spark, path).collect()] == ["b"]
    runs.log_runs(rec, path)
    assert sorted(r.run_name for r in runs.read_runs(spark, path).collect()) == ["a", "b"]


def test_readers_see_whole_versions(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/pair"
    pair = lambda n: {"x": spark.range(n), "y": spark.range(n)}
    with pytest.raises(FileNotFoundError):
        publish.read_published(spark, path, "x")
    assert publish.publish(pair(3), path) == 1
    write, calls = publish.write_table, []

    def dies(df, where, **kw):
        calls.append(where)
        if len(calls) == 2:
            raise OSError("lost")
        write(df, where, **kw)

    monkeypatch.setattr(publish, "write_table", dies)
    with pytest.raises(OSError):
        publish.publish(pair(9), path)
    monkeypatch.undo()
    assert [publish.read_published(spark, path, t).count() for t in "xy"] == [3, 3]
    files.create_new(spark, f"{path}/_manifests/{2:012d}.json", "")  # a writer that died in the manifest
    assert publish.publish(pair(5), path) == 3
    assert [publish.read_published(spark, path, t).count() for t in "xy"] == [5, 5]
    assert publish.read_published(spark, path, "x", 1).count() == 3
    publish.vacuum(spark, path, keep=1)
    assert [n for n, _ in publish.versions(spark, path)] == [3]
    assert len([n for n in files.names(spark, path) if n.startswith("v-")]) == 1
    assert publish.read_published(spark, path, "y").count() == 5


def test_scans_are_reused_invalidated_and_released(spark, tmp_path):
    cache, paths = ScanCache(2), [f"{tmp_path}/t{i}" for i in range(3)]
    for i, p in enumerate(paths):
        spark.range(i + 1).selectExpr("id", "id * 2 b").write.parquet(p)
    a = cache.get(spark, paths[0])
    assert cache.get(spark, paths[0]) is a and a.storageLevel.useMemory
    assert cache.get(spark, paths[0], ["b"]).columns == ["b"] and len(cache) == 2
    spark.range(7).selectExpr("id", "id * 2 b").write.mode("overwrite").parquet(paths[0])
    fresh = cache.get(spark, paths[0])
    assert fresh is not a and fresh.count() == 7
    cache.get(spark, paths[1])  # the projection is the least recently used
    cache.get(spark, paths[2])  # now the whole table
    assert len(cache) == 2 and not fresh.storageLevel.useMemory and fresh.count() == 7
    cache.clear()
    assert len(cache) == 0


def test_rejected_lines_and_failed_casts(spark, tmp_path):
    (tmp_path / "r.csv").write_text(',ID,Name,X\n0,1,"a, ""b""",2.5\n1,x,c,\n2,3,d\n3,4,e,1,9\n4,5.0,f,oops\n5,,,NaN\n')
    rows, rejects, report = io.scan_with_rejects(spark, str(tmp_path / "r.csv"), {"ID": "bigint", "X": "double"})
    assert rows.columns == ["ID", "Name", "X", "_failed"]
    got = [(r.ID, r.Name, r.X, r._failed) for r in rows.collect()]
    assert got == [(1, 'a, "b"', 2.5, []), (None, "c", None, ["ID"]), (5, "f", None, ["X"]), (None, None, None, [])]
    assert [r.line for r in rejects.collect()] == ["2,3,d", "3,4,e,1,9"]
    assert {(r.kind, r.column): r["count"] for r in report.collect()} == {
        ("accepted", None): 4, ("rejected", None): 2, ("failed", "ID"): 1, ("missing", "ID"): 1, ("failed", "X"): 1, ("missing", "X"): 2}


def test_saved_features_equal_the_fitted_ones(spark, tmp_path):
    rows = [(i, f"type {i % 4}" if i % 9 else None, f"place {i % 7}", 41.6 + i % 13 / 20, -87.9 + i % 17 / 30, fixed.DAY_ORDER[i % 7],
             fixed.SEASON_ORDER[i % 4], i % 7 > 4) for i in range(200)]
    schema = ("ID long, `Primary Type` string, `Location Description` string, Latitude double, Longitude double, Day_of_Week string, "
              "Season string, Is_Weekend boolean")
    df = spark.createDataFrame(rows, schema)
    centres = [[0.1, 0.2], [0.8, 0.9], [0.5, 0.1]]
    io.save_model(fp.fit_features(df, centres=centres), f"{tmp_path}/m")
    back = fp.load_features(spark, f"{tmp_path}/m")
    want = {r.ID: r.asDict() for r in fe.engineer(df).collect()}
    got = {r.ID: r.asDict() for r in back.transform(df).collect()}
    for i, r in got.items():
        label = r.pop("Geo_Cluster")
        assert r == want[i]
        assert label == int(np.argmin([(r["Lat_Scaled"] - a) ** 2 + (r["Lon_Scaled"] - b) ** 2 for a, b in centres]))
    new = back.transform(spark.createDataFrame([(1, "unheard of", None, 50.0, None, "Monday", "Winter", None)], schema)).first()
    assert new["Primary Type_Enc"] == fp.UNSEEN and new["Location Description_Enc"] == fp.UNSEEN
    assert new["Lat_Bin"] == 0 and new["Lat_Scaled"] > 1 and new["Lon_Scaled"] is None


def test_cumulative_share_runs_in_ranges(spark):
    n = 100_000
    df = spark.range(n).selectExpr("id k", "cast(id % 1000 + 1 as long) n")
    out = rd.cumulative_share(df, "k", "n")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    k = np.arange(n)
    value = k % 1000 + 1
    order = np.lexsort((k, -value))
    cum = np.cumsum(value[order] / value.sum())
    got = out.toPandas()
    assert (got["k"].to_numpy() == order).all() and (got["position"].to_numpy() == np.arange(1, n + 1)).all()
    assert np.allclose(got["cum_share"], cum, atol=1e-6)
    assert set(got["n70"]) == {int(np.argmax(cum >= 0.7)) + 1} and set(got["n80"]) == {int(np.argmax(cum >= 0.8)) + 1}
    assert rd.cumulative_share(df.limit(0), "k", "n").collect() == []
    assert [r.share for r in rd.cumulative_share(df.selectExpr("k", "0 n").limit(2), "k", "n").collect()] == [None, None]
