"""Operators on more rows than their former bounds, on duplicates, nulls and hubs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from blotter import session
from blotter.operators import cluster as cl
from blotter.operators import features as fe
from blotter.operators import metrics as me
from blotter.operators import reduce as rd
from blotter.operators.components import connected_components
from blotter.operators.dbscan import dbscan
from blotter.operators.ranking import number_sorted
from blotter.operators.ward import ward
from blotter.sources import io


def test_components_of_chains_hubs_and_copies(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(5000, 5001), (5001, 5000), (7, 7), (9000, 9000)]
    edges = [edges[i] for i in rng.permutation(len(edges))] + [(None, 1)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(400)} | {5000: 5000, 5001: 5000}
    assert got == want
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_number_sorted(spark):
    values = [f"v{i:04d}" for i in range(500)]
    df = spark.createDataFrame([(v,) for v in values[::-1] * 2 + [None]], "v string").repartition(7)
    assert {r.v: r.number for r in number_sorted(df, "v").collect()} == {v: i for i, v in enumerate(values)}


def test_ward_labels_every_row(spark):
    df = spark.range(20_001).select("id", F.rand(1).alias("x"), F.rand(2).alias("y")).unionByName(
        spark.createDataFrame([(90_000, None, 1.0)], "id long, x double, y double"))
    got = ward(df, "id", "x", "y", 5, bins=16)
    assert got.count() == 20_002 and got.filter("cluster is null").count() == 1
    assert sorted(r.cluster for r in got.filter("cluster is not null").select("cluster").distinct().collect()) == list(range(5))


def test_knn_over_more_rows_than_a_block(spark):
    rng = np.random.default_rng(4)
    X = np.concatenate([rng.normal(size=(8_001, 3)), np.zeros((200, 3))])  # many rows in one place
    pdf = pd.DataFrame({"id": np.arange(len(X))})
    pdf["v"] = list(X)
    got = rd.knn_graph(spark.createDataFrame(pdf), "id", "v", k=4, pivots=16).toPandas()
    assert len(got) == 4 * len(X)
    mine = {k: g.sort_values("rank") for k, g in got.groupby("src")}
    for i in rng.choice(len(X), 60, replace=False).tolist() + [8_001, 8_100]:
        d = np.sqrt(((X - X[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        assert np.allclose(np.sort(d)[:4], mine[i]["distance"]) and (np.lexsort((np.arange(len(X)), d))[:4] == mine[i]["dst"]).all()


def _sent(monkeypatch, module):
    """Rows that tasks of ``module`` are sent, by call."""
    seen, plain = [], module.stream_groups

    def counted(df, *args):
        seen.append(df.count())
        return plain(df, *args)

    monkeypatch.setattr(module, "stream_groups", counted)
    return seen


def test_rows_sent_for_neighbours_grow_with_the_table(spark, monkeypatch):
    seen = _sent(monkeypatch, rd)
    for n in (4_000, 16_000):
        df = spark.range(n).select("id", F.array(*[F.rand(s) for s in range(12)]).alias("v"))
        assert rd.knn_graph(df, "id", "v", k=3, pivots=8).count() == 3 * n
    assert seen[1] <= 4.5 * seen[0] and seen[1] <= 40 * 16_000, seen


def test_rows_sent_for_silhouettes_grow_with_the_table(spark, monkeypatch):
    seen = _sent(monkeypatch, me)
    for n in (4_000, 16_000):
        df = spark.range(n).select("id", F.array(*[F.rand(s) for s in range(12)]).alias("v"), (F.col("id") % 3).alias("c"))
        assert me.silhouette_rows(df, "id", "v", "c").count() == n
    assert seen[1] <= 4.5 * seen[0] and seen[1] <= 40 * 16_000, seen


@pytest.mark.parametrize("block", [70, 65_536])
def test_neighbours_far_from_the_origin_close_together_and_copied(spark, block):
    rng = np.random.default_rng(8)
    X = np.concatenate([1e6 + rng.normal(size=(700, 6)), 1e6 + 1e-7 * rng.normal(size=(300, 6)), np.full((150, 6), 1e6),
                        1e160 * rng.normal(size=(3, 6)), [[np.nan] * 6, [np.inf] * 6]])
    ids = rng.permutation(len(X)) * 3
    frame = spark.createDataFrame(pd.DataFrame({"id": ids, "v": list(X)}), "id long, v array<double>")
    got = rd.knn_graph(frame, "id", "v", k=6, pivots=5, block=block).toPandas()
    mine = {k: g.sort_values("rank") for k, g in got.groupby("src")}
    with np.errstate(all="ignore"):
        for i in range(len(X)):
            d = np.sqrt(((X - X[i]) ** 2).sum(axis=1))
            d[i] = np.inf
            want = np.lexsort((ids, d))[:6]
            want = want[np.isfinite(d[want])]
            assert len(want) == len(mine.get(ids[i], ())), i
            if len(want):
                assert np.allclose(mine[ids[i]]["distance"], d[want], rtol=1e-9, atol=0) and mine[ids[i]]["rank"].tolist() == list(range(1, len(want) + 1))
                assert len(set(mine[ids[i]]["dst"])) == len(want) and (d[want][-1] > 0 or mine[ids[i]]["dst"].tolist() == ids[want].tolist())


@pytest.mark.parametrize("block", [70, 65_536])
def test_silhouettes_far_from_the_origin_and_copied(spark, block):
    rng = np.random.default_rng(9)
    X = 1e5 + np.concatenate([rng.normal(size=(400, 5)), np.zeros((200, 5)), 1e-4 * rng.normal(size=(200, 5)) + 3, [[9.0] * 5]])
    lab = np.array([4] * 400 + [-7] * 200 + [12] * 200 + [13])
    frame = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(X)), "v": list(X), "c": lab}), "id long, v array<double>, c int")
    got = me.silhouette_rows(frame, "id", "v", "c", block).toPandas().set_index("id").sort_index()
    assert len(got) == len(X)
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(axis=2))
    for i in range(len(X)):
        n = (lab == lab[i]).sum()
        a = D[i, lab == lab[i]].sum() / (n - 1) if n > 1 else 0.0
        b = min(D[i, lab == c].mean() for c in set(lab.tolist()) - {lab[i]})
        assert np.allclose([got.a[i], got.b[i], got.silhouette[i]], [a, b, (b - a) / max(a, b) if n > 1 else 0.0], rtol=1e-7, atol=1e-12), i


def test_pca_refuses_nulls_and_keeps_rows(spark):
    df = spark.range(3_001).select("id", F.rand(1).alias("a"), (F.rand(2) + 1e6).alias("b"), F.lit(3.0).alias("c"))
    fit = rd.PcaFit(df, ["a", "b", "c"])
    assert fit.project(["id"]).count() == 3_001 and fit.ratio[2] == 0.0
    with pytest.raises(ValueError, match="null"):
        rd.PcaFit(df.withColumn("a", F.when(F.col("id") != 5, F.col("a"))), ["a", "b", "c"])


def test_dbscan_follows_a_long_chain_and_keeps_null_rows(spark):
    rows = [(i, i * 0.9, 0.0) for i in range(300)] + [(1000 + i, 50.0, 50.0) for i in range(2_000)] + [(9_000, None, 0.0)]
    got = {r.id: r.cluster for r in dbscan(spark.createDataFrame(rows, "id long, x double, y double"), "id", "x", "y", 1.0, 2, pair_budget=10).collect()}
    assert {got[i] for i in range(300)} == {0} and {got[1000 + i] for i in range(2_000)} == {1} and got[9_000] == -1
    assert len(got) == len(rows)


def test_kmeans_labels_are_a_column(spark):
    vec = spark.range(100).select("id", F.array(F.rand(1), F.rand(2)).alias("v"), F.lit("kept").alias("other"))
    out = cl.kmeans_labels(vec, np.array([[0.2, 0.2], [0.8, 0.8]]))
    assert out.columns == ["id", "v", "other", "cluster"]
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan and "MapIn" not in plan


def test_label_codes_of_many_labels(spark):
    df = spark.range(5_000).select("id", F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("c"))
    got = fe.label_encode(df, ["c"])
    assert got.filter("c_Enc <> id").count() == 0


def test_csv_dialect_of_pandas(spark, tmp_path):
    pdf = pd.DataFrame({"ID": [1, 2, 3], "Description": ['he said "hi", twice', "a,b", None], "Beat": [111.0, None, 7.0],
                        "Arrest": [True, False, True], "Latitude": [41.5, None, 42.0], "Year": [2020, 2021, 2022]})
    pdf.to_csv(tmp_path / "raw.csv")
    got = io.read_raw_csv(spark, str(tmp_path / "raw.csv")).orderBy("ID").collect()
    assert [(r.ID, r.Description, r.Beat, r.Arrest, r.Latitude, r.Year) for r in got] == [
        (1, 'he said "hi", twice', 111, True, 41.5, 2020), (2, "a,b", None, False, None, 2021), (3, None, 7, True, 42.0, 2022)]
    pdf["Description"] = ["two\nlines", 'x "y"\n', "z"]
    pdf.to_csv(tmp_path / "lines.csv")
    got = io.read_raw_csv(spark, str(tmp_path / "lines.csv"), multi_line=True).orderBy("ID").collect()
    assert [r.Description for r in got] == pdf["Description"].tolist()
    out = spark.createDataFrame([(1, 'a "quoted", text', "x"), (2, None, "\\y")], "id long, t string, u string")
    io.write_csv(out, str(tmp_path / "back"))
    assert sorted(map(tuple, io.read_csv_typed(spark, str(tmp_path / "back"), out.schema).collect())) == sorted(map(tuple, out.collect()))
    assert [tuple(r) for r in spark.createDataFrame([("111.0", "1.5", "x", "9" * 30)], "a string, b string, c string, d string").select(
        *[io.cast_text(F.col(c), "int") for c in "abcd"]).collect()] == [(111, None, None, None)]


def test_scratch_needs_a_shared_folder(monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_scratch_is_cleared(spark):
    import os

    with session.scratch(spark):
        path = session.materialize(spark.range(5), "gone").inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path)
