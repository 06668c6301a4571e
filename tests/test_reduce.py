import numpy as np
import pandas as pd
import pytest

from blotter.operators import neighbours
from blotter.operators import reduce as rd


def test_pca_matches_svd(spark):
    rng = np.random.default_rng(0)
    A = rng.normal(size=(500, 4))
    A[:, 1] = A[:, 0] * 2 + rng.normal(scale=0.01, size=500)  # near copy
    A[:, 3] += 5  # non-zero mean
    pdf = pd.DataFrame(A, columns=["a", "b", "c", "d"]).assign(k=np.arange(500))
    fit = rd.PcaFit(spark.createDataFrame(pdf), ["a", "b", "c", "d"])
    Z = (A - A.mean(0)) / A.std(0)
    _, s, vt = np.linalg.svd(Z, full_matrices=False)
    ratio = s ** 2 / (s ** 2).sum()
    assert np.allclose(fit.ratio, ratio, atol=1e-10)
    for j in range(4):
        v = vt[j] * np.sign(vt[j][np.argmax(np.abs(vt[j]))])
        assert np.allclose(fit.components[:, j], v, atol=1e-8)
    proj = fit.project(["k"], n_components=2).orderBy("k").toPandas()
    want = Z @ fit.components[:, :2]
    assert np.allclose(proj[["PC1", "PC2"]].to_numpy(), want, atol=1e-8)


def test_knn_graph_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(120, 5))
    pdf = pd.DataFrame({"id": np.arange(120)})
    pdf["v"] = list(X)
    got = rd.knn_graph(spark.createDataFrame(pdf), "id", "v", k=7).toPandas()
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    np.fill_diagonal(D, np.inf)
    for i in range(120):
        want = np.lexsort((np.arange(120), D[i]))[:7]
        mine = got[got.src == i].sort_values("rank")["dst"].to_numpy()
        assert (mine == want).all()


def test_cumulative_share(spark):
    df = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "k string, n long")
    rows = rd.cumulative_share(df, "k", "n").collect()
    assert [r["cum_share"] for r in rows] == [0.5, 0.8, 1.0]
    assert rows[0]["n70"] == 2 and rows[0]["n80"] == 2


@pytest.mark.parametrize("dim, make", [(10, "one"), (64, "many")])
def test_descent_finds_most_neighbours_with_few_pairs(spark, dim, make):
    rng = np.random.default_rng(0)
    n = 20_000
    centres = rng.normal(size=(50, dim)) * 2
    X = rng.normal(size=(n, dim)) + (centres[rng.integers(50, size=n)] if make == "many" else 0)
    frame = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "v": list(X)}), "id long, v array<double>").repartition(8)
    stats = {}
    got = neighbours.knn_graph_descent(frame, "id", "v", 30, stats=stats).toPandas()
    assert stats["rows"] == n and stats["compared"] < 0.07 * n * (n - 1) / 2, stats
    asked = rng.choice(n, 400, replace=False)
    d = np.sqrt(((X[asked, None, :] - X[None, :, :]) ** 2).sum(-1)) if dim < 20 else np.stack([np.sqrt(((X[i] - X) ** 2).sum(1)) for i in asked])
    d[np.arange(400), asked] = np.inf
    worst = np.partition(d, 29, axis=1)[:, 29]
    rows = got[got.src.isin(asked)]
    place = {i: j for j, i in enumerate(asked.tolist())}
    hits = sum(dist <= worst[place[s]] * (1 + 1e-9) for s, dist in zip(rows.src, rows.distance, strict=True))
    assert hits / (400 * 30) >= 0.95, hits / 12_000
    for s, t, dist in rows[["src", "dst", "distance"]].head(200).itertuples(index=False):
        assert s != t and abs(dist - np.sqrt(((X[s] - X[t]) ** 2).sum())) < 1e-9
    assert (got.groupby("src").size() == 30).all() and (got.groupby("src")["dst"].nunique() == 30).all()


def test_descent_on_odd_tables(spark, monkeypatch):
    schema = "id long, v array<double>"
    assert neighbours.knn_graph_descent(spark.createDataFrame([], schema), "id", "v", 3).collect() == []
    assert neighbours.knn_graph_descent(spark.createDataFrame([(1, [0.0]), (2, None)], schema), "id", "v", 3).collect() == []
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(300)] + [(1000 + i, [float(i), 0.0]) for i in range(40)], schema)
    got = neighbours.knn_graph_descent(same, "id", "v", 5, leaf=16, fit_sample=64)
    exact = rd.knn_graph(same, "id", "v", 5)
    assert got.count() == exact.count() and neighbours.recall(got, exact) > 0.9 and neighbours.recall(exact, exact) == 1.0
