import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from blotter.operators import cluster as cl
from blotter.operators import kmeans_batch
from blotter.operators import metrics as me
from blotter.operators import ward as ward_module
from blotter.operators.dbscan import dbscan
from blotter.operators.ward import ward, ward_tree


def blobs(seed, n=240):
    rng = np.random.default_rng(seed)
    centres = rng.uniform(0.15, 0.85, size=(4, 2))
    pts = [c + rng.normal(scale=0.03, size=(n // 5, 2)) for c in centres]
    pts.append(rng.uniform(0, 1, size=(n - 4 * (n // 5), 2)))
    X = np.vstack(pts)
    return X[rng.permutation(len(X))]


def brute_dbscan(X, eps, ms):
    dx = X[:, None, 0] - X[None, :, 0]
    dy = X[:, None, 1] - X[None, :, 1]
    nb = dx * dx + dy * dy <= eps * eps
    core = nb.sum(axis=1) >= ms
    labels = np.full(len(X), -1)
    c = 0
    for i in range(len(X)):
        if labels[i] != -1 or not core[i]:
            continue
        labels[i] = c
        stack = [i]
        while stack:
            p = stack.pop()
            for q in np.nonzero(nb[p])[0]:
                if labels[q] == -1:
                    labels[q] = c
                    if core[q]:
                        stack.append(q)
        c += 1
    return labels


def frame(spark, X, labels=None):
    pdf = pd.DataFrame({"id": np.arange(len(X)), "x": X[:, 0], "y": X[:, 1]})
    if labels is not None:
        pdf["label"] = labels
    return spark.createDataFrame(pdf)


@pytest.mark.parametrize("seed,eps,ms,budget", [(0, 0.05, 5, 50_000_000), (1, 0.04, 6, 0), (2, 0.08, 12, 0),
                                                (3, 0.02, 3, 50_000_000)])
def test_dbscan_equals_brute_force(spark, seed, eps, ms, budget):
    X = blobs(seed)
    got = dbscan(frame(spark, X), "id", "x", "y", eps, ms, pair_budget=budget).orderBy("id").toPandas()["cluster"]
    got = got.to_numpy()
    assert (got == brute_dbscan(X, eps, ms)).all()


def test_dbscan_one_cluster_and_all_noise(spark):
    X = np.random.default_rng(5).uniform(0.5, 0.501, size=(50, 2))
    got = dbscan(frame(spark, X), "id", "x", "y", 0.02, 20).toPandas()["cluster"]
    assert set(got) == {0}
    Y = np.random.default_rng(6).uniform(0, 1, size=(30, 2))
    assert set(dbscan(frame(spark, Y), "id", "x", "y", 0.001, 3).toPandas()["cluster"]) == {-1}


def brute_ward(X, k):
    clusters = {i: (1.0, X[i].copy(), [i]) for i in range(len(X))}
    while len(clusters) > k:
        ids = sorted(clusters)
        best = None
        for ai, a in enumerate(ids):
            na, ca, _ = clusters[a]
            for b in ids[ai + 1:]:
                nb, cb, _ = clusters[b]
                cost = na * nb / (na + nb) * float(((ca - cb) ** 2).sum())
                if best is None or cost < best[0]:
                    best = (cost, a, b)
        _, a, b = best
        na, ca, ma = clusters[a]
        nb, cb, mb = clusters.pop(b)
        clusters[a] = (na + nb, (ca * na + cb * nb) / (na + nb), ma + mb)
    return {frozenset(m) for _, _, m in clusters.values()}


def sequential_ward(n, x, y):
    """Always the cheapest pair (ties: smallest numbers): (absorbed, survivor, cost, size) in order."""
    n, x, y = (np.array(a, float) for a in (n, x, y))
    live, out = np.ones(len(n), bool), []
    best, near = np.full(len(n), np.inf), np.zeros(len(n), int)

    def search(i):
        c = n * n[i] / (n + n[i]) * ((x - x[i]) ** 2 + (y - y[i]) ** 2)
        c[~live] = np.inf
        c[i] = np.inf
        near[i], best[i] = c.argmin(), c.min()

    for i in range(len(n)):
        search(i)
    for _ in range(len(n) - 1):
        i = int(np.where(live, best, np.inf).argmin())
        a, b = sorted((i, int(near[i])))
        x[a], y[a] = ((n[a] * z[a] + n[b] * z[b]) / (n[a] + n[b]) for z in (x, y))
        n[a] += n[b]
        live[b] = False
        out.append((b, a, float(best[i]), n[a]))
        for j in np.flatnonzero(live & ((near == a) | (near == b))).tolist() + [a]:
            search(j)
    return out


def test_ward_tree_equals_sequential_on_5000_places(spark):
    X = np.concatenate([np.random.default_rng(2).normal(c, s, size=(1000, 2)) for c, s in (((0, 0), 1), ((9, 0), 0.1), ((0, 9), 3), ((9, 9), 1), ((500, 0), 50))])
    got = sorted(tuple(r) for r in ward_tree(frame(spark, X), "id", "x", "y").drop("round").collect())
    want = sorted(sequential_ward(np.ones(len(X)), *X.T))
    assert [(a, b) for a, b, _, _ in got] == [(a, b) for a, b, _, _ in want]
    assert np.allclose([r[2:] for r in got], [r[2:] for r in want], rtol=1e-6)


def test_ward_rounds_over_tables(spark, monkeypatch):
    """Blocks, boxes and probes, with repeated places, far rows and sizes that differ widely."""
    monkeypatch.setattr(ward_module, "SMALL", 40)
    monkeypatch.setattr(ward_module, "BLOCK", 32)
    monkeypatch.setattr(ward_module, "PROBES", 16)
    rng = np.random.default_rng(3)
    X = np.concatenate([rng.normal(0, 1, (300, 2)), rng.normal(5, 0.05, (150, 2)), [[1e4, 1e4], [-1e3, 5.0], [1e4, -1e4]]])
    heavy = np.concatenate([X, *[X[i:i + 1].repeat(9 + 7 * i, 0) for i in range(12)]])
    got = sorted(tuple(r) for r in ward_tree(frame(spark, heavy), "id", "x", "y").drop("round").collect())
    n = np.ones(len(X))
    n[:12] += 9 + 7 * np.arange(12)
    want = sorted(sequential_ward(n, *X.T))
    assert [(a, b) for a, b, _, _ in got] == [(a, b) for a, b, _, _ in want]
    assert np.allclose([r[2:] for r in got], [r[2:] for r in want], rtol=1e-6)
    labels = ward(frame(spark, heavy), "id", "x", "y", 7).toPandas().set_index("id")["cluster"]
    cut = {b: a for b, a, *_ in sorted(want, key=lambda r: r[2])[:-6]}

    def top(i):
        while i in cut:
            i = cut[i]
        return i
    tops = [top(i) for i in range(len(X))]
    names = sorted(set(tops))
    assert [labels[i] for i in range(len(X))] == [names.index(t) for t in tops]


def test_ward_search_by_tasks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(ward_module, "PAIRS", 100)
    lattice = np.array([[i, j] for i in range(9) for j in range(9)], float)
    got = ward_tree(frame(spark, lattice), "id", "x", "y").collect()
    assert len(got) == 80 and len({r.absorbed for r in got}) == 80 and all(r.survivor < r.absorbed for r in got)
    one = ward(frame(spark, np.array([[1.0, 2.0], [1.0, 2.0], [np.nan, 1.0]])), "id", "x", "y", 3).toPandas().sort_values("id")["cluster"].tolist()
    assert one[:2] == [0, 0] and np.isnan(one[2])
    none = ward(frame(spark, np.zeros((1, 2))).limit(0), "id", "x", "y", 3)
    assert none.collect() == [] and none.columns == ["id", "cluster"]


@pytest.mark.parametrize("seed,k", [(0, 4), (4, 3)])
def test_ward_equals_sequential(spark, seed, k):
    X = blobs(seed, 60)
    got = ward(frame(spark, X), "id", "x", "y", k, bins=100_000).toPandas()  # a row per cell
    parts = {frozenset(g["id"].tolist()) for _, g in got.groupby("cluster")}
    assert parts == brute_ward(X, k)
    assert sorted(got["cluster"].unique()) == list(range(k))


@pytest.mark.parametrize("seed,k", [(0, 4), (4, 3)])
def test_ward_adapts_to_far_rows(spark, seed, k):
    X = np.concatenate([blobs(seed, 60), [[1000.0, 1000.0]]])  # one cell of a min-max grid would hold all other rows
    for cells in (None, ward_module.CELLS):
        got = ward(frame(spark, X), "id", "x", "y", k, cells=cells).toPandas()
        assert {frozenset(g["id"].tolist()) for _, g in got.groupby("cluster")} == brute_ward(X, k)


def test_ward_keeps_centres_when_cells_are_few(spark):
    rng = np.random.default_rng(8)
    X = np.concatenate([rng.normal(c, 0.01, size=(1500, 2)) for c in ((0, 0), (0, 1), (1, 0))] + [[[1000.0, 1000.0], [np.nan, 0.0]]])
    got = ward(frame(spark, X), "id", "x", "y", 4, cells=ward_module.CELLS).toPandas().sort_values("id")["cluster"].tolist()
    assert got[:4501] == [0] * 1500 + [1] * 1500 + [2] * 1500 + [3] and np.isnan(got[4501])


def np_silhouette(X, lab):
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    out = []
    for i in range(len(X)):
        own = lab == lab[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = D[i, own].sum() / (own.sum() - 1)
        b = min(D[i, lab == c].mean() for c in set(lab) if c != lab[i])
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_metrics_equal_numpy(spark):
    X = blobs(7, 150)
    lab = np.array([0 if p[0] < 0.5 else (1 if p[1] < 0.5 else 2) for p in X])
    lab[0] = 3  # a singleton cluster
    pdf = pd.DataFrame({"id": np.arange(len(X)), "label": lab})
    pdf["v"] = list(X)
    df = spark.createDataFrame(pdf)
    s = me.silhouette(df, "id", "v", "label", sample_size=None, decimals=None)
    assert abs(s - np_silhouette(X, lab)) < 1e-9
    rows, grand = me.centroid_pass(df, "id", "v", "label")
    ks = sorted(set(lab))
    C = np.array([X[lab == k].mean(0) for k in ks])
    S = np.array([np.sqrt(((X[lab == k] - C[i]) ** 2).sum(1)).mean() for i, k in enumerate(ks)])
    Dc = np.sqrt(((C[:, None] - C[None]) ** 2).sum(-1))
    Dc[Dc == 0] = np.inf
    db = np.mean(np.max((S[:, None] + S[None]) / Dc, axis=1))
    assert abs(me.davies_bouldin_from(rows) - db) < 1e-9
    n, k = len(X), len(ks)
    B = sum((lab == kk).sum() * ((C[i] - X.mean(0)) ** 2).sum() for i, kk in enumerate(ks))
    W = sum(((X[lab == kk] - C[i]) ** 2).sum() for i, kk in enumerate(ks))
    assert abs(me.calinski_harabasz_from(rows, grand) - B * (n - k) / (W * (k - 1))) < 1e-6


def test_evaluate_sentinels(spark):
    pdf = pd.DataFrame({"id": range(4), "label": [0, 0, -1, -1]})
    pdf["v"] = [[0.0, 1.0]] * 4
    r = me.evaluate(spark.createDataFrame(pdf), "id", "v", "label", "x").collect()[0]
    assert (r["n_clusters"], r["silhouette"], r["davies_bouldin"], r["calinski_harabasz"], r["noise_pct"]) == \
        (1, -1.0, 99.0, 0.0, 50.0)


def test_batched_kmeans_recovers_blobs_and_reports_inertia(spark):
    from blotter.operators.cluster import kmeans_sweep
    from blotter.operators.kmeans_batch import fit_many

    rng = np.random.default_rng(11)
    centres = np.array([[0.2, 0.2], [0.8, 0.3], [0.5, 0.85]])
    X = np.vstack([c + rng.normal(scale=0.02, size=(80, 2)) for c in centres])
    pdf = pd.DataFrame({"id": np.arange(len(X))})
    pdf["v"] = list(X)
    df = spark.createDataFrame(pdf)
    fits = fit_many(df, [(3, 42 + i) for i in range(4)])
    C, inertia, _, converged = min(fits.values(), key=lambda f: f[1])
    assert converged
    lab = ((X[:, None] - C[None]) ** 2).sum(-1).argmin(1)
    truth = np.repeat(np.arange(3), 80)
    assert {frozenset(np.nonzero(lab == j)[0]) for j in range(3)} == \
        {frozenset(np.nonzero(truth == j)[0]) for j in range(3)}
    assert abs(inertia - ((X - C[lab]) ** 2).sum()) < 1e-9
    for j in range(3):  # Lloyd fixed point
        assert np.allclose(C[j], X[lab == j].mean(0))
    table, _ = kmeans_sweep(df.selectExpr("id", "v"), [2, 3, 4], n_init=2)
    rows = {r["k"]: r for r in table.collect()}
    assert max(rows, key=lambda k: rows[k]["silhouette"]) == 3


def test_dbscan_hot_cell_is_salted_and_exact(spark):
    rng = np.random.default_rng(21)
    hot = np.full((120, 2), 0.5) + rng.normal(scale=1e-4, size=(120, 2))  # a third of the rows in one cell
    rest = np.vstack([blobs(9, 200), rng.uniform(0.45, 0.55, size=(40, 2))])
    X = np.vstack([hot, rest])[rng.permutation(360)]
    got = dbscan(frame(spark, X), "id", "x", "y", 0.03, 8, salt_rows=16).orderBy("id").toPandas()["cluster"]
    assert (got.to_numpy() == brute_dbscan(X, 0.03, 8)).all()


@pytest.mark.parametrize("ms", [3, 5])
def test_dbscan_lattice_duplicates_and_negative_coordinates(spark, ms):
    eps = 0.05
    g = np.array([(i * eps - 0.3, j * eps - 0.2) for i in range(8) for j in range(5)])
    dup = g[::7]  # exact copies
    far = np.array([[3.0, 3.0], [3.0 + eps, 3.0], [-2.0, -2.0]])
    X = np.vstack([g, dup, far])
    got = dbscan(frame(spark, X), "id", "x", "y", eps, ms, pair_budget=0).orderBy("id").toPandas()["cluster"]
    got = got.to_numpy()
    assert (got == brute_dbscan(X, eps, ms)).all()


def points_frame(spark, X, ids=None):
    ids = range(len(X)) if ids is None else ids
    return spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, X, strict=True)], "id long, v array<double>")


def test_empty_centre_moves_to_the_farthest_row(spark):
    X = np.array([[0, 0], [0.1, 0], [0, 0.2], [5, 5], [5.1, 5], [9, 0]], float)
    centres = [np.array([[0, 0], [4, 4], [1e6, 1e6]]), np.array([[0, 0], [5, 5], [9, 0]], float), np.array([[3, 2], [1e6, 0], [1e6, 1], [1e6, 2]])]
    sources = kmeans_batch.Rows(np.arange(6), X), kmeans_batch.Table(points_frame(spark, X).repartition(3))
    for source in sources:
        got = kmeans_batch.moved(source, centres, source.lloyd(centres, [0, 1, 2]))
        # (9, 0) is farthest from its centre (4, 4) and leaves it
        assert np.allclose(got[0], [[0.1 / 3, 0.2 / 3], [5.05, 5], [9, 0]])
        assert np.allclose(got[1], [[0.1 / 3, 0.2 / 3], [5.05, 5], [9, 0]])
        # three empty centres take the three farthest rows of the only other one
        far = X[np.argsort(-((X - [3, 2]) ** 2).sum(1), kind="stable")]
        assert np.allclose(got[2][1:], far[:3]) and np.allclose(got[2][0], far[3:].mean(axis=0))


def test_fits_in_tasks_and_over_tables_agree(spark, monkeypatch):
    X = np.concatenate([blobs(1, 150), blobs(2, 150) + 3])
    specs = [(k, s) for k in (2, 5) for s in range(4)]
    small = kmeans_batch.fit_many(points_frame(spark, X), specs)
    monkeypatch.setattr(kmeans_batch, "SMALL_VALUES", 0)
    for parts in (1, 5):
        big = kmeans_batch.fit_many(points_frame(spark, X).repartition(parts), specs)
        for spec in specs:
            assert np.allclose(big[spec][0], small[spec][0]) and np.isclose(big[spec][1], small[spec][1]) and big[spec][2:] == small[spec][2:]


@pytest.mark.parametrize("limit", [0, 10**6])
def test_farthest_first_seeding(spark, monkeypatch, limit):
    """Against a plain loop: farthest-first starts (ties: the least id), then Lloyd; rows used up repeat the last centre."""
    monkeypatch.setattr(kmeans_batch, "SMALL_VALUES", limit)
    X = np.concatenate([blobs(1, 60), blobs(2, 60) + 3])
    fits = kmeans_batch.fit_many(points_frame(spark, X).repartition(4), [(2, 0), (5, 0)], 30, 0.0, "farthest")
    for k in (2, 5):
        C = X[[0]]
        while len(C) < k:
            d2 = ((X[:, None] - C[None]) ** 2).sum(2).min(1)
            C = np.vstack([C, X[[d2.argmax()]]])
        for _ in range(30):
            lab = ((X[:, None] - C[None]) ** 2).sum(2).argmin(1)
            C = np.stack([X[lab == j].mean(0) for j in range(k)])
        inertia = ((X[:, None] - C[None]) ** 2).sum(2).min(1).sum()
        assert np.allclose(fits[k, 0][0], C) and np.isclose(fits[k, 0][1], inertia)
    two = points_frame(spark, np.array([[0.0, 0.0], [1.0, 1.0], [0.0, 0.0]]))
    C, inertia, _, _ = kmeans_batch.fit_many(two, [(3, 0)], 5, 0.0, "farthest")[3, 0]
    assert len(C) == 3 and inertia == 0 and {tuple(c) for c in C} == {(0.0, 0.0), (1.0, 1.0)}
    with pytest.raises(ValueError, match="seeding"):
        kmeans_batch.fit_many(two, [(3, 0)], seeding="nearest")


def test_dbscan_cells_far_from_the_origin(spark):
    """Cells 2^32 steps apart are not one cell."""
    side = 0.1 / np.sqrt(2) * (1 - 1e-12)
    near = np.array([[0.5 * side + i * 1e-4, 0.5 * side] for i in range(6)])
    X = np.concatenate([near, near + [side * 2**32, 0], near - [0, side * 2**33], [[1e12, -1e12]]])
    got = dbscan(frame(spark, X), "id", "x", "y", 0.1, 4).orderBy("id").toPandas()["cluster"]
    assert got.tolist() == [0] * 6 + [1] * 6 + [2] * 6 + [-1]


def test_semi_join_on_more_keys_than_are_broadcast(spark, monkeypatch):
    from blotter.operators import sampling

    monkeypatch.setattr(sampling, "BROADCAST_KEYS", 3)
    keys = spark.range(0, 8, 2)
    assert sorted(r.id for r in sampling.align_semi(spark.range(10), keys, "id", keys_bounded=True).collect()) == [0, 2, 4, 6]
    assert sorted(r.id for r in sampling.align_semi(spark.range(10), keys.limit(1), "id", keys_bounded=True).collect()) == [0]


def test_seeding_is_at_least_as_good_as_plain_draws():
    """Oversampled seeding against k-means++ without trials, both followed by Lloyd, over 20 seeds."""
    rng = np.random.default_rng(0)
    X = np.concatenate([rng.normal(c, 0.3, size=(60, 2)) for c in rng.uniform(0, 20, size=(12, 2))])
    rows = kmeans_batch.Rows(np.arange(len(X)), X)
    mine = [kmeans_batch.fit_source(rows, [(12, s)], 2, 1e-6, 100)[12, s][1] for s in range(20)]

    def plain(seed):
        rng = np.random.default_rng(seed)
        C = X[[rng.integers(len(X))]]
        while len(C) < 12:
            d2 = kmeans_batch._distances(X, C)[1]
            C = np.vstack([C, X[[rng.choice(len(X), p=d2 / d2.sum())]]])
        for _ in range(100):
            C = kmeans_batch.moved(rows, [C], rows.lloyd([C], [0]))[0]
        return rows.lloyd([C], [0])[0][2]
    other = [plain(s) for s in range(20)]
    assert np.mean(mine) <= np.mean(other) and min(mine) <= min(other) * (1 + 1e-9)


@pytest.mark.parametrize("limit", [0, 10**6])
def test_kmeans_odd_tables(spark, monkeypatch, limit):
    monkeypatch.setattr(kmeans_batch, "SMALL_VALUES", limit)
    schema = "id long, v array<double>"
    none = spark.createDataFrame([(1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0])], schema)
    for empty in (none, none.limit(0)):
        fits = kmeans_batch.fit_many(empty, [(2, 1)])
        assert fits[2, 1][0].size == 0 and fits[2, 1][1] == 0.0
        table, centres = cl.kmeans_sweep(empty, [2, 3], n_init=2)
        assert [tuple(r) for r in table.collect()] == [(2, 0.0, None), (3, 0.0, None)]
        assert kmeans_batch.assign(empty, centres[2]).filter("cluster is not null").isEmpty()
    few = none.unionByName(spark.createDataFrame([(5, [0.0, 0.0]), (6, [0.0, 0.0]), (7, [1.0, 1.0]), (8, [1.0])], schema))
    centres, inertia, _, done = kmeans_batch.fit_many(few, [(3, 1)])[3, 1]  # fewer places than centres
    assert done and inertia == 0.0 and {tuple(c) for c in centres.tolist()} == {(0.0, 0.0), (1.0, 1.0)}
    table, _ = cl.kmeans_sweep(few, [2], n_init=2)
    assert table.first()["inertia"] == 0.0


@pytest.mark.parametrize("block", [64, 1024])
def test_silhouette_of_every_row(spark, block):
    rng = np.random.default_rng(11)
    X = np.concatenate([rng.normal(c, 1, size=(1300, 3)) for c in ((0, 0, 0), (6, 0, 0), (0, 9, 3))] + [[[50.0, 50, 50]], rng.normal(0, 8, size=(99, 3))])
    lab = np.array([0] * 1300 + [1] * 1300 + [2] * 1300 + [7] + [-1] * 99)
    frame_ = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(X)), "v": list(X), "c": lab}), "id long, v array<double>, c int")
    got = me.silhouette_rows(frame_, "id", "v", "c", block).toPandas().set_index("id").sort_index()
    keep = lab != -1
    Y, l = X[keep], lab[keep]
    s2 = (Y ** 2).sum(1)
    D = np.sqrt(np.maximum(s2[:, None] + s2 - 2 * Y @ Y.T, 0))
    np.fill_diagonal(D, 0)
    mean = {c: D[:, l == c].sum(1) / (l == c).sum() for c in (0, 1, 2, 7)}
    for i in range(0, len(Y), 7):
        n = (l == l[i]).sum()
        a = mean[l[i]][i] * n / (n - 1) if n > 1 else 0.0
        b = min(m[i] for c, m in mean.items() if c != l[i])
        want = 0.0 if n == 1 else (b - a) / max(a, b)
        assert np.allclose([got.a[i], got.b[i], got.silhouette[i]], [a, b, want], atol=1e-6)
    assert len(got) == len(Y) and got.silhouette[3900] == 0.0
    one = me.silhouette_rows(frame_.filter("c = 1"), "id", "v", "c").toPandas()
    assert one.silhouette.isna().all() and me.silhouette_rows(frame_.limit(0), "id", "v", "c").collect() == []


def test_bounded_sample_counts_before_it_moves_rows(spark):
    with pytest.raises(ValueError, match="exceed the bound"):
        me.bounded_sample(points_frame(spark, np.zeros((50, 2))), None, 1, 49)
    assert len(me.bounded_sample(points_frame(spark, np.zeros((50, 2))), 10, 1, 49)) == 10
