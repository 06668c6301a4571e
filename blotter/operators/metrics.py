"""Cluster evaluation.

* Davies-Bouldin and Calinski-Harabasz use every row: centroids are a grouped
  aggregate, and one pass joins each row to its (size-checked, broadcast)
  centroid to get distances.  Only the k x k centroid comparison runs on the
  driver, k being the number of clusters.
* Euclidean silhouette is quadratic, so, as in the reference, it is taken on
  an exact seeded sample (3,000 rows by default).  The sample is checked
  against its bound and broadcast; tasks hold query rows and compute
  per-cluster distance sums with numpy: no cross join, no pair rows.
* ``silhouette_rows`` takes it of every row: the clusters that centroids and mean radii do not rule out pass by
  blocks of rows that tasks hold.  No row reaches the driver and none is broadcast.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import pyarrow as pa

from blotter.functions import fixed
from blotter.operators.pairs import HELD, PASSING, block_rows, held_side, matrix, pair_distances, passing_side, slack, stream_groups
from blotter.operators.sampling import sample_exact
from blotter.session import materialize

MAX_CLUSTERS = 100_000


def _points(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"),
                     F.col(label_col).cast("long").alias("label"))


def _sq_dist(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)


# --- silhouette ---------------------------------------------------------------------


def silhouette_many(spark, X: np.ndarray, labellings: dict[str, np.ndarray], parts: int | None = None) -> dict:
    """Mean Euclidean silhouette of one bounded point set under several
    labellings, in one Spark job.

    The points (a checked, bounded sample) are broadcast once; task p takes
    the p-th slice of query rows and, per labelling, sums distances per
    cluster with numpy.  Singletons score 0, as do rows with a = b = 0.
    """
    names = list(labellings)
    codes = []
    for nm in names:
        _, inv = np.unique(labellings[nm], return_inverse=True)
        codes.append(inv)
    parts = parts or max(1, spark.sparkContext.defaultParallelism)
    bc = spark.sparkContext.broadcast((np.asarray(X, dtype=float), codes))
    n = len(X)

    def run(batches):
        import pandas as pd

        mat, cds = bc.value
        for pdf in batches:
            tot = np.zeros(len(cds))
            for p in pdf["id"].to_numpy():
                lo, hi = int(p) * n // parts, (int(p) + 1) * n // parts
                budget = 4_000_000
                step = max(1, budget // max(1, n * mat.shape[1]))
                for s in range(lo, hi, step):
                    e = min(hi, s + step)
                    diff = mat[s:e, None, :] - mat[None, :, :]
                    dist = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
                    for li, inv in enumerate(cds):
                        sizes = np.bincount(inv).astype(float)
                        sums = np.zeros((e - s, len(sizes)))
                        for c in range(len(sizes)):
                            sums[:, c] = dist[:, inv == c].sum(axis=1)
                        own = inv[s:e]
                        rows = np.arange(e - s)
                        with np.errstate(divide="ignore", invalid="ignore"):
                            a = sums[rows, own] / (sizes[own] - 1)
                            mean_other = sums / sizes[None, :]
                        mean_other[rows, own] = np.inf
                        b = mean_other.min(axis=1)
                        den = np.maximum(a, b)
                        with np.errstate(divide="ignore", invalid="ignore"):
                            sv = (b - a) / den
                        sv[(sizes[own] <= 1) | ~np.isfinite(sv)] = 0.0
                        tot[li] += sv.sum()
            yield pd.DataFrame({"li": np.arange(len(cds)), "s": tot})

    res = (spark.range(0, parts, 1, parts).mapInPandas(run, "li long, s double")
           .groupBy("li").agg(F.sum("s").alias("s")).collect())
    bc.unpersist()
    return {names[r["li"]]: (r["s"] / n if n else None) for r in res}


def bounded_sample(pts: DataFrame, sample_size: int | None, seed: int, bound: int):
    """Exact seeded sample of (id, v, ...) rows, checked against ``bound`` and
    brought to the driver as pandas (the sample, never the table)."""
    if sample_size:
        pts = sample_exact(pts, sample_size, "id", seed)
    if not sample_size or sample_size > bound:  # count before any row moves
        n = pts.count()
        if n > bound:
            raise ValueError(f"silhouette: {n} rows exceed the bound {bound}")
    return pts.orderBy("id").toPandas()


def silhouette(df: DataFrame, id_col: str, vec_col: str, label_col: str,
               sample_size: int | None = fixed.SILHOUETTE_SAMPLE, seed: int = fixed.RANDOM_STATE,
               decimals: int | None = 6, bound: int = fixed.GEO_SAMPLE) -> float | None:
    """Mean Euclidean silhouette of non-noise rows on a seeded exact sample (K7)."""
    pts = _points(df, id_col, vec_col, label_col).where(F.col("label") != -1)
    pdf = bounded_sample(pts, sample_size, seed, bound)
    if pdf["label"].nunique() < 2:
        return None
    val = silhouette_many(df.sparkSession, np.vstack(pdf["v"].to_numpy()), {"s": pdf["label"].to_numpy()})["s"]
    return None if val is None else (round(val, decimals) if decimals is not None else val)


class _Silhouettes:
    """a and b of each row of a held block, from the members of one cluster after the other that pass by."""

    def __init__(self, names: np.ndarray, c: np.ndarray, size: np.ndarray, centre: np.ndarray):
        self.names, self.c, self.size, self.centre = names, c, size, centre
        self.held, self.target = [], None

    def add(self, b: pa.RecordBatch) -> None:
        """Rows (role, label, id, v, reach): those of role 0 are held and come first, then members by label."""
        role, label, ids, v, reach = (b.column(b.schema.get_field_index(c)) for c in ("role", "label", "id", "v", "reach"))
        role, label, ids, v, reach = np.asarray(role), np.asarray(label), np.asarray(ids), matrix(v), np.asarray(reach)
        mine = int((role == 0).sum())
        if mine:
            self.held.append((ids[:mine], label[:mine], v[:mine], reach[:mine]))
        edges = [mine, *(np.flatnonzero(np.diff(label[mine:])) + 1 + mine).tolist(), len(label)] if mine < len(label) else []
        for s, e in zip(edges, edges[1:], strict=False):
            if label[s] != self.target:
                self.finish()
                self.begin(int(label[s]))
            self.meet(v[s:e])

    def settle(self) -> None:
        if isinstance(self.held, list):
            self.held = tuple(np.concatenate(x) for x in zip(*self.held, strict=True))
            self.left, self.norms = held_side(self.held[2], self.centre)
            self.a, self.b = np.full(len(self.left), np.nan), np.full(len(self.left), np.inf)

    def begin(self, target: int) -> None:
        """The rows that the bounds do not keep from this cluster."""
        self.settle()
        at = np.searchsorted(self.names, target)
        _, label, v, reach = self.held
        far = np.empty(len(v))
        for s in range(0, len(v), 16_384):
            diff = v[s:s + 16_384] - self.c[at]
            far[s:s + 16_384] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
        self.rows = np.flatnonzero((label == target) | (far <= reach))
        self.target, self.n = target, int(self.size[at])
        self.of = self.left[self.rows], self.norms[self.rows], v[self.rows]
        self.sums = np.zeros(len(self.rows))

    def meet(self, members: np.ndarray) -> None:
        left, norms, v = self.of
        for s in range(0, len(members), PASSING):
            some = members[s:s + PASSING]
            right, theirs = passing_side(some, self.centre)
            for i in range(0, len(left), HELD):
                with np.errstate(over="ignore", invalid="ignore"):
                    d = left[i:i + HELD] @ right
                    off = slack(norms[i:i + HELD], theirs, v.shape[1])
                close = ~(d > 1e7 * off[:, None])  # the product keeps fewer than seven digits
                if close.any():
                    q, m = np.nonzero(close)
                    d[q, m] = pair_distances(v[i:i + HELD], q, some, m) ** 2
                self.sums[i:i + HELD] += np.sqrt(d, out=d).sum(axis=1)

    def finish(self) -> None:
        if self.target is None:
            return
        own = self.held[1][self.rows] == self.target
        if self.n > 1:
            self.a[self.rows[own]] = self.sums[own] / (self.n - 1)
        others = self.rows[~own]
        self.b[others] = np.minimum(self.b[others], self.sums[~own] / self.n)
        self.target = None

    def end(self) -> pa.Table:
        self.settle()
        self.finish()
        ids, label, _, _ = self.held
        alone, none = np.isnan(self.a), np.isinf(self.b)
        a = np.where(alone, 0.0, self.a)
        wider = np.maximum(a, self.b)
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.where(alone | (wider == 0), 0.0, (self.b - a) / wider)
        return pa.table({"id": ids, "label": label, "a": a, "b": pa.array(self.b, mask=none), "silhouette": pa.array(value, mask=none)})


def silhouette_rows(df: DataFrame, id_col: str, vec_col: str, label_col: str, block: int = 65_536) -> DataFrame:
    """(id, label, a, b, silhouette) of every row that is no noise, Euclidean and exact (K7); ids are unique.

    a: mean distance to the other rows of the own cluster, b: least mean distance to another cluster.  The mean distance
    to a cluster lies between the distance to its centroid and that plus the cluster's mean radius, so a row only meets
    clusters whose lower bound is below the least upper bound.  Rows are held in blocks of one large or several small
    clusters, some two blocks per core and at most ``block`` rows each; the clusters that a block's rows may need pass by
    in its task, which keeps two numbers per row.  The work is that of all pairs that the bounds leave, by matrix
    products (close pairs by differences); the driver sees a row per cluster.
    Singletons have silhouette 0; with fewer than two clusters b and the silhouette are null.
    """
    spark = df.sparkSession
    pts = materialize(_points(df, id_col, vec_col, label_col).where(F.col("label").isNotNull() & (F.col("label") != -1) & F.col("v").isNotNull())
                      .withColumn("id", F.col("id").cast("long")), "silhouette")
    clusters, grand = centroid_pass(pts, "id", "v", "label")  # at most MAX_CLUSTERS
    schema = "id long, label long, a double, b double, silhouette double"
    if not clusters:
        return spark.createDataFrame([], schema)
    rows = block_rows(sum(r["n"] for r in clusters), block, spark.sparkContext.defaultParallelism)
    first, slices, groups, room = [], [], 0, 0
    for r in clusters:  # a large cluster has blocks of its own, small ones share a block
        n = -(-r["n"] // rows)
        if n == 1 and r["n"] <= room:
            room -= r["n"]
            first.append(groups - 1)
        else:
            room = rows - r["n"] if n == 1 else 0
            first.append(groups)
            groups += n
        slices.append(n)
    shared = spark.sparkContext.broadcast((np.array([r["label"] for r in clusters]), np.array([r["c"] for r in clusters], float),
                                           np.array([r["mean_dist"] for r in clusters], float), np.array([r["n"] for r in clusters]),
                                           np.array(first), np.array(slices), grand))

    def wanted(batches):
        names, c, radius, size, first, slices, _ = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            X, at = matrix(b.column(1)), np.searchsorted(names, np.asarray(b.column(2)))
            targets, reaches = [], []
            step = max(1, 4_000_000 // c.size)
            for s in range(0, len(X), step):
                d = np.sqrt(((X[s:s + step, None, :] - c[None, :, :]) ** 2).sum(axis=2))
                mine = np.arange(len(d)), at[s:s + step]
                upper = d + radius
                upper[mine] = np.inf
                reach = upper.min(axis=1) * (1 + 1e-9) if len(names) > 1 else np.full(len(d), -1.0)
                hit = d <= reach[:, None]
                hit[mine] = size[at[s:s + step]] > 1
                targets += [names[h].tolist() for h in hit]
                reaches.append(reach)
            block = first[at] + (np.asarray(b.column(3)).astype(np.uint64) % slices[at].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), b.column(2), b.column(0), b.column(1), pa.array(np.concatenate(reaches)),
                                              pa.array(targets, pa.list_(pa.int64()))], ["block", "label", "id", "v", "reach", "targets"])

    asked = materialize(pts.select("id", "v", "label", F.xxhash64("id").alias("salt")).mapInArrow(
        wanted, "block int, label long, id long, v array<double>, reach double, targets array<long>"), "silhouette-asked")
    ask = asked.select("block", F.lit(0).alias("role"), "label", "id", "v", "reach")
    pairs = materialize(asked.select("block", F.explode("targets").alias("label")).distinct(), "silhouette-pairs")
    give = pts.join(pairs, "label").select("block", F.lit(1).alias("role"), "label", "id", "v", F.lit(0.0).alias("reach"))

    def start():
        names, c, _, size, _, _, centre = shared.value
        return _Silhouettes(names, c, size, centre)

    return stream_groups(ask.unionByName(give), "block", groups, ["role", "label"], start, schema)


def silhouette_all_rows(df: DataFrame, vec_col: str, label_col: str) -> DataFrame:
    """(silhouette, rows): squared-distance silhouette of all rows that are no noise, from cluster sums (K7).

    Linear in the rows, so no sample is needed; null below two clusters.
    """
    from pyspark.ml.evaluation import ClusteringEvaluator

    rows = df.where(F.col(label_col) != -1).select(array_to_vector(F.col(vec_col).cast("array<double>")).alias("features"),
                                                   F.col(label_col).cast("double").alias("prediction"))
    seen = rows.agg(F.count("*").alias("n"), F.count_distinct("prediction").alias("k")).first()
    value = ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(rows) if seen["k"] > 1 else None
    return df.sparkSession.createDataFrame([(value, seen["n"])], "silhouette double, rows long")


# --- Davies-Bouldin / Calinski-Harabasz --------------------------------------------------


def centroid_pass(df: DataFrame, id_col: str, vec_col: str, label_col: str):
    """Cluster sizes, centroids and, per cluster, mean distance and squared
    distance sum to the centroid; plus the grand mean.  All distributed."""
    pts = _points(df, id_col, vec_col, label_col).where(F.col("label") != -1)
    vec = pts.withColumn("vv", array_to_vector("v"))
    cents = (vec.groupBy("label")
             .agg(F.count("*").alias("n"), vector_to_array(Summarizer.mean(F.col("vv"))).alias("c")))
    k = cents.count()
    if not k:
        return [], None
    if k > MAX_CLUSTERS:
        raise ValueError(f"{k} clusters exceed the broadcast bound {MAX_CLUSTERS}")
    joined = pts.join(F.broadcast(cents.select("label", "c")), "label")
    d2 = _sq_dist(F.col("v"), F.col("c"))
    per = (joined.groupBy("label")
           .agg(F.avg(F.sqrt(d2)).alias("mean_dist"), F.sum(d2).alias("sq_sum")))
    rows = cents.join(per, "label").orderBy("label").collect()
    grand = vec.agg(vector_to_array(Summarizer.mean(F.col("vv"))).alias("m")).collect()[0]["m"]
    return rows, (np.array(grand) if grand is not None else None)


def davies_bouldin_from(rows) -> float:
    if len(rows) < 2:
        return fixed.SENTINEL_DAVIES_BOULDIN
    c = np.array([r["c"] for r in rows], dtype=float)
    s = np.array([r["mean_dist"] for r in rows], dtype=float)
    worst, apart = np.zeros(len(c)), False
    block = max(1, 4_000_000 // c.size)  # a few rows of the k x k comparison at once
    for i in range(0, len(c), block):
        dist = np.sqrt(((c[i:i + block, None, :] - c[None, :, :]) ** 2).sum(axis=2))
        apart |= not np.allclose(dist, 0)
        dist[dist == 0] = np.inf
        worst[i:i + block] = np.max((s[i:i + block, None] + s[None, :]) / dist, axis=1)
    return float(np.mean(worst)) if apart and not np.allclose(s, 0) else 0.0


def calinski_harabasz_from(rows, grand) -> float:
    k = len(rows)
    if k < 2:
        return fixed.SENTINEL_CALINSKI_HARABASZ
    n = sum(r["n"] for r in rows)
    c = np.array([r["c"] for r in rows], dtype=float)
    sizes = np.array([r["n"] for r in rows], dtype=float)
    between = float((sizes * ((c - grand) ** 2).sum(axis=1)).sum())
    within = float(sum(r["sq_sum"] for r in rows))
    if within == 0:
        return 1.0
    return between * (n - k) / (within * (k - 1))


def evaluate(df: DataFrame, id_col: str, vec_col: str, label_col: str, algorithm: str,
             sample_size: int | None = fixed.SILHOUETTE_SAMPLE, seed: int = fixed.RANDOM_STATE,
             decimals: int = 6) -> DataFrame:
    """One evaluation record (K10): n_clusters, silhouette, Davies-Bouldin,
    Calinski-Harabasz, noise % and the rows that the silhouette was taken on;
    fewer than two clusters gives the sentinels."""
    spark = df.sparkSession
    lab = F.col(label_col)
    counts = df.agg(F.count("*").alias("n"), F.count_if(lab == -1).alias("noise"),
                    F.count_distinct(F.when(lab != -1, lab)).alias("k")).collect()[0]
    n, noise, k = counts["n"], counts["noise"], counts["k"]
    noise_pct = float(noise) * 100.0 / n if n else 0.0
    rows_used = 0 if k < 2 else min(n - noise, sample_size or n - noise)
    if k < 2:
        sil, db, ch = fixed.SENTINEL_SILHOUETTE, fixed.SENTINEL_DAVIES_BOULDIN, fixed.SENTINEL_CALINSKI_HARABASZ
    else:
        rows, grand = centroid_pass(df, id_col, vec_col, label_col)
        db = davies_bouldin_from(rows)
        ch = calinski_harabasz_from(rows, grand)
        s = silhouette(df, id_col, vec_col, label_col, sample_size, seed, None)
        sil = s if s is not None else fixed.SENTINEL_SILHOUETTE
    rec = [(algorithm, int(k), float(sil), float(db), float(ch), float(noise_pct), int(rows_used))]
    out = spark.createDataFrame(rec, "algorithm string, n_clusters int, silhouette double, davies_bouldin double, "
                                     "calinski_harabasz double, noise_pct double, silhouette_rows long")
    return out.select("algorithm", "n_clusters",
                      *[F.bround(c, decimals).alias(c) for c in
                        ["silhouette", "davies_bouldin", "calinski_harabasz", "noise_pct"]], "silhouette_rows")


def cluster_sizes(df: DataFrame, label_col: str, decimals: int = 4) -> DataFrame:
    """Rows per cluster (noise = -1 included) and their share in %."""
    counts = df.groupBy(F.col(label_col).alias("cluster")).agg(F.count("*").alias("size"))
    total = F.lit(df.count())
    return counts.withColumn("pct", F.bround(F.col("size").cast("double") * 100.0 / total, decimals)) \
        .orderBy("cluster")


def best_candidate(scores: DataFrame, score_col: str, order_col: str) -> DataFrame:
    """Arg-max of a score, first candidate (by ``order_col``) wins ties."""
    return scores.orderBy(F.desc(score_col), F.asc(order_col)).limit(1)
