"""K-Means fits and sweeps.

Fits use every row.  The reference restarts each fit ``n_init`` times and
keeps the least inertia, for every k of a sweep; :mod:`kmeans_batch` advances
all those restarts in the same passes over the data (one scan per Lloyd
iteration for the whole sweep).  A single Spark ML ``KMeans`` fit is kept for
users who need a persistable ML model.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blotter.functions import fixed
from blotter.operators import metrics
from blotter.operators.kmeans_batch import assign, fit_many, lloyd, usable  # noqa: F401


def as_vectors(df: DataFrame, id_col: str, cols: list[str] | None = None, array_col: str | None = None) -> DataFrame:
    """(id, features: vector, v: array<double>) from columns or an array."""
    if array_col is not None:
        arr = F.col(array_col).cast("array<double>")
    else:
        arr = F.array(*[F.col(f"`{c}`").cast("double") for c in cols])
    return df.select(F.col(id_col).alias("id"), arr.alias("v")).withColumn("features", array_to_vector("v"))


def _fit(vec: DataFrame, k: int, seed: int, max_iter: int, tol: float) -> KMeansModel:
    return KMeans(k=k, seed=seed, maxIter=max_iter, tol=tol, featuresCol="features",
                  predictionCol="cluster").fit(vec)


def _fit_input(vec: DataFrame, sample_size: int | None, seed: int) -> DataFrame:
    """All rows by default; optionally the reference's seeded exact sample
    (20,000 rows in its geographic and temporal stages)."""
    from blotter.operators.sampling import sample_exact

    pts = vec.select("id", "v")
    return sample_exact(pts, sample_size, "id", seed) if sample_size else pts


def fit_best(vec: DataFrame, k: int, n_init: int = 10, seed: int = fixed.RANDOM_STATE,
             max_iter: int = 300, tol: float = 1e-4, sample_size: int | None = None, seeding: str = "oversampled"):
    """Least-inertia centres over ``n_init`` seeded restarts, all restarts in
    the same passes (K1).  Returns (centres, inertia).  ``farthest`` seeding has one start."""
    starts = 1 if seeding == "farthest" else n_init
    fits = fit_many(_fit_input(vec, sample_size, seed), [(k, seed + i) for i in range(starts)], max_iter, tol, seeding)
    centres, inertia, _, _ = min(fits.values(), key=lambda f: f[1])
    return centres, inertia


def fit_spark_model(vec: DataFrame, k: int, seed: int = fixed.RANDOM_STATE, max_iter: int = 300,
                    tol: float = 1e-4) -> KMeansModel:
    """A single Spark ML K-Means fit, for persistence as an ML model."""
    return _fit(vec, k, seed, max_iter, tol)


def kmeans_labels(vec: DataFrame, centres) -> DataFrame:
    """``vec`` with all its columns and ``cluster``."""
    return assign(vec, centres, "cluster")


def kmeans_sweep(vec: DataFrame, ks: list[int], n_init: int = 10, seed: int = fixed.RANDOM_STATE,
                 sample_size: int = fixed.SILHOUETTE_SAMPLE, max_iter: int = 300,
                 tol: float = 1e-4, fit_sample: int | None = None,
                 seeding: str = "oversampled") -> tuple[DataFrame, dict]:
    """Table (k, inertia, silhouette) over ``ks`` and the best centres per k (K2, K3).

    All k x n_init fits share their passes over the data; the silhouettes of
    all k use one seeded sample (as the reference: same random state for
    every k) and one Spark job.  ``fit_sample`` fits on a seeded exact sample
    of that many rows instead of all rows; ``farthest`` seeding has one start per k.
    """
    spark = vec.sparkSession
    pts = _fit_input(vec, fit_sample, seed)
    starts = 1 if seeding == "farthest" else n_init
    fits = fit_many(pts, [(k, seed + i) for k in ks for i in range(starts)], max_iter, tol, seeding)
    best = {}
    for (k, _), (centres, inertia, _, _) in fits.items():
        if k not in best or inertia < best[k][1]:
            best[k] = (centres, inertia)
    if not len(best[ks[0]][0]):  # no rows
        return spark.createDataFrame([(k, 0.0, None) for k in ks], "k int, inertia double, silhouette double"), {k: b[0] for k, b in best.items()}
    dim = best[ks[0]][0].shape[1]
    sample = metrics.bounded_sample(usable(pts).filter(F.size("v") == dim), sample_size, seed, max(sample_size, 1))
    X = np.vstack(sample["v"].to_numpy())
    labellings = {k: ((X[:, None, :] - best[k][0][None, :, :]) ** 2).sum(axis=2).argmin(axis=1) for k in ks}
    parted = {k: lab for k, lab in labellings.items() if len(np.unique(lab)) >= 2}
    sils = metrics.silhouette_many(spark, X, parted) if parted else {}
    rows = [(k, float(best[k][1]), sils.get(k)) for k in ks]
    table = spark.createDataFrame(rows, "k int, inertia double, silhouette double")
    return table, {k: best[k][0] for k in ks}


def cluster_positions(vec: DataFrame, k: int, n: int, seed: int = fixed.RANDOM_STATE, n_init: int = 10,
                      silhouette_n: int = 2_000, max_iter: int = 300, tol: float = 1e-4,
                      seeding: str = "oversampled") -> DataFrame:
    """Seeded exact sample of n rows, K-Means with restarts, evaluation with
    a silhouette sample of ``silhouette_n`` rows (K4)."""
    from blotter.operators.sampling import sample_exact

    pts = sample_exact(vec.select("id", "v"), n, "id", seed)
    centres, _ = fit_best(pts, k, n_init, seed, max_iter, tol, seeding=seeding)
    labels = kmeans_labels(pts, centres)
    return metrics.evaluate(labels, "id", "v", "cluster", f"KMeans_k{k}", sample_size=silhouette_n, seed=seed)


def best_k(table: DataFrame) -> int:
    """k with the largest silhouette, the smaller k on ties."""
    return metrics.best_candidate(table, "silhouette", "k").collect()[0]["k"]
