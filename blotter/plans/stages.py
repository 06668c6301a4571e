"""The reference's clustering stage as composed Spark jobs.

``geographic_clustering``: k sweep on the plane -> best k by silhouette ->
K-Means, DBSCAN and Ward at that k -> one evaluation record each -> the
comparison table, the best algorithm's labels, and one run record per
algorithm appended to the run log.

``temporal_clustering``: K-Means sweep on standardised time features, best k
(first maximum), labels and the cluster profile (size, mean hour, dominant
type, flag rate, day-part).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blotter.functions import fixed
from blotter.operators import cluster as cl
from blotter.operators import explore as ex
from blotter.operators import metrics as me
from blotter.operators import reduce as rd
from blotter.operators.dbscan import dbscan
from blotter.operators.kmeans_batch import nearest_centre
from blotter.operators.ward import ward
from blotter.session import materialize
from blotter.sources import io, publish, runs


def geographic_clustering(points: DataFrame, id_col: str, x_col: str, y_col: str,
                          ks=range(2, 11), n_init: int = 10, eps: float = fixed.DBSCAN_EPS,
                          min_samples: int = fixed.DBSCAN_MIN_SAMPLES, ward_bins: int | None = None,
                          run_log: str | None = None, experiment: str = "geographic_clustering",
                          output: str | None = None):
    """Returns (comparison, best_labels, sweep).

    With ``output`` the stage publishes its tables there as one version: ``geo_result`` (all columns of ``points`` and
    Geo_Cluster), ``best_model`` (the algorithm, its parameters and, for K-Means, the centres) and ``row_ids`` (the rows
    used).  The run record names them.
    """
    started = dt.datetime.now(dt.timezone.utc)
    plane = points.select(F.col(id_col).alias("id"), F.array(F.col(x_col).cast("double"),
                                                              F.col(y_col).cast("double")).alias("v"),
                          F.col(x_col).alias("x"), F.col(y_col).alias("y"))
    vec = plane.select("id", "v")
    sweep, centres = cl.kmeans_sweep(vec, list(ks), n_init=n_init)
    k = cl.best_k(sweep)
    labels = {
        "KMeans": cl.kmeans_labels(vec, centres[k]).select("id", "cluster"),
        "DBSCAN": dbscan(plane, "id", "x", "y", eps, min_samples),
        "Hierarchical": ward(plane, "id", "x", "y", k, ward_bins),
    }
    records = []
    for order_no, (name, lab) in enumerate(labels.items()):
        lab = materialize(lab.join(vec, "id"), "labels")
        records.append(me.evaluate(lab, "id", "v", "cluster", name).withColumn("order_no", F.lit(order_no)))
        labels[name] = lab
    comparison = records[0]
    for r in records[1:]:
        comparison = comparison.unionByName(r)
    comparison = materialize(comparison, "comparison")
    # ties go to the earlier algorithm, as an arg-max over the algorithms in order
    best = me.best_candidate(comparison, "silhouette", "order_no").collect()[0]["algorithm"]
    comparison = comparison.drop("order_no")
    rows = points.count()
    is_ = lambda name: F.col("algorithm") == name
    if run_log:
        params = {"algorithm": F.col("algorithm"), "sample_size": F.lit(str(rows)),
                  "k": F.when(is_("KMeans"), F.lit(str(k))),
                  "eps": F.when(is_("DBSCAN"), F.lit(str(eps))),
                  "min_samples": F.when(is_("DBSCAN"), F.lit(str(min_samples))),
                  "linkage": F.when(is_("Hierarchical"), F.lit("ward")),
                  "n_clusters": F.when(is_("Hierarchical"), F.lit(str(k)))}
        metrics = {m: F.col(m) for m in ["silhouette", "davies_bouldin", "calinski_harabasz", "noise_pct",
                                         "n_clusters"]}
        name = F.concat(F.col("algorithm"), F.lit("_geo"), F.when(~is_("DBSCAN"), F.lit(f"_k{k}")).otherwise(F.lit("")))
        made = [f"{output}#geo_result", f"{output}#row_ids"] if output else None
        runs.log_runs(runs.make_runs(comparison, F.lit(experiment), name, params, metrics, artifacts=made, started=started,
                                     model=f"{output}#best_model" if output else None), run_log)
    if output:
        spark = points.sparkSession
        result = (points.join(labels[best].select(F.col("id").alias(id_col), F.col("cluster").alias("Geo_Cluster")), id_col))
        model = spark.createDataFrame([(best, k, eps, min_samples, centres[k].tolist() if best == "KMeans" else None)],
                                      "algorithm string, k int, eps double, min_samples int, centres array<array<double>>")
        publish.publish({"geo_result": result, "best_model": model, "row_ids": points.select(id_col)}, output)
    return comparison, labels[best].select(F.col("id").alias(id_col), F.col("cluster").alias("Geo_Cluster")), sweep


def temporal_clustering(df: DataFrame, id_col: str, feature_cols: list[str], hour_col: str, type_col: str,
                        flag_col: str, ks=range(3, 7), n_init: int = 10, run_log: str | None = None,
                        experiment: str = "temporal_clustering", output: str | None = None):
    """Returns (profile, labels, sweep); features are standardised (population sd).

    With ``output``: ``temporal_result`` (all columns, Temporal_Cluster, Hour_val) and ``cluster_hours`` (rows per
    cluster and hour).
    """
    from blotter.operators import features as fe

    started = dt.datetime.now(dt.timezone.utc)
    z = fe.standard_scale(df, {c: f"__z{i}" for i, c in enumerate(feature_cols)})
    scaled = [f"__z{i}" for i in range(len(feature_cols))]
    vec = cl.as_vectors(z, id_col, scaled).select("id", "v")
    sweep, centres = cl.kmeans_sweep(vec, list(ks), n_init=n_init)
    # first maximum wins (strict improvement over smaller k)
    k = cl.best_k(sweep)
    nearest = nearest_centre(F.array(*scaled), centres[k])  # a column: the rows are neither moved nor joined
    joined = z.withColumn("Temporal_Cluster", nearest).select(*df.columns, "Temporal_Cluster")
    profile = ex.group_profile(joined, "Temporal_Cluster", type_col, flag_col, hour=hour_col)
    if output:
        io.write_table(joined.withColumn("Hour_val", F.col(hour_col)), f"{output}/temporal_result")
        back = io.read_table(df.sparkSession, f"{output}/temporal_result")
        io.write_table(back.groupBy("Temporal_Cluster", "Hour_val").agg(F.count("*").alias("count")), f"{output}/cluster_hours")
    if run_log:
        runs.log_runs(runs.make_runs(sweep, F.lit(experiment), F.concat(F.lit("KMeans_temporal_k"), F.col("k")),
                                     {"algorithm": F.lit("KMeans_temporal"), "k": F.col("k")},
                                     {"silhouette": F.col("silhouette"), "inertia": F.col("inertia")}, started=started,
                                     artifacts=[f"{output}/temporal_result", f"{output}/cluster_hours"] if output else None), run_log)
    return profile, joined, sweep


def dimension_reduction(X: DataFrame, feature_cols: list[str], keep: list[str], n_components: int = 3,
                        run_log: str | None = None, experiment: str = "dimension_reduction", output: str | None = None):
    """PCA of the feature matrix (R1-R3, S9, S11): returns (scree, loadings, projection).

    The run record holds the components' variances and how many reach 70 and 80 %; with ``output`` the projection is
    written to ``pca_result``.
    """
    spark, started = X.sparkSession, dt.datetime.now(dt.timezone.utc)
    fit = rd.PcaFit(X, feature_cols)
    scree = rd.pca_scree(spark, fit)
    projection = fit.project(keep, "PC", n_components)
    if output:
        io.write_table(projection, f"{output}/pca_result")
        projection = io.read_table(spark, f"{output}/pca_result")
    if run_log:
        first = scree.filter(F.col("component") <= n_components).agg(
            F.sum("variance_ratio").alias("total_variance"), F.max("n70").alias("n70"), F.max("n80").alias("n80"),
            *[F.max(F.when(F.col("component") == i + 1, F.col("variance_ratio"))).alias(f"variance_pc{i + 1}") for i in range(n_components)])
        metrics = {c: F.col(c).cast("double") for c in first.columns}
        runs.log_runs(runs.make_runs(first, F.lit(experiment), F.lit("PCA"), {"method": F.lit("PCA"), "n_components": F.lit(str(n_components)),
                                                                              "sample_size": F.lit(str(fit.n))}, metrics,
                                     started=started, artifacts=[f"{output}/pca_result"] if output else None), run_log)
    return scree, rd.pca_loadings(spark, fit, n_components), projection
