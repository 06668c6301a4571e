"""Catalogue part 3: cluster profiles, metrics, K-Means, DBSCAN, Ward, PCA, kNN."""

from __future__ import annotations

from pyspark.ml.clustering import BisectingKMeans, KMeansModel
from pyspark.sql import functions as F

from blotter.functions import fixed
from blotter.functions import temporal as tf
from blotter.operators import cluster as cl
from blotter.operators import explore as ex
from blotter.operators import features as fe
from blotter.operators import metrics as me
from blotter.operators import neighbours as nb
from blotter.operators import reduce as rd
from blotter.operators.dbscan import dbscan
from blotter.operators.ward import CELLS, ward, ward_tree
from blotter.plans import catalogue_quality as cq
from blotter.plans import sqlparts as sq
from blotter.plans import tables as T
from blotter.plans.registry import query
from blotter.session import materialize, scratch_dir
from blotter.sources import io

# --- C9 / A15-A18 ----------------------------------------------------------------


def _period_sql(expr):
    return (f"CASE WHEN {expr} < 6 THEN 'Late Night' WHEN {expr} < 12 THEN 'Morning' "
            f"WHEN {expr} < 17 THEN 'Afternoon' ELSE 'Evening' END")


@query("period_label", f"""
WITH m AS (SELECT event_type, round_even(avg(CAST(hour(ts) AS DOUBLE)), 2) AS mean_hour FROM events GROUP BY 1)
SELECT event_type, mean_hour, {_period_sql('mean_hour')} AS period FROM m""")
def period_label(spark, sf):
    ev = T.table(spark, sf, "events")
    m = ev.groupBy("event_type").agg(F.bround(F.avg(tf.hour_of("ts")), 2).alias("mean_hour"))
    return m.withColumn("period", tf.period_label("mean_hour"))


@query("temporal_cluster_profile", f"""
WITH {sq.INCIDENTS.strip()},
t AS (SELECT {sq.weekday('"Date"')} AS cluster, CAST(hour("Date") AS INTEGER) AS hour, "Primary Type" AS pt,
             "Arrest" AS arrest FROM incidents),
prof AS (SELECT cluster, count(pt) AS size, round_even(avg(CAST(arrest AS DOUBLE)) * 100.0, 2) AS "Arrest_rate",
                round_even(avg(CAST(hour AS DOUBLE)), 2) AS mean_hour FROM t GROUP BY cluster),
c AS (SELECT cluster, pt, count(*) AS n FROM t WHERE cluster IS NOT NULL AND pt IS NOT NULL GROUP BY ALL),
d AS (SELECT cluster, pt AS dominant_type FROM
       (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, pt) AS rn FROM c) WHERE rn = 1)
SELECT prof.cluster, size, "Arrest_rate", mean_hour, d.dominant_type, {_period_sql('mean_hour')} AS period
FROM prof LEFT JOIN d ON prof.cluster = d.cluster""")
def temporal_cluster_profile(spark, sf):
    inc = T.incidents(spark, sf).withColumn("cluster", tf.day_number("Date")).withColumn("hour", tf.hour_of("Date"))
    return ex.group_profile(inc, "cluster", "Primary Type", "Arrest", hour="hour")


@query("cluster_hour_counts", f"""
SELECT {sq.weekday('ts')} AS cluster, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS count
FROM events GROUP BY 1, 2 ORDER BY 1, 2""")
def cluster_hour_counts(spark, sf):
    ev = T.table(spark, sf, "events")
    return ex.cluster_hour_counts(ev, tf.day_number("ts"), tf.hour_of("ts"))


@query("geo_cluster_profile", """
WITH t AS (SELECT l_linenumber AS cluster, l_returnflag AS rf, (l_linestatus = 'F') AS flag, l_quantity FROM lineitem),
prof AS (SELECT cluster, count(rf) AS size, round_even(avg(CAST(flag AS DOUBLE)) * 100.0, 2) AS flag_rate,
                round_even(avg(l_quantity), 2) AS mean_l_quantity FROM t GROUP BY cluster),
c AS (SELECT cluster, rf, count(*) AS n FROM t WHERE cluster IS NOT NULL AND rf IS NOT NULL GROUP BY ALL),
d AS (SELECT cluster, rf AS dominant_type FROM
       (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, rf) AS rn FROM c) WHERE rn = 1)
SELECT prof.cluster, size, flag_rate, mean_l_quantity, d.dominant_type
FROM prof LEFT JOIN d ON prof.cluster = d.cluster""")
def geo_cluster_profile(spark, sf):
    li = T.table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("cluster"), "l_returnflag", (F.col("l_linestatus") == "F").alias("flag"),
        "l_quantity")
    return ex.group_profile(li, "cluster", "l_returnflag", "flag", score="l_quantity")


@query("cluster_sizes", """
WITH c AS (SELECT CAST(label AS INTEGER) AS cluster, count(*) AS size FROM embeddings GROUP BY 1)
SELECT cluster, size, round_even(CAST(size AS DOUBLE) * 100.0 / CAST(sum(size) OVER () AS DOUBLE), 4) AS pct
FROM c ORDER BY cluster""")
def cluster_sizes(spark, sf):
    return me.cluster_sizes(T.table(spark, sf, "embeddings"), "label")


# --- K7-K11 / A20 on embeddings with a given labelling --------------------------------

_LABELLINGS = {
    "given": ("label", "CAST(label AS BIGINT)"),
    "coarse": ("coarse", "CAST(label // 2 AS BIGINT)"),
    "noisy": ("noisy", "CAST(CASE WHEN vec_id % 7 = 0 THEN -1 ELSE label END AS BIGINT)"),
    "sign2d": ("sign2d", "CAST(2 * CAST(embedding[1] > 0 AS INTEGER) + CAST(embedding[2] > 0 AS INTEGER) AS BIGINT)"),
}


def _labelled(spark, sf):
    emb = T.embedding_vectors(spark, sf)
    return (emb.withColumn("noisy", F.when(F.col("vec_id") % 7 == 0, F.lit(-1)).otherwise(F.col("label")).cast("long"))
            .withColumn("coarse", F.floor(F.col("label") / 2).cast("long"))
            .withColumn("sign2d", (2 * (F.col("features")[0] > 0).cast("int")
                                   + (F.col("features")[1] > 0).cast("int")).cast("long")))


def _points_sql(label_expr):
    return f"""p AS (SELECT vec_id AS id, {label_expr} AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
q AS (SELECT * FROM p WHERE label <> -1)"""


_SIL_SQL = """s AS (SELECT * FROM q ORDER BY md5(CAST(id AS VARCHAR) || ':42'), id LIMIT 3000),
cs AS (SELECT label, count(*) AS n FROM s GROUP BY label),
pr AS (SELECT a.id, a.label AS la, b.label AS lb, sum(list_distance(a.v, b.v)) AS sd
       FROM s a JOIN s b ON a.id <> b.id GROUP BY ALL),
per AS (SELECT pr.id, max(CASE WHEN lb = la THEN sd / (cs.n - 1) END) AS a,
               min(CASE WHEN lb <> la THEN sd / cs.n END) AS b FROM pr JOIN cs ON cs.label = pr.lb GROUP BY pr.id),
sc AS (SELECT s.id, CASE WHEN cs.n <= 1 OR per.b IS NULL OR greatest(per.a, per.b) = 0 THEN 0.0
                         ELSE (per.b - per.a) / greatest(per.a, per.b) END AS si
       FROM s JOIN cs ON s.label = cs.label LEFT JOIN per ON per.id = s.id),
sil AS (SELECT avg(si) AS silhouette FROM sc)"""

_CENT_SQL = """u AS (SELECT id, label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM q),
c AS (SELECT label, i, avg(x) AS cx FROM u GROUP BY ALL),
dd AS (SELECT u.id, u.label, sum((u.x - c.cx) * (u.x - c.cx)) AS d2 FROM u JOIN c ON u.label = c.label AND u.i = c.i
       GROUP BY ALL),
sd AS (SELECT label, avg(sqrt(d2)) AS s FROM dd GROUP BY label),
cd AS (SELECT c1.label AS l1, c2.label AS l2, sqrt(sum((c1.cx - c2.cx) * (c1.cx - c2.cx))) AS d
       FROM c c1 JOIN c c2 ON c1.i = c2.i AND c1.label <> c2.label GROUP BY ALL),
rr AS (SELECT cd.l1, max((s1.s + s2.s) / cd.d) AS r FROM cd JOIN sd s1 ON s1.label = cd.l1
       JOIN sd s2 ON s2.label = cd.l2 GROUP BY cd.l1),
db AS (SELECT avg(r) AS davies_bouldin FROM rr),
g AS (SELECT i, avg(x) AS gx FROM u GROUP BY i),
nn AS (SELECT label, count(*) AS n FROM q GROUP BY label),
bt AS (SELECT sum(nn.n * z.ss) AS b FROM nn JOIN (SELECT c.label, sum((c.cx - g.gx) * (c.cx - g.gx)) AS ss
                                                  FROM c JOIN g ON c.i = g.i GROUP BY c.label) z ON z.label = nn.label),
wt AS (SELECT sum(d2) AS w FROM dd),
kk AS (SELECT count(*) AS n, count(DISTINCT label) AS k FROM q),
ch AS (SELECT bt.b * (kk.n - kk.k) / (wt.w * (kk.k - 1)) AS calinski_harabasz FROM bt, wt, kk)"""


def _eval_sql(name):
    label_expr = _LABELLINGS[name][1]
    return f"""(WITH {_points_sql(label_expr)}, {_SIL_SQL}, {_CENT_SQL}
SELECT '{name}' AS algorithm, CAST(kk.k AS INTEGER) AS n_clusters, round_even(sil.silhouette, 6) AS silhouette,
       round_even(db.davies_bouldin, 6) AS davies_bouldin, round_even(ch.calinski_harabasz, 6) AS calinski_harabasz,
       round_even((SELECT CAST(count(*) FILTER (WHERE label = -1) AS DOUBLE) * 100.0 / count(*) FROM p), 6)
         AS noise_pct, (SELECT count(*) FROM s) AS silhouette_rows
FROM sil, db, ch, kk)"""


@query("silhouette_exact", f"""
WITH {_points_sql('CAST(label AS BIGINT)')}, {_SIL_SQL}
SELECT round_even(silhouette, 6) AS silhouette FROM sil""")
def silhouette_exact(spark, sf):
    s = me.silhouette(T.embedding_vectors(spark, sf), "vec_id", "features", "label")
    return spark.createDataFrame([(s,)], "silhouette double")


@query("silhouette_rows", f"""
WITH s AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT a.id, a.label, b.label AS other, sum(list_distance(a.v, b.v)) AS d, count(*) FILTER (a.id <> b.id) AS n FROM s a, s b GROUP BY 1, 2, 3),
m AS (SELECT id, label, coalesce(max(CASE WHEN other = label AND n > 0 THEN d / n END), 0) AS a, min(CASE WHEN other <> label THEN d / n END) AS b,
             max(CASE WHEN other = label THEN n END) AS mates FROM d GROUP BY 1, 2)
SELECT id, CAST(label AS BIGINT) AS label, round_even(a, 6) AS a, round_even(b, 6) AS b,
       round_even(CASE WHEN mates = 0 THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM m""")
def silhouette_rows(spark, sf):
    """Euclidean silhouette of every row, no sample (K7)."""
    got = me.silhouette_rows(T.embedding_vectors(spark, sf), "vec_id", "features", "label")
    return got.select("id", "label", *[F.bround(c, 6).alias(c) for c in ("a", "b", "silhouette")])


@query("silhouette_all_rows", f"""
WITH {_points_sql(_LABELLINGS['noisy'][1])},
n AS (SELECT label, count(*) AS n FROM q GROUP BY label),
pr AS (SELECT a.id, a.label AS la, b.label AS lb, sum(list_distance(a.v, b.v) * list_distance(a.v, b.v)) AS sd
       FROM q a JOIN q b ON a.id <> b.id GROUP BY ALL),
per AS (SELECT pr.id, max(CASE WHEN lb = la THEN sd / (n.n - 1) END) AS a, min(CASE WHEN lb <> la THEN sd / n.n END) AS b
        FROM pr JOIN n ON n.label = pr.lb GROUP BY pr.id)
SELECT round_even(avg((b - a) / greatest(a, b)), 6) AS silhouette, count(*) AS rows FROM per""")
def silhouette_all_rows(spark, sf):
    """Silhouette of squared distances over every row that is no noise, linear in the rows (K7, P10)."""
    return me.silhouette_all_rows(_labelled(spark, sf), "features", "noisy").withColumn("silhouette", F.bround("silhouette", 6))


@query("davies_bouldin", f"""
WITH {_points_sql('CAST(label AS BIGINT)')}, {_CENT_SQL}
SELECT round_even(davies_bouldin, 6) AS davies_bouldin FROM db""")
def davies_bouldin(spark, sf):
    rows, _ = me.centroid_pass(T.embedding_vectors(spark, sf), "vec_id", "features", "label")
    return spark.createDataFrame([(round(me.davies_bouldin_from(rows), 6),)], "davies_bouldin double")


@query("calinski_harabasz", f"""
WITH {_points_sql('CAST(label AS BIGINT)')}, {_CENT_SQL}
SELECT round_even(calinski_harabasz, 6) AS calinski_harabasz FROM ch""")
def calinski_harabasz(spark, sf):
    rows, grand = me.centroid_pass(T.embedding_vectors(spark, sf), "vec_id", "features", "label")
    return spark.createDataFrame([(round(me.calinski_harabasz_from(rows, grand), 6),)], "calinski_harabasz double")


@query("cluster_evaluate", "SELECT * FROM " + _eval_sql("given"))
def cluster_evaluate(spark, sf):
    return me.evaluate(T.embedding_vectors(spark, sf), "vec_id", "features", "label", "given")


def _compare(spark, sf):
    lab = materialize(_labelled(spark, sf), "labelled")
    frames = [me.evaluate(lab, "vec_id", "features", col, name) for name, (col, _) in _LABELLINGS.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@query("algorithm_compare", "\nUNION ALL\n".join(f"SELECT * FROM {_eval_sql(n)}" for n in _LABELLINGS))
def algorithm_compare(spark, sf):
    return _compare(spark, sf)


@query("best_candidate", "SELECT * FROM (" + "\nUNION ALL\n".join(
    f"SELECT * FROM {_eval_sql(n)}" for n in _LABELLINGS) + ") ORDER BY silhouette DESC, algorithm LIMIT 1")
def best_candidate(spark, sf):
    return me.best_candidate(_compare(spark, sf), "silhouette", "algorithm")


# --- K5: DBSCAN on the min-max scaled embedding plane ------------------------------------


def _dbscan_sql(eps, min_samples):
    e2 = f"(CAST({eps} AS DOUBLE) * CAST({eps} AS DOUBLE))"
    return f"""
WITH RECURSIVE pl AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y
                      FROM embeddings),
st AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pl),
p AS (SELECT vec_id AS id, (x - x0) / (x1 - x0) AS x, (y - y0) / (y1 - y0) AS y FROM pl, st),
nb AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b
       ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {e2}),
core AS (SELECT a AS id FROM nb GROUP BY a HAVING count(*) >= {min_samples}),
ce AS (SELECT nb.a, nb.b FROM nb JOIN core c1 ON nb.a = c1.id JOIN core c2 ON nb.b = c2.id),
reach(src, dst) AS (SELECT id, id FROM core UNION SELECT r.src, ce.b FROM reach r JOIN ce ON r.dst = ce.a),
comp AS (SELECT dst AS id, min(src) AS root FROM reach GROUP BY dst),
num AS (SELECT root, dense_rank() OVER (ORDER BY root) - 1 AS cl FROM (SELECT DISTINCT root FROM comp)),
corel AS (SELECT comp.id, num.cl FROM comp JOIN num ON comp.root = num.root),
border AS (SELECT nb.a AS id, min(corel.cl) AS cl FROM nb JOIN corel ON nb.b = corel.id
           WHERE nb.a NOT IN (SELECT id FROM core) GROUP BY nb.a)
SELECT p.id AS vec_id, CAST(COALESCE(corel.cl, border.cl, -1) AS INTEGER) AS cluster
FROM p LEFT JOIN corel ON p.id = corel.id LEFT JOIN border ON p.id = border.id"""


def _scaled_plane(spark, sf):
    plane = T.embedding_plane(spark, sf)
    return fe.minmax_scale(plane, {"x": "x_scaled", "y": "y_scaled"})


@query("dbscan_geo", _dbscan_sql(fixed.DBSCAN_EPS, fixed.DBSCAN_MIN_SAMPLES))
def dbscan_geo(spark, sf):
    return dbscan(_scaled_plane(spark, sf), "vec_id", "x_scaled", "y_scaled",
                  fixed.DBSCAN_EPS, fixed.DBSCAN_MIN_SAMPLES)


@query("dbscan_geo_wide", _dbscan_sql(0.1, 10))
def dbscan_geo_wide(spark, sf):
    return dbscan(_scaled_plane(spark, sf), "vec_id", "x_scaled", "y_scaled", 0.1, 10)


# --- R5: exact kNN graph ------------------------------------------------------------------


@query("knn_graph", f"""
WITH s AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT a.id AS src, b.id AS dst, list_distance(a.v, b.v) AS distance FROM s a JOIN s b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS rank FROM d)
SELECT src, dst, round_even(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM r
WHERE rank <= {fixed.KNN_NEIGHBOURS}""")
def knn_graph(spark, sf):
    g = rd.knn_graph(T.embedding_vectors(spark, sf), "vec_id", "features", fixed.KNN_NEIGHBOURS)
    return g.withColumn("distance", F.bround("distance", 6))


@query("knn_graph_descent")
def knn_graph_descent(spark, sf):
    """The approximate form of ``knn_graph`` for many rows; which neighbours it misses is not SQL."""
    g = nb.knn_graph_descent(T.embedding_vectors(spark, sf), "vec_id", "features", fixed.KNN_NEIGHBOURS)
    return g.withColumn("distance", F.bround("distance", 6))


# --- K1-K4, K6, S10 (rows-only checks: seeds differ from any SQL formulation) --------------


def _plane_vectors(spark, sf):
    return cl.as_vectors(_scaled_plane(spark, sf), "vec_id", ["x_scaled", "y_scaled"])


@query("kmeans_geo")
def kmeans_geo(spark, sf):
    vec = _plane_vectors(spark, sf)
    centres, _ = cl.fit_best(vec, 4, n_init=10)
    labels = cl.kmeans_labels(vec, centres)
    return me.evaluate(labels, "id", "v", "cluster", "KMeans")


@query("kmeans_geo_sweep")
def kmeans_geo_sweep(spark, sf):
    table, _ = cl.kmeans_sweep(_plane_vectors(spark, sf), list(range(2, 11)), n_init=10)
    return table


def _temporal_vectors(spark, sf):
    from blotter.operators import prepare
    inc = T.incidents(spark, sf).select("ID", "Date")
    t = fe.encode_temporal(prepare.add_temporal_features(inc, "Date", parse_text=False))
    cols = {"Hour": "h", "DayOfWeek_Num": "d", "Month": "m", "Season_Num": "s", "Is_Weekend_Num": "w"}
    z = fe.standard_scale(t, cols)
    return cl.as_vectors(z, "ID", list(cols.values()))


@query("kmeans_temporal_sweep")
def kmeans_temporal_sweep(spark, sf):
    table, _ = cl.kmeans_sweep(_temporal_vectors(spark, sf), list(range(3, 7)), n_init=10)
    return table


@query("model_roundtrip")
def model_roundtrip(spark, sf):
    vec = _plane_vectors(spark, sf)
    model = cl.fit_spark_model(vec, 4)
    path = scratch_dir(spark, "model")
    io.save_model(model, path)
    back = KMeansModel.load(path)
    return back.transform(vec).groupBy(F.col("cluster").alias("cluster")).agg(F.count("*").alias("size"))


_WARD_BINS, _WARD_K = 12, 4


def _ward_sql(cells: str, k: int = _WARD_K, result: str | None = None) -> str:
    """The cheapest pair of clusters merges until k are left; ``cells`` groups the rows p into the first clusters c."""
    result = result or """,
l AS (SELECT cell, cid FROM w WHERE step = (SELECT max(step) FROM w)),
num AS (SELECT cid, dense_rank() OVER (ORDER BY cid) - 1 AS cluster FROM (SELECT DISTINCT cid FROM l))
SELECT c.vec_id, CAST(num.cluster AS INTEGER) AS cluster
FROM c JOIN g ON g.cx = c.cx AND g.cy = c.cy JOIN l ON l.cell = g.cell JOIN num ON num.cid = l.cid"""
    return f"""
WITH RECURSIVE pl AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
st AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pl),
p AS (SELECT vec_id, (x - x0) / (x1 - x0) AS x, (y - y0) / (y1 - y0) AS y FROM pl, st),
{cells},
g AS (SELECT cx, cy, row_number() OVER (ORDER BY min(vec_id)) AS cell, count(*)::DOUBLE AS n, avg(x) AS x, avg(y) AS y FROM c GROUP BY cx, cy),
w(step, cell, cid, n, x, y) AS (
  SELECT 0, cell, cell, n, x, y FROM g
  UNION ALL
  SELECT w.step + 1, w.cell, CASE WHEN w.cid = m.b THEN m.a ELSE w.cid END,
         CASE WHEN w.cid IN (m.a, m.b) THEN m.n ELSE w.n END, CASE WHEN w.cid IN (m.a, m.b) THEN m.x ELSE w.x END,
         CASE WHEN w.cid IN (m.a, m.b) THEN m.y ELSE w.y END
  FROM w, (SELECT a.cid AS a, b.cid AS b, a.n + b.n AS n, (a.n * a.x + b.n * b.x) / (a.n + b.n) AS x, (a.n * a.y + b.n * b.y) / (a.n + b.n) AS y
           FROM (SELECT DISTINCT cid, n, x, y FROM w) a JOIN (SELECT DISTINCT cid, n, x, y FROM w) b ON a.cid < b.cid
           ORDER BY a.n * b.n / (a.n + b.n) * ((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), a.cid, b.cid LIMIT 1) m
  WHERE (SELECT count(DISTINCT cid) FROM w) > {k}){result}"""


_ROWS = "c AS (SELECT *, x AS cx, y AS cy FROM p)"


@query("ward_zones", _ward_sql(_ROWS))
def ward_zones(spark, sf):
    """Ward on the rows themselves."""
    return ward(_scaled_plane(spark, sf), "vec_id", "x_scaled", "y_scaled", _WARD_K)


@query("ward_merges", _ward_sql(_ROWS, 1, """,
v AS (SELECT DISTINCT step, cid, n, x, y FROM w),
m AS (SELECT DISTINCT o.step, o.cid AS b, k.cid AS a FROM w o JOIN w k ON k.step = o.step + 1 AND k.cell = o.cell WHERE k.cid <> o.cid),
name AS (SELECT g.cell, min(c.vec_id) AS id FROM g JOIN c ON c.cx = g.cx AND c.cy = g.cy GROUP BY g.cell)
SELECT nb.id AS absorbed, na.id AS survivor,
       round_even(va.n * vb.n / (va.n + vb.n) * ((va.x - vb.x) * (va.x - vb.x) + (va.y - vb.y) * (va.y - vb.y)), 9) AS cost, CAST(va.n + vb.n AS BIGINT) AS size
FROM m JOIN v va ON va.step = m.step AND va.cid = m.a JOIN v vb ON vb.step = m.step AND vb.cid = m.b
JOIN name na ON na.cell = m.a JOIN name nb ON nb.cell = m.b"""))
def ward_merges(spark, sf):
    """The dendrogram behind ``ward_zones``: a row per merge."""
    return ward_tree(_scaled_plane(spark, sf), "vec_id", "x_scaled", "y_scaled").select(
        "absorbed", "survivor", F.bround("cost", 9).alias("cost"), F.col("size").cast("long").alias("size"))


@query("ward_zones_adaptive")
def ward_zones_adaptive(spark, sf):
    """Rows summed up in adaptive cells first."""
    return ward(_scaled_plane(spark, sf), "vec_id", "x_scaled", "y_scaled", _WARD_K, cells=CELLS)


@query("ward_zones_grid", _ward_sql(
    f"c AS (SELECT *, least(floor(x * {_WARD_BINS}), {_WARD_BINS - 1}) AS cx, least(floor(y * {_WARD_BINS}), {_WARD_BINS - 1}) AS cy FROM p)"))
def ward_zones_grid(spark, sf):
    """Rows summed up in a fixed grid first."""
    return ward(_scaled_plane(spark, sf), "vec_id", "x_scaled", "y_scaled", _WARD_K, _WARD_BINS)


@query("kmeans_fixed_start", """
WITH RECURSIVE pl AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
st AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pl),
p AS (SELECT vec_id, (x - x0) / (x1 - x0) AS x, (y - y0) / (y1 - y0) AS y FROM pl, st),
c(it, j, x, y) AS (
  SELECT 0, row_number() OVER (ORDER BY vec_id) - 1, x, y FROM (SELECT * FROM p ORDER BY vec_id LIMIT 4)
  UNION ALL
  SELECT it + 1, j, avg(x), avg(y) FROM (
    SELECT c.it, p.x, p.y, c.j, row_number() OVER (PARTITION BY p.vec_id ORDER BY (p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y), c.j) AS r
    FROM p, c WHERE c.it < 8) WHERE r = 1 GROUP BY it, j),
last AS (SELECT * FROM c WHERE it = 8),
l AS (SELECT p.vec_id, last.j, row_number() OVER (PARTITION BY p.vec_id
        ORDER BY (p.x - last.x) * (p.x - last.x) + (p.y - last.y) * (p.y - last.y), last.j) AS r FROM p, last)
SELECT vec_id, j AS cluster FROM l WHERE r = 1""")
def kmeans_fixed_start(spark, sf):
    """Eight Lloyd iterations from the first four rows (K1): deterministic, so SQL can follow it."""
    vec = _plane_vectors(spark, sf).select("id", "v")
    start = [r["v"] for r in vec.orderBy("id").limit(4).collect()]
    return cl.assign(vec, cl.lloyd(vec, start, 8)).select(F.col("id").alias("vec_id"), "cluster")


def _farthest_fit_sql(ks: range, iterations: int, rows: int | None = None) -> str:
    """CTEs: pts(id, x, y) on the unit square, fin(k, j, x, y) centres of K-Means from farthest-first starts, lab(k, id, j, x, y, d2)."""
    pick = f" ORDER BY md5(CAST(id AS VARCHAR) || ':42'), id LIMIT {rows}" if rows else ""
    d2 = "(p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y)"
    near = f"row_number() OVER (PARTITION BY c.k, p.id ORDER BY {d2}, c.j) AS r"
    return f"""pl AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
st AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pl),
pts AS (SELECT * FROM (SELECT vec_id AS id, (x - x0) / (x1 - x0) AS x, (y - y0) / (y1 - y0) AS y FROM pl, st){pick}),
starts(n, xs, ys) AS (
  SELECT 1, [x], [y] FROM (SELECT * FROM pts ORDER BY id LIMIT 1)
  UNION ALL
  SELECT n + 1, list_append(xs, x), list_append(ys, y) FROM (
    SELECT s.*, p.x, p.y, row_number() OVER (ORDER BY list_min(list_transform(range(1, s.n + 1),
             lambda i: (p.x - s.xs[i]) * (p.x - s.xs[i]) + (p.y - s.ys[i]) * (p.y - s.ys[i]))) DESC, p.id) AS r
    FROM starts s, pts p WHERE s.n < {max(ks)}) WHERE r = 1),
lloyd(it, k, j, x, y) AS (
  SELECT 0, k, j - 1, xs[j], ys[j] FROM starts, range({min(ks)}, {max(ks)} + 1) a(k), range(1, {max(ks)} + 1) b(j) WHERE n = {max(ks)} AND j <= k
  UNION ALL
  SELECT it + 1, k, j, avg(x), avg(y) FROM (
    SELECT c.it, c.k, c.j, p.x, p.y, {near} FROM pts p, lloyd c WHERE c.it < {iterations}) WHERE r = 1 GROUP BY it, k, j),
fin AS (SELECT k, j, x, y FROM lloyd WHERE it = {iterations}),
lab AS (SELECT * FROM (SELECT c.k, p.id, c.j, p.x, p.y, {d2} AS d2, {near} FROM pts p, fin c) WHERE r = 1)"""


@query("kmeans_sweep_farthest", f"""
WITH RECURSIVE {_farthest_fit_sql(range(2, 11), 25)},
s AS (SELECT lab.* FROM lab JOIN (SELECT id FROM pts ORDER BY md5(CAST(id AS VARCHAR) || ':42'), id LIMIT 3000) USING (id)),
n AS (SELECT k, j, count(*) AS n FROM s GROUP BY ALL),
pr AS (SELECT a.k, a.id, a.j, b.j AS other, sum(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS d
       FROM s a JOIN s b ON a.k = b.k AND a.id <> b.id GROUP BY ALL),
ab AS (SELECT pr.k, id, max(CASE WHEN other = pr.j THEN d / (n - 1) END) AS a, min(CASE WHEN other <> pr.j THEN d / n END) AS b
       FROM pr JOIN n ON n.k = pr.k AND n.j = pr.other GROUP BY ALL),
sil AS (SELECT k, avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM ab GROUP BY k),
inn AS (SELECT k, sum(d2) AS inertia FROM lab GROUP BY k)
SELECT CAST(k AS INTEGER) AS k, round_even(inertia, 6) AS inertia, round_even(silhouette, 6) AS silhouette FROM inn JOIN sil USING (k)""")
def kmeans_sweep_farthest(spark, sf):
    """The sweep of k with farthest-first starts and at most 25 iterations (K2): no chance in it, so SQL can follow it."""
    table, _ = cl.kmeans_sweep(_plane_vectors(spark, sf), list(range(2, 11)), max_iter=25, tol=0.0, seeding="farthest")
    return table.select("k", F.bround("inertia", 6).alias("inertia"), F.bround("silhouette", 6).alias("silhouette"))


@query("kmeans_positions_farthest", f"""
WITH RECURSIVE {_farthest_fit_sql(range(5, 6), 25, 5_000)},
p AS (SELECT id, j AS label, [x, y] AS v FROM lab),
q AS (SELECT * FROM p),
{_SIL_SQL.replace("LIMIT 3000", "LIMIT 2000")}, {_CENT_SQL}
SELECT 'KMeans_k5' AS algorithm, CAST(kk.k AS INTEGER) AS n_clusters, round_even(sil.silhouette, 6) AS silhouette,
       round_even(db.davies_bouldin, 6) AS davies_bouldin, round_even(ch.calinski_harabasz, 6) AS calinski_harabasz,
       CAST(0 AS DOUBLE) AS noise_pct, (SELECT count(*) FROM s) AS silhouette_rows
FROM sil, db, ch, kk""")
def kmeans_positions_farthest(spark, sf):
    """K4 with farthest-first starts: a seeded sample of rows, fit, evaluation."""
    return cl.cluster_positions(_plane_vectors(spark, sf), k=5, n=5_000, silhouette_n=2_000, max_iter=25, tol=0.0, seeding="farthest")


@query("hierarchical_zones")
def hierarchical_zones(spark, sf):
    vec = _plane_vectors(spark, sf)
    model = BisectingKMeans(k=4, seed=fixed.RANDOM_STATE, featuresCol="features", predictionCol="cluster").fit(vec)
    return model.transform(vec).select(F.col("id").alias("vec_id"), F.col("cluster").cast("int"))


# --- R1-R4 ----------------------------------------------------------------------------------

#: Embedding rows, and rows of the stage-3 feature matrix, as x(id, v).
_EMBEDDING_X = "x AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_FEATURE_X = "feats AS (" + cq.feature_matrix_sql().strip() + "),\nx AS (SELECT row_key AS id, [" + ", ".join(
    f'CAST("{c}" AS DOUBLE)' for c in fe.FEATURE_COLS) + "] AS v FROM feats)"


def _pca_sql(x: str, k: int, out: str) -> str:
    return f"WITH RECURSIVE {x},{sq.principal_components(k)}\n{out}"


_SCREE_SQL = """, s AS (SELECT CAST(k AS INTEGER) AS component, lam / total AS ratio, sum(lam / total) OVER (ORDER BY k) AS cum FROM eig)
SELECT component, round_even(ratio, 6) AS variance_ratio, round_even(cum, 6) AS cumulative,
       min(CASE WHEN cum >= 0.7 THEN component END) OVER () AS n70, min(CASE WHEN cum >= 0.8 THEN component END) OVER () AS n80
FROM s"""
_LOADINGS_SQL = "SELECT name AS feature, " + ", ".join(
    f"round_even((SELECT v FROM eig WHERE k = {j})[pos], 6) AS \"PC{j}\"" for j in (1, 2, 3)) + f"""
FROM (SELECT unnest({fe.FEATURE_COLS}) AS name, unnest(range(1, {len(fe.FEATURE_COLS)} + 1)) AS pos)"""
_TOP_LOADINGS_SQL = f""", l AS ({_LOADINGS_SQL}),
t AS (SELECT feature, unnest(['PC1', 'PC2', 'PC3']) AS component, unnest(["PC1", "PC2", "PC3"]) AS loading FROM l)
SELECT feature, component, loading, abs(loading) AS abs_loading,
       CAST(row_number() OVER (PARTITION BY component ORDER BY abs(loading) DESC, feature) AS INTEGER) AS rank
FROM t QUALIFY rank <= 5"""


def _scores_sql(k: int) -> str:
    return ", ".join(f"round_even(list_dot_product(z.z, (SELECT v FROM eig WHERE k = {j})), 6) AS \"PC{j}\"" for j in range(1, k + 1))


def _rounded(df, k: int):
    return df.withColumns({f"PC{j}": F.bround(f"PC{j}", 6) for j in range(1, k + 1)})


def _incident_pca(spark, sf, k=None):
    from blotter.plans.catalogue_quality import engineered_incidents
    X, meta = fe.feature_matrix(engineered_incidents(spark, sf))
    return rd.PcaFit(X, fe.FEATURE_COLS, k=k), X, meta


@query("pca_scree", _pca_sql(_FEATURE_X, len(fe.FEATURE_COLS), _SCREE_SQL))
def pca_scree(spark, sf):
    fit, _, _ = _incident_pca(spark, sf)
    return rd.pca_scree(spark, fit)


@query("pca_scree_embeddings", _pca_sql(_EMBEDDING_X, 64, _SCREE_SQL))
def pca_scree_embeddings(spark, sf):
    fit = rd.PcaFit(T.embedding_vectors(spark, sf), array_col="features")
    return rd.pca_scree(spark, fit)


@query("embedding_correlation", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT vec_id, unnest(range(0, len(v))) AS i, unnest(v) AS x FROM e)
SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round_even(corr(a.x, b.x), 6) AS corr
FROM u a JOIN u b ON a.vec_id = b.vec_id GROUP BY a.i, b.i""")
def embedding_correlation(spark, sf):
    """The matrix whose eigenvectors are the principal components."""
    return rd.correlation_table(spark, rd.PcaFit(T.embedding_vectors(spark, sf), array_col="features"))


@query("pca_loadings", _pca_sql(_FEATURE_X, 3, _LOADINGS_SQL))
def pca_loadings(spark, sf):
    fit, _, _ = _incident_pca(spark, sf)
    return rd.pca_loadings(spark, fit, 3)


@query("pca_top_loadings", _pca_sql(_FEATURE_X, 3, _TOP_LOADINGS_SQL))
def pca_top_loadings(spark, sf):
    fit, _, _ = _incident_pca(spark, sf)
    return rd.pca_top_loadings(rd.pca_loadings(spark, fit, 3), 5)


@query("pca_project", _pca_sql(_FEATURE_X, 3, f"""SELECT z.id AS row_key, upper(e.event_type) AS "Primary_Type",
       {sq.severity_case('upper(e.event_type)')} AS "Crime_Severity_Score", {sq.season_case('month(e.ts)')} AS "Season", {_scores_sql(3)}
FROM z JOIN events e ON CAST(e.event_id AS VARCHAR) = z.id"""))
def pca_project(spark, sf):
    from blotter.plans.catalogue_quality import engineered_incidents
    eng = engineered_incidents(spark, sf)
    wide = fe.feature_rows(eng).withColumn("Primary_Type", F.col("Primary Type"))
    fit = rd.PcaFit(wide, fe.FEATURE_COLS, k=3)
    return _rounded(fit.project(["row_key", "Primary_Type", "Crime_Severity_Score", "Season"], "PC", 3), 3)


@query("geo_result_roundtrip", _dbscan_sql(0.1, 10).replace(
    "SELECT p.id AS vec_id, CAST(COALESCE(corel.cl, border.cl, -1) AS INTEGER) AS cluster",
    ", lab AS (SELECT p.id AS vec_id, CAST(COALESCE(corel.cl, border.cl, -1) AS INTEGER) AS cluster") .replace(
    "FROM p LEFT JOIN corel ON p.id = corel.id LEFT JOIN border ON p.id = border.id",
    """FROM p LEFT JOIN corel ON p.id = corel.id LEFT JOIN border ON p.id = border.id)
SELECT l.cluster, count(*) AS size, CAST(min(e.label) AS INTEGER) AS min_label, CAST(max(e.label) AS INTEGER) AS max_label
FROM lab l JOIN embeddings e ON e.vec_id = l.vec_id GROUP BY l.cluster"""))
def geo_result_roundtrip(spark, sf):
    """Label table sink (S8, J5): cluster labels attached to the metadata,
    written partitioned by cluster, read back and profiled."""
    labels = dbscan(_scaled_plane(spark, sf), "vec_id", "x_scaled", "y_scaled", 0.1, 10)
    meta = T.table(spark, sf, "embeddings").select("vec_id", "label")
    path = scratch_dir(spark, "geo_result")
    io.write_table(meta.join(labels, "vec_id"), path, partition_by=["cluster"])
    back = io.read_table(spark, path)
    return back.groupBy("cluster").agg(F.count("*").alias("size"), F.min("label").alias("min_label"),
                                       F.max("label").alias("max_label"))


@query("kmeans_positions")
def kmeans_positions(spark, sf):
    """Parameterised K-Means of the page (K4): seeded sample of n rows, fit,
    silhouette on 2,000 rows and the Davies-Bouldin index."""
    vec = _plane_vectors(spark, sf)
    return cl.cluster_positions(vec, k=5, n=5_000, silhouette_n=2_000)


@query("pca_reduce10", _pca_sql(_EMBEDDING_X, 10, f"""SELECT e.vec_id, e.label, {_scores_sql(10)},
       round_even((SELECT sum(lam) / max(total) FROM eig), 6) AS retained_variance
FROM z JOIN embeddings e ON e.vec_id = z.id"""))
def pca_reduce10(spark, sf):
    """10-component pre-reduction with the variance it retains."""
    emb = T.embedding_vectors(spark, sf)
    fit = rd.PcaFit(emb, array_col="features", k=10)
    proj = fit.project(["vec_id", "label"], "PC", 10)
    path = scratch_dir(spark, "pca10")
    io.write_table(proj, path)
    retained = float(sum(fit.ratio))
    return _rounded(io.read_table(spark, path), 10).withColumn("retained_variance", F.lit(round(retained, 6)))


# --- whole clustering stage (K11 with S11 / S12) ---------------------------------------------


@query("geographic_clustering_stage")
def geographic_clustering_stage(spark, sf):
    from blotter.plans.stages import geographic_clustering
    from blotter.sources import runs as rn
    log = scratch_dir(spark, "runlog")
    comparison, _, _ = geographic_clustering(_scaled_plane(spark, sf), "vec_id", "x_scaled", "y_scaled",
                                             eps=0.1, min_samples=10, run_log=log)
    comparison.collect()
    return rn.flatten_runs(rn.read_runs(spark, log))


@query("geo_stage_outputs", """
SELECT 'geo_result' AS name, count(*) AS count, count(DISTINCT vec_id) AS ids FROM embeddings
UNION ALL SELECT 'row_ids', count(*), count(DISTINCT vec_id) FROM embeddings
UNION ALL SELECT 'best_model', CAST(1 AS BIGINT), CAST(0 AS BIGINT)""")
def geo_stage_outputs(spark, sf):
    """The stage's published tables, read back: every row labelled, every id kept, one model."""
    from blotter.plans.stages import geographic_clustering
    from blotter.sources import publish
    out = scratch_dir(spark, "geo-stage")
    geographic_clustering(_scaled_plane(spark, sf), "vec_id", "x_scaled", "y_scaled", ks=range(3, 6), n_init=2, eps=0.1, min_samples=10, output=out)
    parts = [publish.read_published(spark, out, t).agg(F.lit(t).alias("name"), F.count("*").alias("count"), ids.alias("ids"))
             for t, ids in (("geo_result", F.count_distinct(F.when(F.col("Geo_Cluster").isNotNull(), F.col("vec_id")))),
                            ("row_ids", F.count_distinct("vec_id")), ("best_model", F.lit(0).cast("long")))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("temporal_clustering_stage")
def temporal_clustering_stage(spark, sf):
    from blotter.operators import prepare
    from blotter.plans.stages import temporal_clustering
    inc = T.incidents(spark, sf)
    t = fe.encode_temporal(prepare.add_temporal_features(inc, "Date", parse_text=False))
    profile, _, _ = temporal_clustering(t, "ID", ["Hour", "DayOfWeek_Num", "Month", "Season_Num", "Is_Weekend_Num"],
                                        "Hour", "Primary Type", "Arrest")
    return profile


@query("reduction_stage")
def reduction_stage(spark, sf):
    """The reduction stage's run record, read back from its log."""
    from blotter.plans.catalogue_quality import engineered_incidents
    from blotter.plans.stages import dimension_reduction
    from blotter.sources import runs as rn
    log, out = scratch_dir(spark, "runlog"), scratch_dir(spark, "reduction")
    rows = fe.feature_rows(engineered_incidents(spark, sf))
    dimension_reduction(rows, fe.FEATURE_COLS, ["row_key", "Primary Type", "Season"], 3, log, output=out)
    return rn.flatten_runs(rn.read_runs(spark, log))


@query("temporal_cluster_hours")
def temporal_cluster_hours(spark, sf):
    """Rows per temporal cluster and hour, from the stage's written result."""
    from blotter.operators import prepare
    from blotter.plans.stages import temporal_clustering
    t = fe.encode_temporal(prepare.add_temporal_features(T.incidents(spark, sf), "Date", parse_text=False))
    out = scratch_dir(spark, "temporal")
    temporal_clustering(t, "ID", ["Hour", "DayOfWeek_Num", "Month", "Season_Num", "Is_Weekend_Num"], "Hour", "Primary Type", "Arrest", output=out)
    return io.read_table(spark, f"{out}/cluster_hours")
