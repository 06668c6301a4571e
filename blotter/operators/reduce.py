"""Dimensionality reduction and ranking helpers.

PCA of standardised inputs is the eigen-decomposition of their correlation
matrix: one distributed pass sums the outer products, only the features x
features problem runs on the driver, and projections are column expressions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blotter.functions import fixed
from blotter.operators.pairs import HELD, PASSING, block_rows, held_side, matrix, pair_distances, passing_side, slack, stream_groups
from blotter.operators.sampling import sample_exact
from blotter.session import materialize


def _c(c) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


# --- W1 / W3 -------------------------------------------------------------------


def cumulative_share(counts: DataFrame, key: str, value: str, thresholds=(0.7, 0.8),
                     decimals: int = 6) -> DataFrame:
    """Position by value (desc, key asc), share, cumulative share and the first
    position reaching each threshold (W1).

    Rows are sorted in ranges; each range counts and sums up for itself, and the ranges before it are added as one
    number per range.  No task sees more than a range.  NULL values come last, without a share; a total of 0 gives none.
    """
    asked = counts.select(_c(key).alias("key"), _c(value).cast("double").alias("value"), _c(value).alias("_order"))
    order = [F.desc("_order"), F.asc("key")]
    placed = materialize(asked.repartitionByRange(*order).sortWithinPartitions(*order)
                         .withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    ranges = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).orderBy("part").collect()
    total = sum(r["total"] or 0.0 for r in ranges)
    before, rows, seen = [], 0, 0.0
    for r in ranges:
        before.append((r["part"], rows, seen))
        rows, seen = rows + r["n"], seen + (r["total"] or 0.0) / total if total else 0.0
    offsets = F.map_from_entries(F.array(*[F.struct(F.lit(p), F.struct(F.lit(n).alias("n"), F.lit(s).alias("s"))) for p, n, s in before])) if before else None
    within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = placed.withColumn("_part", part).withColumn("share", F.col("value") / F.lit(total) if total else F.lit(None).cast("double"))
    start = F.element_at(offsets, F.col("_part")) if before else F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("s"))
    out = out.withColumn("_start", start)
    out = (out.withColumn("position", (F.col("_start.n") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).cast("int"))
           .withColumn("cum", F.coalesce(F.sum("share").over(within), F.lit(0.0)) + F.col("_start.s") if total else F.lit(None).cast("double")))
    firsts = out.agg(*[F.min(F.when(F.col("cum") >= t, F.col("position"))).alias(f"t{i}") for i, t in enumerate(thresholds)]).first() if thresholds else ()
    return out.select("position", F.col("key").alias(key), F.bround("share", decimals).alias("share"), F.bround("cum", decimals).alias("cum_share"),
                      *[F.lit(n).cast("int").alias(f"n{int(round(t * 100))}") for n, t in zip(firsts, thresholds, strict=True)]).orderBy("position")


def top_k_per_group(df: DataFrame, group: str, order: list, k: int, rank_col: str = "rank") -> DataFrame:
    """k first rows per group in the given order.

    ``row_number() <= k`` lets Catalyst insert a partial WindowGroupLimit
    before the shuffle, so every map task forwards at most k rows per group:
    a hot group is reduced before it is moved.
    """
    w = Window.partitionBy(_c(group)).orderBy(*[_c(o) if isinstance(o, str) else o for o in order])
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


# --- PCA --------------------------------------------------------------------------


def moments(df: DataFrame, array: Column, dim: int):
    """(n, mean, covariance) of a numeric array column, population form, in one pass over the rows.

    Every task sums its rows' outer products around a fixed row of the data (so large offsets do not cancel) and
    Spark adds the tasks' sums up; the driver sees one row of dim + dim^2 numbers.  A null array or element raises.
    """
    values = df.select(array.cast("array<double>").alias("v"))
    first = values.filter(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())).first()
    around = np.zeros(dim) if first is None else np.array(first["v"], float)

    def run(batches):
        n, bad, s, g = 0, 0, np.zeros(dim), np.zeros((dim, dim))
        for b in batches:
            col = b.column(0)
            flat = col.flatten()
            if col.null_count or flat.null_count:
                bad += col.null_count + flat.null_count
                continue
            x = np.asarray(flat).reshape(-1, dim) - around
            n += len(x)
            s += x.sum(axis=0)
            g += x.T @ x
        yield pa.RecordBatch.from_pydict({"n": [n], "bad": [bad], "s": [[*s.tolist(), *g.ravel().tolist()]]})

    rows = values.mapInArrow(run, "n long, bad long, s array<double>")
    total = rows.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"),
                     vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s")).first()
    if total["bad"]:
        raise ValueError(f"PCA input holds {total['bad']} nulls; drop or fill them first")
    n = total["n"] or 0
    if not n:
        return 0, np.zeros(dim), np.zeros((dim, dim))
    s = np.array(total["s"])
    shift = s[:dim] / n
    return n, around + shift, s[dim:].reshape(dim, dim) / n - np.outer(shift, shift)


def correlation(covariance: np.ndarray) -> np.ndarray:
    """Correlation matrix; a constant column correlates with nothing, itself included."""
    sd = np.sqrt(np.clip(np.diag(covariance), 0, None))
    scale = np.divide(1.0, sd, out=np.zeros_like(sd), where=sd > 0)
    return covariance * np.outer(scale, scale)


class PcaFit:
    """Fitted PCA on population-standardised inputs: the eigenvectors of the correlation matrix.

    One pass over the data; the eigen-problem (features x features) is the driver's.  Signs: the largest absolute
    loading of a component is positive.
    """

    def __init__(self, df: DataFrame, feature_cols: list[str] | None = None, array_col: str | None = None,
                 k: int | None = None):
        if array_col is not None:
            head = df.select(F.size(array_col).alias("d")).first()
            dim = head["d"] if head else 0
            self._array = F.col(array_col).cast("array<double>")
        else:
            dim = len(feature_cols)
            self._array = F.array(*[_c(c).cast("double") for c in feature_cols])
        self._df = df
        self.names = feature_cols if feature_cols else [f"f{i}" for i in range(dim)]
        self.n, self.mean, covariance = moments(df, self._array, dim)
        sd = np.sqrt(np.clip(np.diag(covariance), 0, None))
        self.scale = np.divide(1.0, sd, out=np.zeros_like(sd), where=sd > 0)
        self.correlation = correlation(covariance)
        values, vectors = np.linalg.eigh(self.correlation)
        order = np.argsort(-values, kind="stable")
        self.k = dim if k is None else k
        values, vectors = np.clip(values[order], 0, None), vectors[:, order][:, : self.k]
        signs = np.sign(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(vectors.shape[1])]) if dim else np.zeros(0)
        signs[signs == 0] = 1.0
        self.components = vectors * signs
        self.ratio = (values / values.sum() if values.sum() else values)[: self.k].tolist()

    def project(self, keep: list[str], prefix: str = "PC", n_components: int | None = None) -> DataFrame:
        """Scores as column expressions; every row and the kept columns stay."""
        m = self.k if n_components is None else n_components
        cols = []
        for j in range(m):
            weight = self.scale * self.components[:, j]
            terms = F.zip_with(self._array, F.array(*[F.lit(float(w)) for w in weight]), lambda x, w: x * w)
            cols.append((F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) - F.lit(float(self.mean @ weight))).alias(f"{prefix}{j + 1}"))
        return self._df.select(*[_c(c) for c in keep], *cols)


def correlation_table(spark, fit: PcaFit, decimals: int = 6) -> DataFrame:
    """(feature_i, feature_j, corr) of all pairs."""
    d = len(fit.names)
    rows = [(i, j, float(fit.correlation[i, j])) for i in range(d) for j in range(d)]
    return spark.createDataFrame(rows, "i int, j int, corr double").withColumn("corr", F.bround("corr", decimals))


def pca_scree(spark, fit: PcaFit, thresholds=(0.7, 0.8), decimals: int = 6) -> DataFrame:
    """Explained-variance ratio per component with cumulative share."""
    rows = [(j + 1, float(r)) for j, r in enumerate(fit.ratio)]
    df = spark.createDataFrame(rows, "component int, variance_ratio double")
    ordered = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    out = df.withColumn("cumulative", F.sum("variance_ratio").over(ordered))
    cols = ["component", F.bround("variance_ratio", decimals).alias("variance_ratio"),
            F.bround("cumulative", decimals).alias("cumulative")]
    for t in thresholds:
        cols.append(F.min(F.when(F.col("cumulative") >= t, F.col("component"))).over(whole)
                    .cast("int").alias(f"n{int(round(t * 100))}"))
    return out.select(*cols).orderBy("component")


def pca_loadings(spark, fit: PcaFit, n_components: int = 3, decimals: int = 6) -> DataFrame:
    """Feature x component loadings table (R3); sign rule applied."""
    m = min(n_components, fit.k)
    rows = [(name, *[float(round(fit.components[i, j], 12)) for j in range(m)])
            for i, name in enumerate(fit.names)]
    schema = "feature string, " + ", ".join(f"PC{j + 1} double" for j in range(m))
    df = spark.createDataFrame(rows, schema)
    return df.select("feature", *[F.bround(f"PC{j + 1}", decimals).alias(f"PC{j + 1}") for j in range(m)])


def pca_top_loadings(loadings: DataFrame, k: int = 5) -> DataFrame:
    """Top k features by absolute loading per component (W3 on R3)."""
    pcs = [c for c in loadings.columns if c.startswith("PC")]
    long = loadings.select("feature", F.explode(F.array(*[
        F.struct(F.lit(p).alias("component"), F.col(p).alias("loading")) for p in pcs])).alias("s")) \
        .select("feature", "s.component", "s.loading").withColumn("abs_loading", F.abs("loading"))
    return top_k_per_group(long, "component", [F.desc("abs_loading"), "feature"], k).orderBy("component", "rank")


# --- R5: exact k-nearest-neighbour graph --------------------------------------------


def _distances(q: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """Exact Euclidean distances q x ref, in memory-bounded blocks."""
    out = np.empty((len(q), len(ref)))
    rows = max(1, 4_000_000 // max(1, ref.size))
    for s in range(0, len(q), rows):
        diff = q[s:s + rows, None, :] - ref[None, :, :]
        out[s:s + rows] = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
    return out


class _Nearest:
    """The k nearest of all rows that pass by, for each row of a held block; ties go to the smaller id."""

    def __init__(self, k: int, centre: np.ndarray):
        self.k, self.centre, self.held, self.parts = k, centre, [], None

    def add(self, b: pa.RecordBatch) -> None:
        """Rows (role, id, v): those of role 0 are held and come first."""
        role, ids, v = (b.column(b.schema.get_field_index(c)) for c in ("role", "id", "v"))
        role, ids, v = np.asarray(role), np.asarray(ids), matrix(v)
        mine = role == 0
        if mine.any():
            self.held.append((ids[mine], v[mine]))
        if not mine.all() and self.parts is None:
            self.parts = self.split()
        ids, v = ids[~mine], v[~mine]
        for s in range(0, len(ids) if self.parts else 0, PASSING):
            near_ids, near = ids[s:s + PASSING], v[s:s + PASSING]
            right, norms = passing_side(near, self.centre)
            for p in self.parts:
                p.meet(near_ids, near, right, norms)

    def split(self) -> list[_HeldRows]:
        if not self.held:
            return []
        ids, v = (np.concatenate(x) for x in zip(*self.held, strict=True))
        return [_HeldRows(self.k, ids[s:s + HELD], v[s:s + HELD], self.centre) for s in range(0, len(ids), HELD)]

    def end(self) -> pa.Table:
        names = ["src", "dst", "distance", "rank"]
        parts = [p.merged() for p in self.parts or []] or [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32))]
        return pa.table(dict(zip(names, (np.concatenate(x) for x in zip(*parts, strict=True)), strict=True)))


class _HeldRows:
    """Up to HELD rows and what is nearest to them so far: flat (row, id, distance), sorted, and hits not merged yet."""

    def __init__(self, k: int, ids: np.ndarray, v: np.ndarray, centre: np.ndarray):
        self.k, self.ids, self.v = k, ids, v
        self.left, self.norms = held_side(v, centre)
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        self.waiting = 0
        self.worst, self.worst_id = np.full(len(ids), np.inf), np.zeros(len(ids), np.int64)

    def meet(self, ids: np.ndarray, v: np.ndarray, right: np.ndarray, norms: np.ndarray) -> None:
        with np.errstate(over="ignore", invalid="ignore"):
            d = self.left @ right
            off = slack(self.norms, norms, v.shape[1])
            if not np.isfinite(off).all():
                d[~np.isfinite(d)] = -np.inf  # squares beyond double: differences decide
            limit = self.worst ** 2 * (1 + 1e-12) + off
        new = np.isinf(self.worst)
        if new.any() and len(ids) >= self.k:  # the k-th of these rows bounds what can count
            some = d[new]
            some[self.ids[new][:, None] == ids[None, :]] = np.inf
            kth = np.partition(some, self.k - 1, axis=1)[:, self.k - 1] + 2 * off[new]
            limit[new] = np.where(np.isfinite(kth), kth, np.inf)
        i, j = np.nonzero(d <= limit[:, None])
        other = self.ids[i] != ids[j]  # a row is not its own neighbour
        i, j = i[other], j[other]
        with np.errstate(over="ignore"):
            dist = pair_distances(self.v, i, v, j)
        worst = self.worst[i]
        closer = np.isfinite(dist) & ((dist < worst) | ((dist == worst) & (ids[j] < self.worst_id[i])))
        self.best.append((i[closer], ids[j[closer]], dist[closer]))
        self.waiting += int(closer.sum())
        if self.waiting and (new.any() or self.waiting >= self.k * len(self.ids)):
            self.merge()

    def merge(self) -> np.ndarray:
        row, ids, dist = (np.concatenate(x) for x in zip(*self.best, strict=True))
        order = np.lexsort((ids, dist, row))
        row, ids, dist = row[order], ids[order], dist[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        kept = rank < self.k
        row, ids, dist, rank = row[kept], ids[kept], dist[kept], rank[kept]
        last = rank == self.k - 1
        self.worst[row[last]], self.worst_id[row[last]] = dist[last], ids[last]
        self.best, self.waiting = [(row, ids, dist)], 0
        return rank

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        rank = self.merge()
        row, ids, dist = self.best[0]
        return self.ids[row], ids, dist, (rank + 1).astype(np.int32)


def knn_graph(points: DataFrame, id_col: str, vec_col: str, k: int = fixed.KNN_NEIGHBOURS, pivots: int = 32,
              block: int = 65_536, seed: int = fixed.RANDOM_STATE) -> DataFrame:
    """Exact k nearest neighbours of every row among all rows: (src, dst, distance, rank); ties go to the smaller id.

    Rows belong to the nearest of ``pivots`` sampled rows.  The triangle inequality bounds the distance to the k-th
    neighbour for a whole cell from the cells' radii and their k + 1 rows nearest to the pivot, and thereby which
    rows a cell can need at all; only those are sent to it.  Cells are cut into blocks, some two per core and at most
    ``block`` rows each; a task holds one, the rows that its cell needs pass by, the cell's own first, and the task
    returns the k best of each row.  So a row is sent once per block that may need it: the rows sent grow with the
    table until blocks reach their bound, the pairs compared grow quadratically where the bounds leave all.  Squared
    distances come from matrix products; what these do not rule out is taken from differences.
    The driver sees the pivots and k + 1 numbers per pivot.  Rows without a vector of finite numbers have no neighbours.
    """
    spark = points.sparkSession
    pts = materialize(points.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
                      .filter("v is not null and forall(v, x -> coalesce(abs(x) < double('Infinity'), false))"), "knn")
    chosen = sample_exact(pts, pivots, "id", seed).orderBy("id").collect()
    schema = "src long, dst long, distance double, rank int"
    if not chosen:
        return spark.createDataFrame([], schema)
    P = np.array([r["v"] for r in chosen], float)
    bc = spark.sparkContext.broadcast(P)

    def assign(batches):
        for b in batches:
            d = _distances(matrix(b.column(1)), bc.value) if b.num_rows else np.zeros((0, len(bc.value)))
            cell = d.argmin(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell), pa.array(d[np.arange(len(d)), cell])], ["id", "cell", "own"])

    own = materialize(pts.mapInArrow(assign, "id long, cell int, own double"), "knn-cells")
    radius = np.zeros(len(P))
    for r in own.groupBy("cell").agg(F.max("own").alias("r")).collect():
        radius[r["cell"]] = r["r"]
    nearest = [(r["cell"], r["own"]) for r in top_k_per_group(own, "cell", ["own", "id"], k + 1).collect()]
    across = _distances(P, P)
    reach = np.full(len(P), np.inf)
    for q in range(len(P)):
        far = sorted(across[q, j] + d for j, d in nearest)
        if len(far) > k:  # every row of q has k others within radius + far[k]; a needed row is one more radius away
            reach[q] = (2 * radius[q] + far[k]) * (1 + 1e-9)
    own_of = spark.sparkContext.broadcast((P, reach))

    def needed(batches):
        pv, lim = own_of.value
        for b in batches:
            if b.num_rows:
                d = _distances(matrix(b.column(1)), pv)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(d.argmin(axis=1).astype(np.int32)), b.column(1),
                                                  pa.array([np.flatnonzero(x <= lim).astype(np.int32).tolist() for x in d], pa.list_(pa.int32()))],
                                                 ["id", "home", "v", "cells"])

    sent = materialize(pts.mapInArrow(needed, "id long, home int, v array<double>, cells array<int>"), "knn-sent")
    homes = {r["home"]: r["n"] for r in sent.groupBy("home").agg(F.count("*").alias("n")).collect()}  # at most one row per pivot
    rows = block_rows(sum(homes.values()), block, spark.sparkContext.defaultParallelism)
    placed, groups = [], 0
    for cell, n in sorted(homes.items()):
        placed.append((cell, groups, -(-n // rows)))
        groups += -(-n // rows)
    placed = F.broadcast(spark.createDataFrame(placed, "cell int, first int, blocks int"))
    ask = sent.join(placed, F.col("home") == F.col("cell")).select(
        (F.col("first") + F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks"))).cast("int").alias("block"), F.lit(0).alias("role"), "id", "v")
    give = sent.select("id", "v", "home", F.explode("cells").alias("cell")).join(placed, "cell").select(
        F.explode(F.sequence(F.col("first"), F.col("first") + F.col("blocks") - 1)).alias("block"),
        F.when(F.col("home") == F.col("cell"), 1).otherwise(2).alias("role"), "id", "v")
    centre = P.mean(axis=0)
    centre = np.where(np.isfinite(centre), centre, 0.0)
    return stream_groups(ask.unionByName(give), "block", groups, ["role"], lambda: _Nearest(k, centre), schema)
