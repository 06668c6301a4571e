"""Approximate k-nearest-neighbour graph: a random-projection forest, then rounds of neighbour descent.

``reduce.knn_graph`` is exact and, in many dimensions, compares nearly all pairs.  Here each of ``trees`` trees splits
space by hyperplanes half-way between two random rows into leaves of about ``leaf`` rows; rows that share a leaf are
compared.  A round of descent then lets every row introduce its ``near`` nearest neighbours, and the ``near`` nearest of the rows
that name it, to each other: neighbours of neighbours are likely neighbours.  Pairs that both have been there before are not
compared again.  Every distance that is reported is exact; which rows are found is not certain, so ``recall`` measures it
against the exact form.

The trees are fitted on a bounded sample, ``fit_sample`` rows, and hold a row per split; every row of the table is
dealt and linked.  A leaf that has more rows than ``leaf`` is dealt into blocks by a hash.  Work and shuffle are linear in the rows: ``trees``
copies of a row, then at most 2 x ``near`` copies a round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blotter.functions import fixed
from blotter.operators.grouped import map_groups
from blotter.operators.pairs import matrix
from blotter.operators.reduce import _distances, top_k_per_group
from blotter.operators.sampling import sample_exact
from blotter.session import materialize

_EDGE = "src long, dst long, distance double"


class Tree:
    """Hyperplane splits: node i sends x to left[i] + (x . normal[i] > offset[i]); a node without split is a leaf."""

    def __init__(self, X: np.ndarray, leaf: int, seed: int):
        rng = np.random.default_rng(seed)
        self.left, normals, offsets = [0], [np.zeros(X.shape[1])], [0.0]
        todo = [(0, np.arange(len(X)))]
        while todo:
            node, rows = todo.pop()
            if len(rows) <= leaf:
                continue
            a, b = X[rng.choice(rows, 2, replace=False)]
            p = X[rows] @ (a - b)
            middle = float(np.median(p))
            right = p > middle
            if not right.any() or right.all():  # rows at one place
                continue
            self.left[node], normals[node], offsets[node] = len(self.left), a - b, middle
            for part in (~right, right):
                todo.append((len(self.left), rows[part]))
                self.left.append(0)
                normals.append(np.zeros(X.shape[1]))
                offsets.append(0.0)
        self.left, self.normal, self.offset = np.array(self.left), np.array(normals), np.array(offsets)

    def leaves(self, X: np.ndarray) -> np.ndarray:
        node = np.zeros(len(X), np.int64)
        open_ = np.flatnonzero(self.left[node] > 0)
        while len(open_):
            here = node[open_]
            node[open_] = self.left[here] + (np.einsum("ij,ij->i", X[open_], self.normal[here]) > self.offset[here])
            open_ = open_[self.left[node[open_]] > 0]
        return node


def _nearest_in(group: pa.Table, k: int) -> pa.Table | None:
    """k nearest of each row within the group; a last row without src holds the number of pairs compared."""
    ids, v = np.asarray(group.column("id")), matrix(group.column("v"))
    n = len(ids)
    if n < 2:
        return None
    d = _distances(v, v)
    d[ids[:, None] == ids[None, :]] = np.inf
    order = np.argsort(d, axis=1, kind="stable")[:, :min(k, n - 1)]
    far = np.take_along_axis(d, order, 1)
    src, ok = np.repeat(ids, order.shape[1]), np.isfinite(far.ravel())
    return _with_count(src[ok], ids[order.ravel()[ok]], far.ravel()[ok], n * (n - 1) // 2)


def _with_count(src, dst, distance, compared: int) -> pa.Table:
    return pa.table({"src": pa.array([*src.tolist(), None], pa.int64()), "dst": pa.array([*dst.tolist(), compared], pa.int64()),
                     "distance": pa.array([*distance.tolist(), 0.0], pa.float64())})


def _merged(edges: DataFrame, k: int) -> DataFrame:
    """(src, dst, distance, rank, fresh): the k nearest of each src among distinct edges (fresh only where all copies are)."""

    def run(batches):
        at, rank, seen = None, 0, {}
        for b in batches:
            src, dst, dist, fresh = (b.column(i).to_pylist() for i in range(4))
            keep, ranks = [], []
            for i, s in enumerate(src):
                if s != at:
                    at, rank, seen = s, 0, set()
                if rank < k and dst[i] not in seen:
                    seen.add(dst[i])
                    rank += 1
                    keep.append(i)
                    ranks.append(rank)
            out = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns[:3], pa.array(ranks, pa.int32()), out.column(3)], ["src", "dst", "distance", "rank", "fresh"])

    rows = edges.select("src", "dst", "distance", "fresh").repartition("src").sortWithinPartitions("src", "distance", "dst", "fresh")
    return rows.mapInArrow(run, f"{_EDGE}, rank int, fresh boolean")


def _introduced(group: pa.Table) -> pa.Table | None:
    """Pairs of a row's acquaintances that were not both known before and are nearer than what one of them has."""
    ids = np.asarray(group.column("u"))
    first = np.unique(ids, return_index=True)[1]  # a row that is named in both directions: fresh if one naming is
    fresh = np.asarray(group.column("fresh").combine_chunks().to_numpy(zero_copy_only=False), bool)
    fresh = np.array([fresh[ids == ids[i]].any() for i in first])
    ids, v, worst = ids[first], matrix(group.column("v"))[first], np.asarray(group.column("worst"))[first]
    need = np.triu(fresh[:, None] | fresh[None, :], 1)
    a, b = np.nonzero(need)
    if not len(a):
        return None
    d = np.sqrt(((v[a] - v[b]) ** 2).sum(axis=1))
    one, two = d < worst[a], d < worst[b]
    return _with_count(np.concatenate([ids[a[one]], ids[b[two]]]), np.concatenate([ids[b[one]], ids[a[two]]]),
                       np.concatenate([d[one], d[two]]), len(a))


def knn_graph_descent(points: DataFrame, id_col: str, vec_col: str, k: int = fixed.KNN_NEIGHBOURS, trees: int = 6, leaf: int = 48,
                      near: int = 20, rounds: int = 3, fit_sample: int = 50_000, seed: int = fixed.RANDOM_STATE, stats: dict | None = None) -> DataFrame:
    """k neighbours of every row, nearly always the nearest: (src, dst, distance, rank); ids are unique integers.

    Rows without a vector have no neighbours.  ``stats`` gets ``rows`` and ``compared``, the number of pairs whose distance was taken.
    """
    spark = points.sparkSession
    pts = materialize(points.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
                      .filter("v is not null"), "descent")
    n = pts.count()
    if not n:
        return spark.createDataFrame([], f"{_EDGE}, rank int")
    sample = sample_exact(pts, fit_sample, "id", seed).orderBy("id").toArrow() if n > fit_sample else pts.toArrow().sort_by("id")
    X = matrix(sample.column("v"))
    small = max(2, leaf * len(X) // n)
    forest = spark.sparkContext.broadcast([Tree(X, small, seed + t) for t in range(trees)])

    def deal(batches):
        for b in batches:
            if not b.num_rows:
                continue
            V = matrix(b.column(1))
            for t, tree in enumerate(forest.value):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.full(len(V), t, np.int32)), pa.array(tree.leaves(V))],
                                                 ["id", "v", "tree", "place"])

    dealt = materialize(pts.mapInArrow(deal, "id long, v array<double>, tree int, place long"), "descent-leaves")
    blocks = dealt.groupBy("tree", "place").agg(F.ceil(F.count("*") / (2 * leaf)).cast("int").alias("blocks"))
    leaves = dealt.join(blocks, ["tree", "place"]).withColumn("block", F.pmod(F.xxhash64("id", "tree"), "blocks").cast("int")).drop("blocks")
    found = materialize(map_groups(leaves, ["tree", "place", "block"], lambda g: _nearest_in(g, k), _EDGE), "descent-found")
    compared = found.filter("src is null").agg(F.sum("dst")).first()[0] or 0
    graph = materialize(_merged(found.filter("src is not null").withColumn("fresh", F.lit(True)), k), "descent-graph")
    for _ in range(rounds):
        forward = graph.filter(F.col("rank") <= near).select(F.col("src").alias("w"), F.col("dst").alias("u"), "fresh")
        back = top_k_per_group(graph, "dst", ["distance", "src"], near, "place").select(F.col("dst").alias("w"), F.col("src").alias("u"), "fresh")
        worst = graph.groupBy(F.col("src").alias("u")).agg(F.max("distance").alias("worst"), F.count("*").alias("has"))
        rows = pts.select(F.col("id").alias("u"), "v").join(worst, "u").withColumn("worst", F.when(F.col("has") < k, float("inf")).otherwise(F.col("worst"))).drop("has")
        met = forward.unionByName(back).join(rows, "u").select("w", "u", "fresh", "worst", "v")
        new = materialize(map_groups(met, ["w"], _introduced, _EDGE), "descent-found")
        compared += new.filter("src is null").agg(F.sum("dst")).first()[0] or 0
        both = graph.select("src", "dst", "distance", F.lit(False).alias("fresh")).unionByName(
            new.filter("src is not null").withColumn("fresh", F.lit(True)))
        graph = materialize(_merged(both, k), "descent-graph")
    if stats is not None:
        stats.update(rows=n, compared=compared)
    return graph.select("src", "dst", "distance", "rank")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact graph's edges that ``found`` has, or has another of the same distance in place of."""
    worst = exact.groupBy("src").agg(F.max("distance").alias("worst"), F.count("*").alias("n"))
    hit = found.join(worst, "src").filter(F.col("distance") <= F.col("worst") * (1 + 1e-12)).groupBy("src").agg(F.count("*").alias("hit"))
    row = worst.join(hit, "src", "left").agg(F.sum(F.least(F.coalesce("hit", F.lit(0)), "n")).alias("hit"), F.sum("n").alias("n")).first()
    return row["hit"] / row["n"] if row["n"] else 1.0
