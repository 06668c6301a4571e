"""Ward agglomerative clustering by rounds of reciprocal nearest neighbours (K6).

Ward's merge cost |A||B| / (|A| + |B|) * ||cA - cB||^2 needs only the size and the centroid of each cluster, and it
is reducible: a merged cluster is no nearer to a third one than the nearer of its parts.  So in a round all pairs that
are each other's nearest merge at once, and only clusters that are new or lost their nearest one search again.  The tree
is that of the sequential order, always the cheapest pair.

Rows at one place are one cluster from the start (their merges cost nothing).  Clusters are named by their smallest id, so
every place but one is absorbed exactly once and the merges are a table of pointers: ``ward_tree`` returns it, and a cut into k
clusters leaves out the k - 1 dearest merges and follows the others.

Beyond ``SMALL`` clusters a round is Spark jobs: a tree of halved cells deals the clusters into blocks of at most ``BLOCK``;
a cluster searches its own block, then those blocks whose box, size and least weight do not exclude a cheaper pair.  Up to ``SMALL``
clusters their centroids are three arrays, and only the search for nearest ones is dealt out, if it is large.

Optionally rows are first summed up: in at most ``cells`` adaptive cells, halved where their sums of squares are largest, or in
``bins`` x ``bins`` cells of a fixed grid over the plane's range, which a few far rows make coarse.  Rows of a cell then stay together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blotter.operators.grouped import map_groups
from blotter.session import materialize

#: Most adaptive cells, where rows are summed up first.
CELLS = 48 * 48
#: Most clusters whose centroids are held as arrays; clusters of a block; clusters of other blocks that meet a block at once.
SMALL, BLOCK, PROBES = 20_000, 1024, 8192
#: Pairs that are compared without a job.
PAIRS = 20_000_000
MERGES = "absorbed long, survivor long, cost double, size double, round int"


# ---------------------------------------------------------------- cells


def grid_cells(pts: DataFrame, bins: int) -> DataFrame:
    """``pts`` and cell, the number of a cell of a fixed grid over the range, else null."""
    r = pts.agg(*[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))]).first()

    def cell(c):
        lo, hi = r[f"lo_{c}"], r[f"hi_{c}"]
        if lo is None or hi == lo:
            return F.when(F.col(c).isNotNull(), F.lit(0))
        place = F.least(F.floor((F.col(c) - F.lit(lo)) / F.lit(hi - lo) * bins), F.lit(bins - 1)).cast("int")
        return F.when(F.col(c).isNotNull(), place)

    return pts.withColumn("cell", cell("x").cast("long") * bins + cell("y"))


class Halves:
    """Binary tree of halved cells; a node that was not halved is a cell and is named by its number."""

    def __init__(self):
        self.axis, self.at, self.left = [-1], [0.0], [0]

    def halve(self, node: int, axis: int, at: float) -> None:
        self.axis[node], self.at[node], self.left[node] = axis, at, len(self.axis)
        self.axis += [-1, -1]
        self.at += [0.0, 0.0]
        self.left += [0, 0]

    def halve_box(self, r) -> None:
        """Halve cell ``r`` (cell, lo_x, hi_x, lo_y, hi_y) across the longer side of the box around its rows."""
        axis = int(r["hi_y"] - r["lo_y"] > r["hi_x"] - r["lo_x"])
        lo, hi = r[f"lo_{'xy'[axis]}"], r[f"hi_{'xy'[axis]}"]
        middle = lo / 2 + hi / 2
        self.halve(r["cell"], axis, middle if lo <= middle < hi else lo)

    def cells(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        axis, at, left = np.array(self.axis), np.array(self.at), np.array(self.left)
        node = np.zeros(len(x), np.int64)
        open_ = np.flatnonzero(axis[node] >= 0)
        while len(open_):
            here = node[open_]
            v = np.where(axis[here] == 0, x[open_], y[open_])
            node[open_] = left[here] + (v > at[here])
            open_ = open_[axis[node[open_]] >= 0]
        return node


def _with_cells(pts: DataFrame, tree: Halves) -> DataFrame:
    """``pts`` and cell; null without two finite coordinates."""

    def run(batches):
        for b in batches:
            x, y = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float) for c in "xy")  # null as nan
            cell = pa.array(tree.cells(x, y), mask=~(np.isfinite(x) & np.isfinite(y)))
            yield pa.RecordBatch.from_arrays([*b.columns, cell], [*b.schema.names, "cell"])

    return pts.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pts.schema) + ", cell long")


def _boxes(pts: DataFrame, *more) -> list:
    """A row per occupied cell: count, box and further aggregates."""
    return pts.filter("cell is not null").groupBy("cell").agg(
        F.count("*").alias("rows"), *[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))], *more).collect()


def _wide(r) -> bool:
    return r["hi_x"] > r["lo_x"] or r["hi_y"] > r["lo_y"]


def adaptive_cells(pts: DataFrame, most: int = CELLS) -> DataFrame:
    """``pts`` and cell; null without two finite coordinates.

    A round halves every cell whose sum of squares is at least half the mean one, the largest first, until there are
    ``most`` cells or each holds a single place.
    """
    pts, tree = materialize(pts.select("id", "x", "y"), "ward-rows"), Halves()
    while True:
        got = _boxes(_with_cells(pts, tree), F.var_pop("x").alias("var_x"), F.var_pop("y").alias("var_y"))  # at most `most` rows
        rows = [(r["rows"] * (r["var_x"] + r["var_y"]), r) for r in got]
        least = sum(s for s, _ in rows) / (2 * len(rows)) if rows else 0.0
        wide = sorted((-s, r["cell"], r) for s, r in rows if s >= least and _wide(r))
        if not wide or len(rows) >= most:
            return _with_cells(pts, tree)
        for _, _, r in wide[:most - len(rows)]:
            tree.halve_box(r)


# ---------------------------------------------------------------- rounds over arrays


def _nearest(n, x, y, rows) -> tuple[np.ndarray, np.ndarray]:
    """Nearest other cluster (ties: the first) and its cost, for each of ``rows``."""
    near, cost = np.zeros(len(rows), np.int64), np.zeros(len(rows))
    for at in range(0, len(rows), max(1, 4_000_000 // max(1, len(n)))):
        i = rows[at:at + max(1, 4_000_000 // max(1, len(n)))]
        c = n * n[i, None] / (n + n[i, None]) * ((x - x[i, None]) ** 2 + (y - y[i, None]) ** 2)
        c[np.arange(len(i)), i] = np.inf
        near[at:at + len(i)] = c.argmin(axis=1)
        cost[at:at + len(i)] = c[np.arange(len(i)), near[at:at + len(i)]]
    return near, cost


def _nearest_by_tasks(spark, n, x, y, rows):
    shared = spark.sparkContext.broadcast((n, x, y))

    def run(batches):
        for b in batches:
            i = np.asarray(b.column(0))
            near, cost = _nearest(*shared.value, i)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(near), pa.array(cost)], ["i", "near", "cost"])

    parts = min(len(rows), 4 * spark.sparkContext.defaultParallelism)
    got = spark.createDataFrame([(int(i),) for i in rows], "i long").repartition(parts).mapInArrow(run, "i long, near long, cost double").toArrow().sort_by("i")
    shared.destroy()
    return np.asarray(got.column("near")), np.asarray(got.column("cost"))


def merge_arrays(spark, ids, n, x, y, first_round: int = 0, stop: int = 1) -> list[tuple[int, int, float, float, int]]:
    """Merges (absorbed, survivor, cost, size, round) of clusters in ascending order of ``ids`` until ``stop`` are left."""
    ids, (n, x, y) = np.asarray(ids), (np.asarray(a, float).copy() for a in (n, x, y))
    near, cost = np.zeros(len(ids), np.int64), np.zeros(len(ids))
    stale, merges, round_ = np.arange(len(ids)), [], first_round
    while len(ids) > stop:
        if len(stale):
            by = _nearest if len(stale) * len(ids) <= PAIRS else lambda *a: _nearest_by_tasks(spark, *a)
            near[stale], cost[stale] = by(n, x, y, stale)
        a = np.flatnonzero((near[near] == np.arange(len(ids))) & (np.arange(len(ids)) < near))
        if not len(a):  # equal costs in a ring of older searches
            if len(stale) == len(ids):
                raise AssertionError("no reciprocal pair")
            stale = np.arange(len(ids))
            continue
        b = near[a]
        merges += zip(ids[b].tolist(), ids[a].tolist(), cost[a].tolist(), (n[a] + n[b]).tolist(), [round_] * len(a), strict=True)
        x[a], y[a] = ((n[a] * z[a] + n[b] * z[b]) / (n[a] + n[b]) for z in (x, y))
        n[a] += n[b]
        gone, changed = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
        gone[b] = True
        changed[a] = changed[b] = True
        again = changed | changed[near]
        place = np.cumsum(~gone) - 1
        near, again = place[near[~gone]], again[~gone]
        ids, n, x, y, cost = (z[~gone] for z in (ids, n, x, y, cost))
        stale = np.flatnonzero(again)
        round_ += 1
    return merges


# ---------------------------------------------------------------- rounds over tables


def _block_tree(clusters: DataFrame) -> Halves:
    """Cells of at most BLOCK clusters (more only at one place); a row per cell reaches the driver."""
    tree = Halves()
    while True:
        full = [r for r in _boxes(_with_cells(clusters.select("id", "x", "y"), tree)) if r["rows"] > BLOCK and _wide(r)]
        if not full:
            return tree
        for r in full:
            tree.halve_box(r)


_PROBE = "cell long, part int, probe boolean, id long, n double, x double, y double"


def _cheapest(group: pa.Table) -> pa.Table | None:
    """Of each probe the cheapest member of the block (ties: the smallest id)."""
    probe = np.asarray(group.column("probe").combine_chunks().to_numpy(zero_copy_only=False), bool)
    ids, n, x, y = (np.asarray(group.column(c)) for c in ("id", "n", "x", "y"))
    member = np.flatnonzero(~probe)
    member = member[np.argsort(ids[member], kind="stable")]
    who = np.flatnonzero(probe)
    if not len(member) or not len(who):
        return None
    near, cost = np.zeros(len(who), np.int64), np.full(len(who), np.inf)
    step = max(1, 4_000_000 // len(member))
    for at in range(0, len(who), step):
        i = who[at:at + step, None]
        c = n[member] * n[i] / (n[member] + n[i]) * ((x[member] - x[i]) ** 2 + (y[member] - y[i]) ** 2)
        c[ids[member] == ids[i]] = np.inf
        best = c.argmin(axis=1)
        near[at:at + len(best)], cost[at:at + len(best)] = ids[member[best]], c[np.arange(len(best)), best]
    found = pa.array(np.isfinite(cost))
    return pa.table({"id": ids[who], "near": near, "cost": cost}).filter(found)


def _search(clusters: DataFrame, probes: DataFrame) -> DataFrame:
    """(id, near, cost): of each probe (cell, id, n, x, y) the cheapest cluster of that cell."""
    many = probes.groupBy("cell").agg(F.ceil(F.count("*") / PROBES).cast("int").alias("parts"))
    dealt = probes.join(many, "cell").select("cell", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.lit(True).alias("probe"), "id", "n", "x", "y")
    members = clusters.join(many, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "cell", "part", F.lit(False).alias("probe"), "id", "n", "x", "y")
    return map_groups(dealt.unionByName(members), ["cell", "part"], _cheapest, "id long, near long, cost double")


def _other_cells(own: DataFrame, boxes: list) -> DataFrame:
    """(cell, id, n, x, y): the other cells in which a cluster cheaper than ``cost`` may lie."""
    names = ("lo_x", "hi_x", "lo_y", "hi_y", "least", "most")
    table = (np.array([r["cell"] for r in boxes]), *(np.array([r[c] for r in boxes], float) for c in names))
    shared = own.sparkSession.sparkContext.broadcast(table)  # a row per cell

    def run(batches):
        cell, lx, hx, ly, hy, least, most = shared.value
        for b in batches:
            home, n, x, y, cost = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("cell", "n", "x", "y", "cost"))
            rows, cells = [], []
            for i in range(len(n)):
                away = cell != home[i]
                near = np.maximum(0, np.maximum(lx - x[i], x[i] - hx)) ** 2 + np.maximum(0, np.maximum(ly - y[i], y[i] - hy)) ** 2
                far = np.maximum(hx - x[i], x[i] - lx) ** 2 + np.maximum(hy - y[i], y[i] - ly) ** 2
                bound = min(cost[i] if np.isfinite(cost[i]) else np.inf, np.min(np.where(away, n[i] * most / (n[i] + most) * far, np.inf), initial=np.inf))
                hit = np.flatnonzero(away & (n[i] * least / (n[i] + least) * near <= bound * (1 + 1e-9)))
                rows.append(np.full(len(hit), i))
                cells.append(cell[hit])
            at = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
            out = [pa.array(np.concatenate(cells) if cells else np.zeros(0, np.int64))] + [b.column(b.schema.get_field_index(c)).take(at) for c in ("id", "n", "x", "y")]
            yield pa.RecordBatch.from_arrays(out, ["cell", "id", "n", "x", "y"])

    return own.mapInArrow(run, "cell long, id long, n double, x double, y double")


def _round(clusters: DataFrame, tree: Halves) -> DataFrame:
    """(id, n, x, y, near, cost): ``clusters`` with the nearest one where it was not known."""
    placed = materialize(_with_cells(clusters, tree), "ward-placed")
    boxes = _boxes(placed, F.min("n").alias("least"), F.max("n").alias("most"))
    stale = placed.filter("near is null").select("cell", "id", "n", "x", "y")
    inside = materialize(_search(placed, stale), "ward-inside")
    bounded = stale.join(inside.select("id", "cost"), "id", "left").withColumn("cost", F.coalesce("cost", F.lit(float("inf"))))
    outside = _search(placed, materialize(_other_cells(bounded, boxes), "ward-probes"))
    best = inside.unionByName(outside).groupBy("id").agg(F.min(F.struct("cost", "near")).alias("best"))
    return materialize(placed.drop("cell").join(best, "id", "left").select(
        "id", "n", "x", "y", F.coalesce("near", "best.near").alias("near"), F.coalesce("cost", "best.cost").alias("cost")), "ward-near")


def merge_tables(places: DataFrame) -> DataFrame:
    """MERGES of (id, n, x, y), written; rounds over tables until SMALL clusters are left, then over arrays."""
    spark = places.sparkSession
    clusters = materialize(places.select("id", F.col("n").cast("double").alias("n"), "x", "y", F.lit(None).cast("long").alias("near"),
                                         F.lit(None).cast("double").alias("cost")), "ward-clusters")
    merges, round_, count, dealt = [], 0, clusters.count(), None
    while count > SMALL:
        if dealt is None or 4 * count < dealt:
            tree, dealt = _block_tree(clusters), count
        known = _round(clusters, tree)
        other = known.select(F.col("id").alias("o_id"), F.col("near").alias("o_near"), F.col("n").alias("o_n"), F.col("x").alias("o_x"), F.col("y").alias("o_y"))
        pairs = materialize(known.join(other, (F.col("near") == F.col("o_id")) & (F.col("o_near") == F.col("id")) & (F.col("id") < F.col("o_id"))).select(
            "id", F.col("o_id").alias("absorbed"), "cost", (F.col("n") + F.col("o_n")).alias("n"),
            *[((F.col("n") * F.col(c) + F.col("o_n") * F.col(f"o_{c}")) / (F.col("n") + F.col("o_n"))).alias(c) for c in "xy"]), "ward-pairs")
        found = pairs.count()
        if not found:  # equal costs in a ring of older searches
            clusters = materialize(known.withColumns({"near": F.lit(None).cast("long"), "cost": F.lit(None).cast("double")}), "ward-clusters")
            continue
        merges.append(pairs.select("absorbed", F.col("id").alias("survivor"), "cost", F.col("n").alias("size"), F.lit(round_).alias("round")))
        ends = pairs.select(F.explode(F.array("id", "absorbed")).alias("id"))
        rest = known.join(ends, "id", "left_anti").join(ends.select(F.col("id").alias("near"), F.lit(True).alias("lost")), "near", "left")
        keep = F.col("lost").isNull()
        rest = rest.select("id", "n", "x", "y", F.when(keep, F.col("near")).alias("near"), F.when(keep, F.col("cost")).alias("cost"))
        fresh = pairs.select("id", "n", "x", "y", F.lit(None).cast("long").alias("near"), F.lit(None).cast("double").alias("cost"))
        clusters = materialize(rest.unionByName(fresh), "ward-clusters")
        count, round_ = count - found, round_ + 1
    left = clusters.select("id", "n", "x", "y").toArrow().sort_by("id")  # at most SMALL rows
    last = merge_arrays(spark, *(np.asarray(left.column(c)) for c in ("id", "n", "x", "y")), first_round=round_)
    out = spark.createDataFrame(last, MERGES)
    for m in merges:
        out = out.unionByName(m)
    return materialize(out, "ward-merges")


# ---------------------------------------------------------------- tree and cut


def _points(df: DataFrame, id_col: str, x_col: str, y_col: str) -> DataFrame:
    x, y = (F.col(c).cast("double") for c in (x_col, y_col))
    fine = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y) & (F.abs(x) < float("inf")) & (F.abs(y) < float("inf"))
    return df.select(F.col(id_col).alias("id"), F.when(fine, x + 0.0).alias("x"), F.when(fine, y + 0.0).alias("y"))


def _places(pts: DataFrame, key: list[str]) -> DataFrame:
    return pts.filter(" and ".join(f"{k} is not null" for k in key)).groupBy(*key).agg(
        F.min("id").cast("long").alias("id"), F.count("*").alias("n"), *[F.avg(c).alias(c) for c in "xy" if c not in key])


def ward_tree(df: DataFrame, id_col: str, x_col: str, y_col: str) -> DataFrame:
    """The dendrogram: absorbed, survivor (the smallest ids of the two clusters), cost, size, round; integer ids.

    A row per distinct place but one.  Merges in order of (cost, round) are those of the sequential algorithm; scikit-learn's
    height of a merge is sqrt(2 * cost).
    """
    return merge_tables(_places(_points(df, id_col, x_col, y_col), ["x", "y"]))


def cut_tree(merges: DataFrame, places: DataFrame, k: int) -> DataFrame:
    """(id, cluster int): the cluster of each place when the k - 1 dearest merges are undone, numbered by smallest id."""
    dearest = [r["absorbed"] for r in merges.orderBy(F.desc("cost"), F.desc("round"), "absorbed").limit(max(1, k) - 1).collect()]
    up = merges.filter(~F.col("absorbed").isin(dearest)).select(F.col("absorbed").alias("id"), F.col("survivor").alias("top"))
    while True:  # pointers double: as many rounds as the longest chain has bits
        nxt = up.select(F.col("id").alias("top"), F.col("top").alias("then"))
        up = materialize(up.join(nxt, "top", "left").select("id", F.coalesce("then", "top").alias("top"), F.col("then").isNotNull().alias("moved")), "ward-tops")
        if up.filter("moved").isEmpty():
            break
        up = up.drop("moved")
    tops = places.select("id").join(up.select("id", "top"), "id", "left").select("id", F.coalesce("top", "id").alias("top"))
    names = sorted(r["top"] for r in tops.select("top").distinct().collect())  # k at most
    if not names:
        return tops.select("id", F.lit(None).cast("int").alias("cluster"))
    return tops.select("id", F.array_position(F.array(*[F.lit(t) for t in names]), F.col("top")).cast("int").alias("place")).select(
        "id", (F.col("place") - 1).alias("cluster"))


def ward(df: DataFrame, id_col: str, x_col: str, y_col: str, k: int, bins: int | None = None, cells: int | None = None) -> DataFrame:
    """(id, cluster) for every row; clusters are numbered by their smallest id (integer ids).

    The tree is that of all rows, or of adaptive ``cells`` or a ``bins`` x ``bins`` grid.  Rows without two finite coordinates
    have no cluster (null).  k above the number of places or occupied cells gives a cluster each.
    """
    pts = _points(df, id_col, x_col, y_col)
    key = ["x", "y"] if bins is None and cells is None else ["cell"]
    if key == ["cell"]:
        pts = adaptive_cells(pts, cells) if bins is None else grid_cells(pts, bins)
    places = materialize(_places(pts, key), "ward-places")
    labels = cut_tree(merge_tables(places), places, k)
    return pts.join(places.select(*key, F.col("id").alias("place")).join(labels.withColumnRenamed("id", "place"), "place").drop("place"),
                    key, "left").select(F.col("id").alias(id_col), "cluster")
