"""Exact DBSCAN on 2-D points as DataFrame joins on a grid.

Same result as the sequential algorithm (neighbourhood = distance <= eps,
self included; clusters numbered by their first core row in ``order_col``
order; a border row takes the smallest adjacent cluster number; the rest -1).

Plan, with its scale properties:

1. Cells of side eps/sqrt(2) (split into 4 x 4 sub-cells).  Any two rows of a
   cell are neighbours, so a cell holding >= min_samples rows is all core
   without a single distance.  Cell counts are a partial + final aggregate.
2. Rows of the other ("sparse") cells count their neighbours by an equi-join
   on the 25 surrounding cell keys plus the distance test.  Probing rows are
   fewer than min_samples per cell; target cells holding many rows are salted
   so a hot cell is spread over several tasks.
3. Core cells are linked when some core pair across them is within eps.
   Rows at the same place are one point here.  Sub-cell bounding boxes decide
   most cell pairs without distances (box pair fully within eps -> linked,
   fully beyond -> not).  Box pairs straddling the eps boundary, for cell
   pairs not yet linked, compare points when the exact count of such point
   pairs is within ``pair_budget``; above it the boxes are halved again and
   again, which decides most of them, until the count is within the budget
   or no box holds two points any more.
4. Connected components of the cell graph by star contraction; the cell
   graph is bounded by the area over eps^2, not by the number of rows, and
   the rounds grow with the logarithm of its size.
5. Rows of dense cells take their cell's cluster through a broadcast of the
   (bounded) cell table; only rows of sparse cells are matched by id with
   their core flag and their kept neighbour lists (border rows).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blotter.operators.components import connected_components
from blotter.operators.ranking import number_sorted
from blotter.session import materialize

SUB = 4
BROADCAST_CELLS = 2_000_000


def _cut(df: DataFrame) -> DataFrame:
    return materialize(df, "dbscan")


def _maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_CELLS else df


def dbscan(df: DataFrame, id_col: str, x_col: str, y_col: str, eps: float = 0.02, min_samples: int = 20,
           order_col: str | None = None, salt_rows: int = 200_000,
           pair_budget: int = 50_000_000) -> DataFrame:
    """(id_col, cluster) of every row; rows without coordinates are noise."""
    eps = float(eps)
    eps2 = eps * eps
    side = eps / math.sqrt(2.0) * (1.0 - 1e-12)
    t = side / SUB
    order_col = order_col or id_col

    rows = df.select(F.col(id_col).alias("id"), F.col(order_col).alias("ord"),
                     F.col(x_col).cast("double").alias("x"), F.col(y_col).cast("double").alias("y"))
    nowhere = F.col("x").isNull() | F.col("y").isNull()
    pts = (rows.where(~nowhere)
           .withColumn("sx", F.floor(F.col("x") / F.lit(t)).cast("long"))
           .withColumn("sy", F.floor(F.col("y") / F.lit(t)).cast("long"))
           .withColumn("cx", F.floor(F.col("sx") / F.lit(SUB)).cast("long"))
           .withColumn("cy", F.floor(F.col("sy") / F.lit(SUB)).cast("long")))

    cells = (pts.groupBy("cx", "cy").agg(F.count("*").alias("n"))
             .withColumn("ns", F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(salt_rows))).cast("int"))
             .transform(_cut))
    extent = cells.agg(F.count("*").alias("n"), F.max(F.greatest(F.abs("cx"), F.abs("cy"))).alias("far")).first()
    n_cells, packed = extent["n"], (extent["far"] or 0) < 2**31
    cells_b = _maybe_broadcast(cells, n_cells)
    pts = pts.join(cells_b, ["cx", "cy"]).transform(_cut)

    # 2. neighbour counts of rows in sparse cells
    offs = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
                     for dx in range(-2, 3) for dy in range(-2, 3)])
    probes = (pts.where(F.col("n") < min_samples)
              .select(F.col("id").alias("pid"), F.col("x").alias("px"), F.col("y").alias("py"),
                      F.explode(offs).alias("o"), "cx", "cy")
              .select("pid", "px", "py", (F.col("cx") + F.col("o.dx")).alias("cx"),
                      (F.col("cy") + F.col("o.dy")).alias("cy")))
    probes = (probes.join(cells_b.select("cx", "cy", "ns"), ["cx", "cy"])
              .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("ns") - 1))).drop("ns"))
    # only rows of cells next to a sparse cell take part (cell keys: bounded by area / eps^2)
    needed = probes.select("cx", "cy").distinct()
    targets = (pts.join(_maybe_broadcast(needed, n_cells), ["cx", "cy"], "left_semi")
               .select("cx", "cy", F.col("id").alias("nid"), F.col("x").alias("nx"), F.col("y").alias("ny"),
                       F.pmod(F.xxhash64("id"), F.col("ns")).cast("int").alias("salt")))
    d2 = (F.col("px") - F.col("nx")) * (F.col("px") - F.col("nx")) + \
         (F.col("py") - F.col("ny")) * (F.col("py") - F.col("ny"))
    # used four times below: written once
    near = probes.join(targets, ["cx", "cy", "salt"]).where(d2 <= F.lit(eps2)).select("pid", "nid").transform(_cut)
    near_counts = near.groupBy("pid").agg(F.count("*").alias("k"))
    sparse_core = near_counts.where(F.col("k") >= min_samples).select(F.col("pid").alias("id"))
    # neighbour lists of non-core sparse rows: fewer than min_samples each
    border_pairs = near.join(near_counts.where(F.col("k") < min_samples).select("pid"), "pid")

    keep = ["id", "ord", "x", "y", "sx", "sy", "cx", "cy"]
    # dense-cell rows are core as they are; only sparse-cell rows are matched by id
    core = (pts.where(F.col("n") >= min_samples).select(*keep)
            .unionByName(pts.where(F.col("n") < min_samples).join(sparse_core, "id", "left_semi").select(*keep))
            .transform(_cut))

    # 3. link core cells
    places = core.select("x", "y", "sx", "sy", "cx", "cy").distinct().transform(_cut)
    sub = (places.groupBy("sx", "sy")
           .agg(F.first("cx").alias("cx"), F.first("cy").alias("cy"), F.min("x").alias("x0"),
                F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
                F.count("*").alias("n")))
    reach = int(math.ceil(eps / t)) + 1
    sub_offs = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
                         for dx in range(-reach, reach + 1) for dy in range(-reach, reach + 1)])
    a = sub.select(*[F.col(c).alias(f"a_{c}") for c in sub.columns]) \
        .withColumn("o", F.explode(sub_offs)) \
        .withColumn("b_sx", F.col("a_sx") + F.col("o.dx")).withColumn("b_sy", F.col("a_sy") + F.col("o.dy")) \
        .drop("o")
    b = sub.select(*[F.col(c).alias(f"b_{c}") for c in sub.columns])
    pairs = a.join(b, ["b_sx", "b_sy"]).where(
        (F.col("a_cx") < F.col("b_cx")) | ((F.col("a_cx") == F.col("b_cx")) & (F.col("a_cy") < F.col("b_cy"))))

    def gap(lo1, hi1, lo2, hi2):
        return F.greatest(F.lit(0.0), F.col(lo2) - F.col(hi1), F.col(lo1) - F.col(hi2))

    def span(lo1, hi1, lo2, hi2):
        return F.greatest(F.col(hi2) - F.col(lo1), F.col(hi1) - F.col(lo2))

    gx, gy = gap("a_x0", "a_x1", "b_x0", "b_x1"), gap("a_y0", "a_y1", "b_y0", "b_y1")
    sx_, sy_ = span("a_x0", "a_x1", "b_x0", "b_x1"), span("a_y0", "a_y1", "b_y0", "b_y1")
    pairs = pairs.withColumn("mind2", gx * gx + gy * gy).withColumn("maxd2", sx_ * sx_ + sy_ * sy_) \
        .where(F.col("mind2") <= F.lit(eps2)).transform(_cut)
    cell_pair = ["a_cx", "a_cy", "b_cx", "b_cy"]
    sure = pairs.where(F.col("maxd2") <= F.lit(eps2)).select(*cell_pair).distinct()
    amb = (pairs.where(F.col("maxd2") > F.lit(eps2)).join(sure, cell_pair, "left_anti")
           .select(F.col("a_sx").alias("a_kx"), F.col("a_sy").alias("a_ky"),
                   F.col("b_sx").alias("b_kx"), F.col("b_sy").alias("b_ky"), "a_n", "b_n", *cell_pair))
    # Straddling box pairs: the exact number of point pairs they would compare is
    # sum(a_n * b_n).  While it exceeds the budget, refine the boxes one level
    # (each halves the side): most pairs are then decided from boxes alone.
    core_lv = places.withColumn("k0x", F.col("sx")).withColumn("k0y", F.col("sy"))
    level = 0
    while True:
        left = amb.agg(F.sum(F.col("a_n") * F.col("b_n")).alias("work"), F.max(F.greatest("a_n", "b_n")).alias("most")).first()
        if (left["work"] or 0) <= pair_budget or left["most"] == 1:
            break
        lv = level + 1
        step = t / (2 ** lv)
        core_lv = (core_lv.withColumn(f"k{lv}x", F.floor(F.col("x") / F.lit(step)).cast("long"))
                   .withColumn(f"k{lv}y", F.floor(F.col("y") / F.lit(step)).cast("long"))).transform(_cut)
        boxes = (core_lv.groupBy(F.col(f"k{lv - 1}x").alias("px"), F.col(f"k{lv - 1}y").alias("py"),
                                 F.col(f"k{lv}x").alias("kx"), F.col(f"k{lv}y").alias("ky"))
                 .agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"),
                      F.max("y").alias("y1"), F.count("*").alias("n")))
        ba = boxes.select(*[F.col(c).alias(f"a_{c}") for c in boxes.columns])
        bb = boxes.select(*[F.col(c).alias(f"b_{c}") for c in boxes.columns])
        kids = (amb.drop("a_n", "b_n").withColumnRenamed("a_kx", "a_px").withColumnRenamed("a_ky", "a_py")
                .withColumnRenamed("b_kx", "b_px").withColumnRenamed("b_ky", "b_py")
                .join(ba, ["a_px", "a_py"]).join(bb, ["b_px", "b_py"]))
        kids = (kids.withColumn("mind2", gx * gx + gy * gy).withColumn("maxd2", sx_ * sx_ + sy_ * sy_)
                .where(F.col("mind2") <= F.lit(eps2)).transform(_cut))
        sure = sure.unionByName(kids.where(F.col("maxd2") <= F.lit(eps2)).select(*cell_pair)).distinct() \
            .transform(_cut)
        amb = (kids.where(F.col("maxd2") > F.lit(eps2)).join(sure, cell_pair, "left_anti")
               .select("a_kx", "a_ky", "b_kx", "b_ky", "a_n", "b_n", *cell_pair))
        level = lv
    ca = core_lv.select(F.col(f"k{level}x").alias("a_kx"), F.col(f"k{level}y").alias("a_ky"),
                        F.col("x").alias("ax"), F.col("y").alias("ay"))
    cb = core_lv.select(F.col(f"k{level}x").alias("b_kx"), F.col(f"k{level}y").alias("b_ky"),
                        F.col("x").alias("bx"), F.col("y").alias("by"))
    pd2 = (F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + \
          (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by"))
    checked = (amb.join(ca, ["a_kx", "a_ky"]).join(cb, ["b_kx", "b_ky"]).where(pd2 <= F.lit(eps2))
               .select(*cell_pair).distinct())
    edges = sure.unionByName(checked)

    # 4. components of the cell graph: label = smallest core order key in the component
    def key(cx, cy):  # one number per cell; where numbers of 32 bits do not reach, the pair itself
        if not packed:
            return F.struct(F.col(cx).alias("x"), F.col(cy).alias("y"))
        return F.shiftleft(F.col(cx), 32) + F.col(cy).bitwiseAND((1 << 32) - 1)

    components = connected_components(edges.select(key("a_cx", "a_cy").alias("src"), key("b_cx", "b_cy").alias("dst")))
    of_cell = (core.groupBy("cx", "cy").agg(F.min("ord").alias("ord")).withColumn("id", key("cx", "cy"))
               .join(components, "id", "left").withColumn("component", F.coalesce("component", "id")).transform(_cut))
    labels = of_cell.join(of_cell.groupBy("component").agg(F.min("ord").alias("lab")), "component").select("cx", "cy", "lab")
    comp = number_sorted(labels, "lab", "cluster").withColumn("cluster", F.col("cluster").cast("int"))
    cell_cluster = labels.join(comp, "lab").select("cx", "cy", "cluster").transform(_cut)
    cc = _maybe_broadcast(cell_cluster, n_cells)
    # dense cells: every row is core and takes its cell's cluster (no shuffle of the rows)
    dense = pts.where(F.col("n") >= min_samples).join(cc, ["cx", "cy"]).select("id", "cluster")
    # sparse cells: core rows take their cell's cluster, others the smallest adjacent core cluster
    core_lab = (pts.where(F.col("n") < min_samples).join(sparse_core, "id", "left_semi")
                .join(cc, ["cx", "cy"]).select("id", "cluster"))
    border = (border_pairs.join(core.select(F.col("id").alias("nid"), "cx", "cy"), "nid")
              .join(cc, ["cx", "cy"])
              .groupBy(F.col("pid").alias("id")).agg(F.min("cluster").alias("bcluster")))
    sparse = (pts.where(F.col("n") < min_samples).select("id")
              .join(core_lab, "id", "left").join(border, "id", "left")
              .select("id", F.coalesce("cluster", "bcluster", F.lit(-1)).cast("int").alias("cluster")))
    return dense.select("id", F.col("cluster").cast("int").alias("cluster")).unionByName(sparse) \
        .unionByName(rows.where(nowhere).select("id", F.lit(-1).alias("cluster"))).withColumnRenamed("id", id_col)
