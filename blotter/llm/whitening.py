"""Embedding whitening with MLlib block matrices.

Entries become integers, floor(``SCALE`` * c) + ``SHIFT``; sums and deviations are exact.  Rows get numbers
0, 1, 2, ... and, centred, form an ``IndexedRowMatrix``, which is cut into distributed blocks.  The transposed
block matrix times itself is the scatter matrix; its products are summed over ``splits`` of the rows, so that no
task sees more than a few blocks.  Only that matrix, dimension x dimension, reaches the driver, which takes its
eigenvectors; the block matrix times the whitening matrix projects every row.

Odd tables: a row whose vector is null, or holds a null, NaN or infinite entry, has no result.  Vectors should have
one length; where they differ, the commonest length (the longest of equally common ones) is the dimension and
rows of another length have no result either.  Repeated rows and repeated or null ids are rows of their own.  A
component without variance cannot be scaled: ``whitened`` is null there, and ``identity_error`` covers the others
(null if there are none).  ``deviation`` is null where it exceeds a long.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blotter.llm.common import pick, step

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Rows and columns of a block; row blocks multiplied in one task.
BLOCK, PER_TASK = 1024, 4
#: Eigenvalues below this share of the largest one count as none.
LEAST = 1e-12
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integers(rows: DataFrame) -> DataFrame:
    """(vec_id long, x array<long>) of the usable rows, of one length."""
    v = pick(rows, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"),
                                                 F.col("embedding").cast("array<double>").alias("v"))
    fine = v.filter(F.col("v").isNotNull() & F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))))
    x = fine.select("vec_id", F.transform("v", lambda c: F.floor(F.least(F.greatest(c * SCALE, F.lit(-2.0**61)), F.lit(2.0**61))) + SHIFT).alias("x"))
    lengths = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return x.filter(F.size("x") == (lengths["d"] if lengths else 0))


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows``, written, with ``name``: 0, 1, 2, ...; one count per written part reaches the driver."""
    placed = step(rows.withColumn("_at", F.monotonically_increasing_id()), "whitening-rows")
    part = F.shiftright("_at", 33)
    begin, at = [], 0
    for r in placed.groupBy(part.alias("p")).count().orderBy("p").collect():
        begin.append((r["p"], at))
        at += r["count"]
    starts = rows.sparkSession.createDataFrame(begin, "p long, begin long")  # a row per task of the step before
    return placed.join(F.broadcast(starts), part == F.col("p")).withColumn(
        name, F.col("begin") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "p", "begin")


def _matrix(rows: DataFrame, n: int, width: int) -> IndexedRowMatrix:
    """Distributed rows from (index long, v array<double>)."""
    vectors = rows.select("index", array_to_vector("v").alias("vector"))
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector"), n, width)


def _product(left: BlockMatrix, right: BlockMatrix, splits: int = 1) -> BlockMatrix:
    """left x right; the inner dimension is dealt into ``splits`` groups whose products are then summed."""
    java = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, left.rowsPerBlock, right.colsPerBlock)


def eigen(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors in columns, the largest entry of each positive."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    return values, vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))] < 0, -1.0, 1.0)


def whiten(rows: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """``SCHEMA``: a row per usable row and component, up to ``most`` components by falling variance."""
    spark = rows.sparkSession
    data = numbered(integers(rows), "index")
    totals = data.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(
        F.count("*").alias("n"), F.sum(F.col("c").cast("decimal(20,0)")).alias("s"), F.min("c").alias("lo"), F.max("c").alias("hi")
    ).orderBy("i").collect()  # a row per dimension
    if not totals:
        return spark.createDataFrame([], SCHEMA)
    n, width, sums = totals[0]["n"], len(totals), [int(r["s"]) for r in totals]
    far = max(max(abs(n * r["lo"] - int(r["s"])), abs(n * r["hi"] - int(r["s"]))) for r in totals)
    exact = max(far, *(n * max(abs(r["lo"]), abs(r["hi"])) for r in totals)) < 2**63
    if exact:
        centred = F.zip_with("x", F.array(*[F.lit(s).cast("long") for s in sums]), lambda c, s: c * n - s)
        data = data.withColumn("c", centred)
        v = F.transform("c", lambda c: c.cast("double") / n)
    else:
        v = F.zip_with("x", F.array(*[F.lit(s / n) for s in sums]), lambda c, m: c.cast("double") - m)
    squares = F.aggregate("c", F.lit(0).cast("long"), lambda a, c: a + c * c) if width * far * far < 2**63 else F.lit(None).cast("long")

    blocks = _matrix(data.select("index", v.alias("v")), n, width).toBlockMatrix(BLOCK, BLOCK)
    blocks.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        scatter = _product(blocks.transpose(), blocks, -(-n // (BLOCK * PER_TASK))).toLocalMatrix().toArray()
        covariance = (scatter + scatter.T) / (2 * n)
        trace = float(np.trace(covariance))
        values, vectors = eigen(covariance)
        k = min(most, width)
        has = values[:k] > LEAST * max(values[0], 0.0)
        scale = np.where(has, 1 / np.sqrt(np.where(has, values[:k], 1.0)), 0.0)
        whitening = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(vectors[:, :k] * scale)], "index long, v array<double>")
        projected = _product(blocks, _matrix(whitening, width, k).toBlockMatrix(BLOCK, BLOCK)).toIndexedRowMatrix()
        found = callMLlibFunc("getIndexedRows", projected._java_matrix_wrapper._java_model)
        found = step(found.select("index", vector_to_array("vector").alias("w")), "whitened")
    finally:
        blocks._java_matrix_wrapper._java_model.blocks().unpersist(False)
    error = identity_error(found, has)
    share = [max(0.0, float(e)) / trace if trace > 0 else None for e in values[:k]]
    out = data.select("index", "vec_id", squares.alias("deviation")).join(found, "index").select(
        "vec_id", "deviation", F.posexplode(F.slice("w", 1, k)).alias("at", "value"))
    pick_one = lambda xs, kind: F.array(*[F.lit(x).cast(kind) for x in xs])[F.col("at")]
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
                      F.when(pick_one(has.tolist(), "boolean"), F.col("value")).alias("whitened"),
                      pick_one(share, "double").alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def identity_error(found: DataFrame, has: np.ndarray) -> float | None:
    """Largest absolute entry of (covariance of ``w`` - identity) over the components with variance."""
    used = np.flatnonzero(has).tolist()
    if not used:
        return None
    mean = found.agg(*[F.avg(F.col("w")[i]).alias(f"m{i}") for i in used]).first()
    centre = {i: F.col("w")[i] - F.lit(mean[f"m{i}"]) for i in used}
    pairs = [(i, j) for i in used for j in used if i <= j]
    cov = found.agg(*[F.avg(centre[i] * centre[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(cov[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
