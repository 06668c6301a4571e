"""Global numbers 0, 1, 2, ... of sorted values without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blotter.session import materialize


def number_sorted(values: DataFrame, column: str, name: str = "number") -> DataFrame:
    """(column, name long): the place of every distinct non-null value in ascending order.

    Values are sorted in ranges, numbered within their range, and moved up by the sizes of the ranges before:
    one number per range reaches the driver.
    """
    ranged = values.select(column).filter(F.col(column).isNotNull()).distinct().repartitionByRange(column)
    placed = materialize(ranged.sortWithinPartitions(column).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    before, total = [], 0
    for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        before.append((r["part"], total))
        total += r["n"]
    if not before:
        return placed.select(column, F.col("_at").alias(name))
    offset: Column = F.element_at(F.map_from_entries(F.array(*[F.struct(F.lit(p), F.lit(n).cast("long")) for p, n in before])), part)
    return placed.select(column, (offset + place).alias(name))
