"""Connected components by alternating large-star and small-star contraction.

Edges are rewritten until every vertex points at the least vertex of its
component.  A round is two minimum aggregations, each joined back to the edges:
no vertex's neighbours are ever gathered, so a hub is a skewed join key (which
Spark splits), not a large group.  The number of rounds is logarithmic in the
longest chain; each round is a written table of at most as many edges as before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blotter.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect every larger neighbour of a vertex to the least vertex around it."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
    return both.filter("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect a vertex and its smaller neighbours to the least of them (edges point downwards)."""
    least = edges.groupBy("src").agg(F.min("dst").alias("m"))
    joined = edges.join(least, "src")
    return joined.filter("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionByName(
        least.select("src", F.col("m").alias("dst")))


def _state(edges: DataFrame):
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Undirected edges -> (id, component): every vertex of an edge with the least vertex of its component.

    Self-loops, repeated edges and either direction are allowed; rows with a null end are ignored.  A vertex that
    only has self-loops does not appear.  Runs until nothing changes.
    """
    down = edges.select(F.greatest(F.col(src), F.col(dst)).alias("src"), F.least(F.col(src), F.col(dst)).alias("dst"),
                        (F.col(src).isNull() | F.col(dst).isNull()).alias("bad")).filter("not bad and src <> dst").drop("bad")
    now = materialize(down.distinct(), "components")
    before, state = None, _state(now)
    while state != before:
        now = materialize(_small_star(_large_star(now).distinct()).distinct(), "components")
        before, state = state, _state(now)
    return now.select(F.col("src").alias("id"), F.col("dst").alias("component")).unionByName(
        now.select(F.col("dst").alias("id"), F.col("dst").alias("component")).distinct())
