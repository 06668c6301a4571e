"""blotter — incident analytics on Spark.

Operators take DataFrames plus column names and return DataFrames.  The
heavy lifting is Spark SQL / Spark ML; Python only drives short loops of
Spark jobs (k sweeps, iterative label propagation) and, where a bounded
sample must be compared against itself, Arrow-batched numpy inside tasks.
"""

from blotter.session import get_spark, scratch_dir, ensure_checkpoint_dir

__all__ = ["get_spark", "scratch_dir", "ensure_checkpoint_dir"]
