"""Bounded groups in Arrow, many per task.

``applyInPandas`` calls Python once per group, which is dear for many small
groups.  Here rows are dealt and sorted by key and a task walks through its
groups in order.  The caller keeps groups small, by adding block numbers to the
key of a large one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def map_groups(df: DataFrame, keys: list[str], work: Callable[[pa.Table], pa.Table | None], schema: str) -> DataFrame:
    """``work`` gets each group of equal (integer) keys as a table and returns rows of ``schema`` or None."""

    def groups(table: pa.Table, edges: list[int]):
        for a, b in zip(edges, edges[1:], strict=False):
            out = work(table.slice(a, b - a))
            if out is not None and out.num_rows:
                yield from out.to_batches()

    def run(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            if not held.num_rows:
                continue
            key = np.stack([np.asarray(held.column(c)) for c in keys])
            edges = (np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist()
            if edges:
                yield from groups(held, [0, *edges])
                held = held.slice(edges[-1])
        if held is not None and held.num_rows:
            yield from groups(held, [0, held.num_rows])

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
