"""All pairs of two row blocks by matrix products, where one block is held and the other passes by.

|x - y|^2 = |x|^2 - 2xy + |y|^2 is one product of widened matrices, many times faster than differences, but it loses
digits where x and y are close.  ``slack`` bounds that loss, so that the caller can take the few close pairs from
differences.  ``stream_groups`` leads the rows that pass by through a task in batches: a task holds its own block and
a batch, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Held rows and passing rows that meet in one product; their squared distances stay in a core's cache.
HELD, PASSING = 256, 1_024
#: Least rows of a block worth a task.
LEAST = 256


def block_rows(n: int, most: int, parallelism: int) -> int:
    """Rows of a block: two blocks per core, so that what is sent grows with the rows, up to ``most`` rows."""
    return max(1, min(most, max(LEAST, -(-n // (2 * parallelism)))))


def held_side(v: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, squared norms) such that ``held_side(x)[0] @ passing_side(y)[0]`` are squared distances."""
    x = v - centre
    n = np.einsum("ij,ij->i", x, x)
    return np.hstack([-2 * x, n[:, None], np.ones((len(x), 1))]), n


def passing_side(v: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    y = v - centre
    n = np.einsum("ij,ij->i", y, y)
    return np.vstack([y.T, np.ones((1, len(y))), n[None, :]]), n


def slack(held_norms: np.ndarray, passing_norms: np.ndarray, dim: int) -> np.ndarray:
    """How far a squared distance by product can be off, per held row: rounding of a sum of dim + 2 products."""
    return (dim + 8) * 1e-15 * (held_norms + passing_norms.max(initial=0.0))


def pair_distances(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """|x[i] - y[j]| from differences, in memory-bounded pieces."""
    out = np.empty(len(i))
    step = max(1, 1_000_000 // max(1, x.shape[1]))
    for s in range(0, len(i), step):
        diff = x[i[s:s + step]] - y[j[s:s + step]]
        out[s:s + step] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
    return out


def stream_groups(df: DataFrame, group: str, groups: int, order: list[str], start: Callable, schema: str) -> DataFrame:
    """A task per group (``group`` is an int below ``groups``); its rows pass by in ``order``.

    ``start()`` gives an object whose ``add`` takes the group's next rows and whose ``end`` returns a table of ``schema``.
    """

    def run(batches):
        at, state = None, None
        for b in batches:
            if not b.num_rows:
                continue
            key = np.asarray(b.column(b.schema.get_field_index(group)))
            edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), b.num_rows]
            for s, e in zip(edges, edges[1:], strict=False):
                if key[s] != at:
                    if state is not None:
                        yield from state.end().to_batches()
                    at, state = key[s], start()
                state.add(b.slice(s, e - s))
        if state is not None:
            yield from state.end().to_batches()

    return df.repartitionById(groups, F.col(group)).sortWithinPartitions(group, *order).mapInArrow(run, schema)


def matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), -1) if len(column) else np.zeros((0, 0))
