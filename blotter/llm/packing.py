"""Best-fit packing of token pieces after Martello-Toth dominance reduction.

Documents become pieces of at most ``capacity`` ids.  A piece's length decides
everything about packing, so the instance is the histogram of lengths: at most
``capacity`` numbers, whatever the corpus.  On it the driver

1. fixes sets of up to three pieces that provably dominate every other way of
   packing their largest piece (Martello and Toth's reduction procedure), many
   equal sets at once, until nothing can be fixed any more, and
2. packs the remainder best-fit decreasing, again many equal sequences at once.

The result is a list of patterns: how many sequences hold which lengths.  Spark
then gives every piece its number within its length (by scan task first, so no
task holds a length) and thereby its pattern slot: sequence and offset.  The ids
themselves are written once, where they were made, and never shuffled.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blotter.llm.common import binary_of, docs_of, map_slices, runs, step
from blotter.llm.tokens import ENCODE_BYTES, default_vocabulary, word_encoder

CAPACITY = 2048
Pattern = tuple[int, tuple[tuple[int, int], ...]]  # sequences, then (length, pieces) of each


# ---------------------------------------------------------------- the instance: a histogram of lengths


class _Lengths:
    """Counts by length with the neighbour queries that the reduction asks."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.n[length] += n

    def present(self) -> np.ndarray:
        return np.flatnonzero(self.n)

    def take(self, *lengths: int, times: int = 1) -> None:
        for x in lengths:
            self.n[x] -= times

    def least(self, k: int, above: int = 0) -> list[int]:
        """The k smallest pieces longer than ``above``, repeats included; shorter when there are fewer."""
        out: list[int] = []
        for x in np.flatnonzero(self.n[above + 1:]) + above + 1:
            out += [int(x)] * min(k - len(out), int(self.n[x]))
            if len(out) == k:
                break
        return out

    def largest(self, most: int) -> int:
        """The largest length up to ``most``, 0 if there is none."""
        at = np.flatnonzero(self.n[: max(0, most) + 1])
        return int(at[-1]) if len(at) else 0


def _times(left: _Lengths, *lengths: int) -> int:
    """How often the set can be taken from what is left."""
    return int(min(left.n[x] // k for x, k in Counter(lengths).items()))


def reduce_by_dominance(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Pattern], dict[int, int]]:
    """Fixed patterns and the remaining counts.

    For a piece j (longest first) with room r = capacity - j, a set is fixed if
    every feasible set with j can be exchanged for it:

    * nothing fits beside j: {j};
    * a piece fills r exactly, or no two pieces fit in r: {j, the largest that fits};
    * at most two fit in r, a is the largest that fits and b the largest beside it:
      {j, a, b} if a pair of pieces longer than b cannot fit in r either; and
      {j, largest} if that is at least as long as the longest fitting pair.

    Each condition stays true while pieces are taken away, so a set is fixed as
    often as its pieces last.  Passes go on until none fixes anything.
    """
    left, fixed = _Lengths(counts, capacity), []

    def fix(*lengths: int) -> bool:
        m = _times(left, *lengths)
        if not m:
            return False
        left.take(*lengths, times=m)
        fixed.append((m, tuple(sorted(Counter(lengths).items(), reverse=True))))
        return True

    def one(j: int) -> bool:
        """Fix one set (as often as it lasts) that holds j."""
        room = capacity - j
        left.n[j] -= 1  # j itself is not available beside j
        first, low = left.largest(room), left.least(3)
        low2, low3 = (sum(low[:k]) if len(low) >= k else capacity + 1 for k in (2, 3))
        second = best = 0
        if first and first != room and low2 <= room and low3 > room:  # one or two more pieces fit
            left.n[first] -= 1
            second = left.largest(room - first)
            left.n[first] += 1
            for x in left.present().tolist():
                if 2 * x > room:
                    break
                left.n[x] -= 1
                if y := left.largest(room - x):
                    best = max(best, x + y)
                left.n[x] += 1
        high = left.least(2, above=second) if second else []
        left.n[j] += 1
        if not first:
            return fix(j)
        if first == room or low2 > room:
            return fix(j, first)
        if low3 > room:
            if first >= best:
                return fix(j, first)
            if second and (len(high) < 2 or sum(high) > room):
                return fix(j, first, second)
        return False

    again = True
    while again:
        again = False
        for j in left.present()[::-1].tolist():
            while left.n[j] and one(j):
                again = True
    return fixed, {int(x): int(left.n[x]) for x in left.present()}


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Best-fit decreasing over counts: equal sequences are handled together.

    The piece goes to the fullest sequence that has room; after it that sequence is still the fullest while
    another such piece fits, so it takes as many as fit before the next sequence is looked at.
    """
    open_: dict[int, list[list]] = {}  # room -> [sequences, contents]
    rooms: list[int] = []

    def put(room: int, n: int, held: tuple) -> None:
        if n:
            if room not in open_:
                open_[room] = []
                at = np.searchsorted(rooms, room)
                rooms.insert(int(at), room)
            open_[room].append([n, held])

    for x in sorted(counts, reverse=True):
        n = counts[x]
        while n:
            at = int(np.searchsorted(rooms, x))
            if at == len(rooms):
                put(capacity, -(-n // (capacity // x)), ())
                continue
            room = rooms[at]
            group = open_[room]
            m, held = group.pop()
            if not group:
                del open_[room], rooms[at]
            k = min(room // x, n)
            full = min(m, n // k)
            put(room - k * x, full, (*held, (x, k)))
            n -= full * k
            if full < m:
                if rest := min(n, k - 1) if k > 1 else 0:
                    put(room - rest * x, 1, (*held, (x, rest)))
                    n -= rest
                    full += 1
                put(room, m - full, held)
    return [(n, held) for room in sorted(open_) for n, held in open_[room]]


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Pattern], int]:
    """All patterns, and how many of them (at the front) dominance fixed."""
    fixed, rest = reduce_by_dominance(counts, capacity)
    return fixed + best_fit_decreasing(rest, capacity), len(fixed)


@dataclass
class Slots:
    """For each length, runs of piece numbers and the sequences they go to (bounded by the patterns)."""

    length: np.ndarray  # sorted, with `first`
    first: np.ndarray  # first piece number of the run
    sequence: np.ndarray  # sequence of the run's first piece; each next piece goes to the next sequence
    offset: np.ndarray

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = self.length * (1 << 44) + self.first
        at = np.searchsorted(key, length * (1 << 44) + number, side="right") - 1
        return self.sequence[at] + number - self.first[at], self.offset[at]


def slots_of(patterns: list[Pattern]) -> Slots:
    taken: dict[int, int] = {}
    rows, base = [], 0
    for n, held in patterns:
        at = 0
        for length, k in held:
            for _ in range(k):
                first = taken.get(length, 0)
                rows.append((length, first, base, at))
                taken[length] = first + n
                at += length
        base += n
    rows.sort()
    return Slots(*(np.array(c, np.int64) for c in zip(*rows, strict=True))) if rows else Slots(*[np.zeros(0, np.int64)] * 4)


# ---------------------------------------------------------------- Spark


def cut_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY,
               end_id: int = 0) -> DataFrame:
    """(doc_id, text) -> written pieces: doc_id, piece, start, length, ids (binary, little-endian uint32), part, nth.

    A document's ids end with ``end_id``; only a longer document is cut.  ``part`` is the scan task and ``nth``
    the piece's number among the task's pieces of its length.  A null text counts as empty: one piece, [end_id].
    """
    path = vocabulary or default_vocabulary("word_bpe_49k.json")

    def make():
        from pyspark import TaskContext

        encoder, part, seen = word_encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)

        def work(batch):
            ids, at = encoder.encode(batch.column(1))
            n = np.diff(at) + 1
            ends = runs(n)
            flat = np.full(int(ends[-1]), end_id, "<u4")
            keep = np.ones(len(flat), bool)
            keep[ends[1:] - 1] = False
            flat[keep] = ids
            pieces = -(-n // capacity)
            first = runs(pieces)
            row = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(first[-1]) - first[:-1][row]
            start = piece * capacity
            length = np.minimum(capacity, n[row] - start)
            order = np.argsort(length, kind="stable")
            same = runs(np.bincount(length, minlength=capacity + 1))
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(length)) - same[length[order]]
            nth += seen[length]
            seen[:] += np.diff(same)
            return {"doc_id": batch.column(0).take(pa.array(row)), "piece": piece.astype(np.int32), "start": start,
                    "length": length, "ids": binary_of(flat, np.append(ends[:-1][row] + start, ends[-1])),
                    "part": np.full(len(row), part, np.int32), "nth": nth}
        return work

    out = map_slices(docs_of(docs), make, "doc_id long, piece int, start long, length long, ids binary, part int, nth long", size=ENCODE_BYTES)
    return step(out, "pieces")


def place(pieces: DataFrame, capacity: int = CAPACITY, digest=None) -> DataFrame:
    """Written pieces -> doc_id, piece, start, length, (digest columns,) sequence_id, offset.

    ``digest`` maps the pieces to the columns that are to be carried; by default the ids stay behind in the
    pieces table.
    """
    spark = pieces.sparkSession
    by_task = step(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    patterns, _ = plan_packing(counts, capacity)
    slots = spark.sparkContext.broadcast(slots_of(patterns))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    light = (digest or (lambda p: p.drop("ids")))(pieces)
    numbered = light.join(offsets, ["length", "part"]).withColumn("nth", F.col("nth") + F.col("before")).drop("before", "part")

    def run(batches):
        for b in batches:
            sequence, offset = slots.value.find(*(np.asarray(b.column(b.schema.get_field_index(c))) for c in ("length", "nth")))
            keep = [c for c in b.schema.names if c != "nth"]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in keep]
                                             + [pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema if f.name != "nth")
    return numbered.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def with_crc(pieces: DataFrame) -> DataFrame:
    """The ids' crc32 in place of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, text) -> doc_id, piece, start, length, ids_crc32, sequence_id, offset; a row per piece.

    Repeated rows and null ids are packed as documents of their own; an empty table gives no rows.
    """
    return place(cut_pieces(docs, vocabulary, capacity), capacity, with_crc).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id, ids (binary, little-endian uint32): written pieces put together, at most ``capacity`` ids each.

    Here the ids are moved, once, to their sequences; a sequence is a bounded group.
    """
    placed = place(pieces, capacity, lambda p: p)
    return placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p")).select(
        "sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> a || x.ids)").alias("ids"))
