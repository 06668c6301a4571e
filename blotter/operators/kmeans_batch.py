"""Many K-Means fits in the same passes over the data (K1-K3).

The reference fits K-Means ``n_init`` times for every k of a sweep (90 fits for k = 2..10).  Fitting them one by one
costs one scan of the points per Lloyd iteration per fit; here all (k, seed) restarts advance together, so a whole sweep
costs one scan per iteration:

* k-means|| seeding: after a first uniform row, each of ``ROUNDS`` passes draws ``OVERSAMPLE`` * k rows with a chance that
  grows with their squared distance from the candidates so far (an exponential race on a seeded hash of the id, the
  best keys per task, then over all), and one more pass weighs the candidates by the rows nearest to them.  All ks of a seed
  share its candidates.  The weighted candidates, some dozens, are then clustered: k-means++ with greedy local trials and Lloyd.
* Lloyd iterations: every task assigns its points to the nearest centre of every restart with one matrix product and emits
  per-(restart, centre) counts and sums; Spark sums them; the driver only sees sum(k) x d numbers per restart.
* A centre that loses all its rows moves to the row that is farthest from its own centre, as the reference's library does.
* Convergence as the reference: squared centre shift <= tol * mean feature variance; at most ``max_iter`` iterations; inertia
  from a final pass.

``seeding="farthest"`` starts from the row with the least id and adds the farthest row each time (ties: the least id): no chance
in it, so a sweep needs one fit for each k and any other tool can follow it; one pass per centre of the largest k.

A table of at most ``SMALL_VALUES`` numbers is shipped to the tasks instead, and each task runs whole fits: the same steps on the
same random numbers, without a job per step.  Larger tables are cached once (MEMORY_AND_DISK) for all passes.

Rows whose vector is null, of another length than most or holds a null, NaN or infinite entry take no part and have no
cluster.  With no rows at all there are no centres.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Passes of oversampled seeding, and candidates drawn in each, times k.
ROUNDS, OVERSAMPLE = 4, 2
#: Numbers (rows x dimension) up to which fits run whole inside tasks.
SMALL_VALUES = 4_000_000


def spread(df: DataFrame) -> DataFrame:
    """Give small inputs at least one partition per core; large inputs keep
    their scan partitioning (no shuffle)."""
    par = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(par) if df.rdd.getNumPartitions() < par else df


def usable(points: DataFrame) -> DataFrame:
    """(id long, v array<double>) of the rows that can take part."""
    pts = points.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    return pts.filter(F.col("v").isNotNull() & F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))))


def _stack(column) -> np.ndarray:
    """A list column's own buffer as a matrix."""
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _uniform(ids: np.ndarray, salt: int) -> np.ndarray:
    """Deterministic U(0,1) per (id, salt) from a 64-bit mix (splitmix64)."""
    golden = np.uint64(0x9E3779B97F4A7C15)
    z = ids.astype(np.uint64) + np.full(ids.shape, salt % (1 << 64), dtype=np.uint64) * golden
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


# ---------------------------------------------------------------- steps on rows


def _distances(X: np.ndarray, C: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre (ties: the lower) and the squared distance to it."""
    lab = (X @ C.T - (C ** 2).sum(axis=1) / 2).argmax(axis=1)
    return lab, ((X - C[lab]) ** 2).sum(axis=1)


def _race(ids: np.ndarray, X: np.ndarray, C: np.ndarray, seed: int, step: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, rows): the ``most`` largest keys, a weighted draw without replacement; uniform while there is no candidate."""
    u = np.log(_uniform(ids, seed * 1_000_003 + step))
    if len(C):
        _, d2 = _distances(X, C)
        with np.errstate(divide="ignore"):
            u = np.where(d2 > 1e-12 * max(1.0, float((X ** 2).sum(axis=1).max(initial=0))), u / d2, -np.inf)
    order = np.lexsort((ids, -u))[:most]
    order = order[np.isfinite(u[order])]
    return u[order], order


def _sums(X: np.ndarray, centres: list[np.ndarray]):
    """Per set of centres: (counts, sums, inertia); one matrix product for all."""
    stacked = np.vstack(centres)
    ends = np.cumsum([0] + [len(c) for c in centres])
    near = X @ stacked.T - (stacked ** 2).sum(axis=1) / 2  # largest where the distance is least
    for a, C in enumerate(centres):
        lab = near[:, ends[a]:ends[a + 1]].argmax(axis=1)
        one = np.zeros((len(X), len(C)))
        one[np.arange(len(X)), lab] = 1.0
        yield one.sum(axis=0), one.T @ X, float(((X - C[lab]) ** 2).sum())


class Rows:
    """All rows as arrays, inside one task or a test."""

    def __init__(self, ids: np.ndarray, X: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.X = ids[order], X[order]

    def first(self) -> np.ndarray:
        return self.X[0]

    def race(self, candidates: dict, step: int, most: dict) -> dict:
        return {s: self.X[_race(self.ids, self.X, C, s, step, most[s])[1]] for s, C in candidates.items()}

    def lloyd(self, centres: list, active: list) -> dict:
        out = dict.fromkeys(active)
        for r, got in zip(active, _sums(self.X, [centres[r] for r in active]), strict=True):
            out[r] = got
        return out

    def far(self, centres: list, most: dict) -> dict:
        """The ``most[r]`` rows farthest from their centres: (vector, number of that centre), farthest first."""
        out = {}
        for r, m in most.items():
            lab, d2 = _distances(self.X, centres[r])
            order = np.lexsort((self.ids, -d2))[:m]
            out[r] = [(self.X[i], int(lab[i])) for i in order if d2[i] > 0]
        return out


class Table:
    """The same steps as passes over a cached table (id, v); a step is one job."""

    def __init__(self, pts: DataFrame):
        self.pts = pts

    def _pass(self, value, work, schema: str) -> DataFrame:
        """``work(value, batches)`` in every task."""
        shared = self.pts.sparkSession.sparkContext.broadcast(value)

        def run(batches):
            yield from work(shared.value, (b for b in batches if b.num_rows))
        return self.pts.mapInArrow(run, schema)

    def _best(self, value, work) -> dict:
        """Rows (r, key, id, extra, v) from ``work``: per r those with the largest keys, most[r] of them."""
        most = value[-1]
        rows = self._pass(value, work, "r long, key double, id long, extra int, v array<double>")
        limit = F.element_at(F.create_map(*[F.lit(x) for r, m in most.items() for x in (int(r), int(m))]), F.col("r"))
        place = F.row_number().over(Window.partitionBy("r").orderBy(F.desc("key"), "id"))
        got = rows.withColumn("place", place).filter(F.col("place") <= max(most.values())).filter(F.col("place") <= limit)
        out: dict = {r: [] for r in most}
        for row in got.orderBy("r", "place").collect():  # a few dozen rows per restart
            out[row["r"]].append((np.array(row["v"]), row["extra"]))
        return out

    def first(self) -> np.ndarray:
        return np.array(self.pts.orderBy("id").select("v").first()["v"], float)

    def race(self, candidates: dict, step: int, most: dict) -> dict:
        def work(value, batches):
            cand, step, most = value
            for b in batches:
                ids, X = np.asarray(b.column(0)), _stack(b.column(1))
                for s, C in cand.items():
                    key, rows = _race(ids, X, C, s, step, most[s])
                    yield _rows(s, key, ids[rows], np.zeros(len(rows), np.int32), X[rows])

        got = self._best((candidates, step, most), work)
        dim = next(iter(candidates.values())).shape[1]
        return {s: np.array([v for v, _ in rows]).reshape(-1, dim) for s, rows in got.items()}

    def far(self, centres: list, most: dict) -> dict:
        def work(value, batches):
            cs, most = value
            for b in batches:
                ids, X = np.asarray(b.column(0)), _stack(b.column(1))
                for r, m in most.items():
                    lab, d2 = _distances(X, cs[r])
                    rows = np.lexsort((ids, -d2))[:m]
                    rows = rows[d2[rows] > 0]
                    yield _rows(r, d2[rows], ids[rows], lab[rows].astype(np.int32), X[rows])

        return self._best(({r: centres[r] for r in most}, most), work)

    def lloyd(self, centres: list, active: list) -> dict:
        def work(value, batches):
            cs, act = value
            acc = [[np.zeros(len(c)), np.zeros_like(c), 0.0] for c in cs]
            for b in batches:
                for a, (n, s, inertia) in zip(acc, _sums(_stack(b.column(1)), cs), strict=True):
                    a[0] += n
                    a[1] += s
                    a[2] += inertia
            rows = [(r, j, float(n[j]), s[j].tolist(), inertia if j == 0 else 0.0)
                    for r, (n, s, inertia) in zip(act, acc, strict=True) for j in range(len(n))]
            kinds = (pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds)], ["r", "j", "n", "s", "inertia"])

        agg = (self._pass(([centres[r] for r in active], active), work, "r int, j int, n double, s array<double>, inertia double")
               .withColumn("sv", array_to_vector("s"))
               .groupBy("r", "j")
               .agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"),
                    vector_to_array(Summarizer.sum(F.col("sv"))).alias("s"))
               .collect())
        out = {r: [np.zeros(len(centres[r])), np.zeros_like(centres[r]), 0.0] for r in active}
        for row in agg:
            o = out[row["r"]]
            o[0][row["j"]], o[1][row["j"]] = row["n"], row["s"]
            o[2] += row["inertia"]
        return out


def _rows(r, key, ids, extra, X) -> pa.RecordBatch:
    v = pa.ListArray.from_arrays(pa.array(np.arange(len(X) + 1, dtype=np.int32) * X.shape[1]), pa.array(X.ravel(), pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), r), pa.int64()), pa.array(key, pa.float64()), pa.array(ids, pa.int64()),
                                       pa.array(extra, pa.int32()), v], ["r", "key", "id", "extra", "v"])


# ---------------------------------------------------------------- seeding


def recluster(C: np.ndarray, w: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k centres of weighted candidates: k-means++ with 2 + log k trials per centre, then Lloyd on the candidates."""
    rng = np.random.default_rng(seed)
    centres = C[[rng.choice(len(C), p=w / w.sum())]]
    d2 = ((C - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k:
        mass = np.cumsum(d2 * w)
        if mass[-1] <= 0:  # fewer distinct candidates than k
            centres = np.vstack([centres, centres[-1:]])
            continue
        trial = np.minimum(np.searchsorted(mass, rng.random(2 + int(np.log(k))) * mass[-1]), len(C) - 1)
        closer = np.minimum(d2, ((C[trial][:, None, :] - C[None, :, :]) ** 2).sum(axis=2))
        best = int((closer @ w).argmin())
        centres, d2 = np.vstack([centres, C[trial[best]][None, :]]), closer[best]
    for _ in range(50):
        lab, _ = _distances(C, centres)
        one = (lab[:, None] == np.arange(k)) * w[:, None]
        n = one.sum(axis=0)
        new = np.where(n[:, None] > 0, one.T @ C / np.maximum(n, 1e-300)[:, None], centres)
        if np.array_equal(new, centres):
            break
        centres = new
    return centres


def farthest_first(source, specs: list[tuple[int, int]]) -> list[np.ndarray]:
    """Starting centres of every (k, seed): the first k of one sequence; rows that are all used up repeat the last."""
    C = source.first()[None, :]
    while len(C) < max(k for k, _ in specs):
        got = source.far([C], {0: 1}).get(0)
        C = np.vstack([C, got[0][0][None, :] if got else C[-1:]])
    return [C[:k].copy() for k, _ in specs]


def seed_centres(source, specs: list[tuple[int, int]], dim: int, seeding: str = "oversampled") -> list[np.ndarray]:
    """Starting centres of every (k, seed): k-means|| in ROUNDS + 2 passes for all of them, or ``farthest``."""
    if seeding == "farthest":
        return farthest_first(source, specs)
    most: dict[int, int] = {}
    for k, seed in specs:
        most[seed] = max(most.get(seed, 0), k)
    candidates = {s: np.zeros((0, dim)) for s in most}
    for step in range(ROUNDS + 1):
        drawn = source.race(candidates, step, {s: OVERSAMPLE * k if step else 1 for s, k in most.items()})
        candidates = {s: np.vstack([C, drawn[s]]) for s, C in candidates.items()}
    order = list(candidates)
    weights = source.lloyd([candidates[s] for s in order], list(range(len(order))))
    weight = {s: weights[i][0] for i, s in enumerate(order)}
    return [recluster(candidates[seed], weight[seed], k, seed) for k, seed in specs]


# ---------------------------------------------------------------- fits


def moved(source, centres: list, result: dict) -> dict:
    """New centres of every restart in ``result`` (counts, sums, inertia); empty ones go to the farthest rows."""
    empty = {r: int((n == 0).sum()) for r, (n, _, _) in result.items()}
    far = source.far(centres, {r: m for r, m in empty.items() if m}) if any(empty.values()) else {}
    out = {}
    for r, (n, s, _) in result.items():
        n, s = n.copy(), s.copy()
        for j, (row, donor) in zip(np.flatnonzero(n == 0).tolist(), far.get(r, []), strict=False):
            if n[donor] > 1:
                n[donor] -= 1
                s[donor] -= row
                n[j], s[j] = 1, row
        out[r] = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], centres[r])
    return out


def fit_source(source, specs: list[tuple[int, int]], dim: int, tol_abs: float, max_iter: int, seeding: str = "oversampled") -> dict:
    """{spec: (centres, inertia, iterations, converged)} of all restarts, advancing together."""
    centres = seed_centres(source, specs, dim, seeding)
    iters, active = [0] * len(specs), list(range(len(specs)))
    for _ in range(max_iter):
        if not active:
            break
        new = moved(source, centres, source.lloyd(centres, active))
        still = []
        for r in active:
            shift = float(((new[r] - centres[r]) ** 2).sum())
            centres[r] = new[r]
            iters[r] += 1
            if shift > tol_abs:
                still.append(r)
        active = still
    final = source.lloyd(centres, list(range(len(specs))))
    return {spec: (centres[r], float(final[r][2]), iters[r], r not in active) for r, spec in enumerate(specs)}


def lloyd(points: DataFrame, centres: np.ndarray, iterations: int) -> np.ndarray:
    """Centres after so many Lloyd iterations from given ones; an empty cluster keeps its centre."""
    source, centres = Table(usable(points)), np.array(centres, dtype=float)
    for _ in range(iterations):
        n, s, _ = source.lloyd([centres], [0])[0]
        centres = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], centres)
    return centres


def _fit_in_tasks(pts: DataFrame, specs, dim: int, tol_abs: float, max_iter: int, seeding: str) -> dict:
    """Whole fits inside tasks, a seed each; the rows are broadcast (SMALL_VALUES numbers at most)."""
    spark = pts.sparkSession
    got = pts.toArrow()
    shared = spark.sparkContext.broadcast((np.asarray(got.column(0).combine_chunks()), _stack(got.column(1).combine_chunks())))

    def run(batches):
        for b in batches:
            for seed in b.column(0).to_pylist():
                mine = [s for s in specs if s[1] == seed]
                fits = fit_source(Rows(*shared.value), mine, dim, tol_abs, max_iter, seeding)
                rows = [(k, seed, c.ravel().tolist(), inertia, n, done) for (k, _), (c, inertia, n, done) in fits.items()]
                kinds = (pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.int32(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds)],
                                                 ["k", "seed", "c", "inertia", "iterations", "done"])

    seeds = sorted({s for _, s in specs})
    jobs = spark.createDataFrame([(s,) for s in seeds], "seed long").repartition(len(seeds), "seed")
    rows = jobs.mapInArrow(run, "k int, seed long, c array<double>, inertia double, iterations int, done boolean").collect()
    shared.destroy()
    return {(r["k"], r["seed"]): (np.array(r["c"]).reshape(r["k"], dim), r["inertia"], r["iterations"], r["done"]) for r in rows}


def fit_many(points: DataFrame, specs: list[tuple[int, int]], max_iter: int = 300, tol: float = 1e-4,
             seeding: str = "oversampled"):
    """Fit K-Means for every (k, seed) in ``specs`` over (id, v) points.

    Returns {(k, seed): (centres ndarray k x d, inertia, iterations, converged)}; a fit that still moves after
    ``max_iter`` iterations is not converged, as the reference's would not be.  Of no rows there are no centres.
    """
    if seeding not in ("oversampled", "farthest"):
        raise ValueError(f"unknown seeding: {seeding}")
    pts = usable(points)
    first = pts.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if first is None or not first["d"]:
        return {spec: (np.zeros((0, 0)), 0.0, 0, True) for spec in specs}
    dim, pts = first["d"], pts.filter(F.size("v") == first["d"])
    small = first["count"] * dim <= SMALL_VALUES
    if not small:
        pts = spread(pts).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        var = pts.select(*[F.var_pop(F.col("v")[i]).alias(f"v{i}") for i in range(dim)]).first()
        tol_abs = tol * float(np.mean([x or 0.0 for x in var]))
        if small:
            return _fit_in_tasks(pts, specs, dim, tol_abs, max_iter, seeding)
        return fit_source(Table(pts), specs, dim, tol_abs, max_iter, seeding)
    finally:
        if not small:
            pts.unpersist()


def nearest_centre(vector: Column, centres: np.ndarray) -> Column:
    """Number of the nearest centre (ties: lower index) as an expression over an array column; null without a vector or centre."""
    if not len(centres):
        return F.lit(None).cast("long")

    def distance(c):
        return F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(x)) for x in c]), lambda a, b: (a - b) * (a - b)),
                           F.lit(0.0), lambda acc, d: acc + d)

    d = F.array(*[distance(c) for c in np.asarray(centres, dtype=float)])
    return (F.array_position(d, F.array_min(d)) - 1).cast("long")


def assign(points: DataFrame, centres: np.ndarray, out_col: str = "cluster", vec_col: str = "v") -> DataFrame:
    """``points`` with all columns and the number of the nearest centre; no shuffle, no Python."""
    return points.withColumn(out_col, nearest_centre(F.col(vec_col).cast("array<double>"), centres))
