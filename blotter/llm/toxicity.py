"""Toxicity by the nearest labelled examples.

Terms are lower-cased letter runs and their prefixes.  From the labelled rows
that may be learned from, Spark counts how many documents of each label hold a
term; terms that toxic documents hold significantly more often are telling ones.
Labelled documents become unit TF-IDF vectors over all their words, to which the
telling terms are added as coordinates of their own, so that these weigh more.
Words that no example holds count in the length of a vector.  The index scores a chunk of texts
at once: the ``HEAD`` most frequent terms by one dense product, all others by postings
in blocks of ``BLOCK`` examples with each block's largest weight, of which only
those blocks are read whose bound reaches the k-th best score.  Neighbours are exact, in double precision; all
examples that tie with the k-th vote too.  Neighbours vote with weight 1 / (distance + ``SOFT``), shrunk towards
the share of toxic documents among examples without a telling term; an isotonic
fit on the examples themselves (each left out of its own neighbours) makes the
vote a probability.
Neighbours are returned as evidence.

Bounds, all parameters of the fit: at most ``MAX_EXAMPLES`` labelled rows are
learned from (those with the least hash of their id), at most ``MAX_TERMS``
terms are telling; words and postings are all those of the examples.  Scoring covers every whole text.  Only the fitted
model, bounded by these, is broadcast.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blotter.llm.common import crc_mod3, docs_of, drop_rows, keyed_docs, map_slices, pick, release, step, verdict

MAX_EXAMPLES, MAX_TERMS = 6_000, 4_096
#: Least documents with a term, and least log-likelihood ratio of its counts by label.
LEAST_DOCS, LEAST_RATIO = 3, 15.0
PREFIXES = (4, 5, 6)
#: Examples of a block; terms of the dense part; queries scored at once; what single precision may be off by.
BLOCK, HEAD, CHUNK, MARGIN = 16, 1024, 256, 1e-4
NEIGHBOURS, SOFT, PRIOR_VOTES = 15, 0.1, 1.0
LIMIT = 0.7
LETTERS = re.compile(r"[^\W\d_]+")
#: Words whose terms a task remembers; no effect on scores.
MEMO = 150_000


def terms_of(word: str) -> list[str]:
    """The word and its proper prefixes; a prefix ends with a star."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


# ---------------------------------------------------------------- index


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... of each range, one range after another."""
    ends = np.cumsum(size, dtype=np.int32)
    return np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)


class BlockMaxIndex:
    """Exact top-k by dot product over sparse vectors with non-negative weights, for many queries at once.

    The ``HEAD`` terms that most examples hold are columns of a dense matrix: one product scores all queries of a
    chunk against all examples on them, in single precision.  All other terms have postings in blocks of ``BLOCK``
    examples with the largest weight of each block.  A block is read for a query only if its best head score plus the
    bound of its other terms can reach the k-th best head score; examples that can be among the k best are then scored
    anew in double precision from their whole vectors.
    """

    def __init__(self, vectors: list, n_terms: int):
        """``vectors`` are lists of (term, weight), or pairs of arrays."""
        pairs = [v if isinstance(v, tuple) else tuple(np.array(v).reshape(-1, 2).T) for v in vectors]
        size = np.array([len(t) for t, _ in pairs], np.int64)
        self.count, self.blocks = len(pairs), -(-len(pairs) // BLOCK)
        self.n_terms = n_terms
        # whole vectors, for exact scores
        self.begin = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        self.term = np.concatenate([t for t, _ in pairs]).astype(np.int32, copy=False) if pairs else np.zeros(0, np.int32)
        self.exact = np.concatenate([w for _, w in pairs]).astype(float, copy=False) if pairs else np.zeros(0)
        self.look = None

    def _build(self) -> None:
        """The dense part and the postings, several times the vectors' size: made by the process that searches."""
        example = np.repeat(np.arange(self.count, dtype=np.int32), np.diff(self.begin))
        held = np.bincount(self.term, minlength=self.n_terms)
        frequent = np.sort(np.argsort(-held, kind="stable")[:HEAD])
        self.column = np.full(self.n_terms, -1, np.int32)
        self.column[frequent] = np.arange(len(frequent))
        column = self.column[self.term]
        head = column >= 0
        self.head = np.zeros((len(frequent), self.blocks * BLOCK), np.float32)
        self.head[column[head], example[head]] = self.exact[head]
        # postings of the other terms; only cells (term, block) with postings are kept
        term, example, weight = self.term[~head].astype(np.int64), example[~head], self.exact[~head].astype(np.float32)
        order = np.lexsort((example, term))
        example, self.weight, term = example[order], weight[order], term[order]
        self.slot = (example % BLOCK).astype(np.uint8)
        cell, begin = np.unique(term * max(1, self.blocks) + example // BLOCK, return_index=True)
        self.at = np.append(begin, len(term)).astype(np.int32)
        self.block = (cell % max(1, self.blocks)).astype(np.int32)
        self.top = np.maximum.reduceat(self.weight, begin) if len(begin) else np.zeros(0, np.float32)
        self.first = np.searchsorted(cell // max(1, self.blocks), np.arange(self.n_terms + 1)).astype(np.int32)
        self.look = np.zeros(self.n_terms)

    def __getstate__(self):
        """The vectors alone, whatever this process has built from them."""
        return {k: getattr(self, k) for k in ("count", "blocks", "n_terms", "begin", "term", "exact")} | {"look": None}

    def search(self, queries: list, k: int, without: list | None = None, ties: bool = False) -> list[list[tuple[float, int]]]:
        """For each (terms, weights) the k best (score, example) with a positive score, best first; of equal scores at the end
        some are left out, or with ``ties`` all are given.  ``without`` names an example per query that is passed over."""
        out = []
        for at in range(0, len(queries), CHUNK):
            out += self._chunk(queries[at:at + CHUNK], k, without[at:at + CHUNK] if without else None, ties)
        return out

    def _chunk(self, queries, k, without, ties):
        width = self.blocks * BLOCK
        if not width:
            return [[] for _ in queries]
        if self.look is None:
            self._build()
            release()
        dense = np.zeros((len(queries), len(self.head)), np.float32)
        for r, (t, w) in enumerate(queries):
            column = self.column[t]
            dense[r, column[column >= 0]] = w[column >= 0]
        scores = dense @ self.head
        if without:
            scores[np.arange(len(queries)), without] = -1.0
        best = max(0, width - k)
        least = np.partition(scores, best, axis=1)[:, best]
        tops = scores.reshape(len(queries), self.blocks, BLOCK).max(axis=2)
        return [self._finish(scores[r], tops[r], least[r], *queries[r], k, without[r] if without else -1, ties) for r in range(len(queries))]

    def _finish(self, row, tops, least, terms, weights, k, without, ties):
        rare = self.column[terms] < 0
        size = self.first[terms[rare] + 1] - self.first[terms[rare]]
        cells, weight = _ranges(self.first[terms[rare]], size), np.repeat(weights[rare], size)
        place = self.block[cells]
        bound = tops + np.bincount(place, weight * self.top[cells], self.blocks)
        live = np.flatnonzero((bound >= least - MARGIN)[place])  # no other block can hold one of the k best
        begin, size = self.at[cells[live]], self.at[cells[live] + 1] - self.at[cells[live]]
        posting = _ranges(begin, size)
        row = row + np.bincount(np.repeat(place[live] * BLOCK, size) + self.slot[posting],
                                np.repeat(weight[live], size) * self.weight[posting], len(row))
        if without >= 0:
            row[without] = -1.0
        best = max(0, len(row) - k)
        who = np.flatnonzero((row >= np.partition(row, best)[best] - MARGIN) & (row > 0))
        if not len(who):
            return []
        self.look[terms] = weights
        size = self.begin[who + 1] - self.begin[who]
        at = _ranges(self.begin[who].astype(np.int32), size)
        got = np.add.reduceat(self.look[self.term[at]] * self.exact[at], np.cumsum(size) - size)
        self.look[terms] = 0.0
        order = np.lexsort((who, -got))
        order = order[got[order] > 0]
        if len(order) > k:
            most = int(np.searchsorted(-got[order], -(got[order[k - 1]] - 1e-9), side="right")) if ties else k
            order = order[:most]
        return list(zip(np.minimum(got[order], 1.0).tolist(), who[order].tolist(), strict=True))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (least x of each pool, mean y of each pool)."""
    pools: list[list[float]] = []  # weight, mean, first x
    for v, t in sorted(zip(x.tolist(), y.tolist(), strict=True)):
        if pools and pools[-1][2] == v:
            w, m, f = pools.pop()
            pools.append([w + 1, (m * w + t) / (w + 1), f])
        else:
            pools.append([1.0, float(t), v])
    out: list[list[float]] = []
    for p in pools:
        out.append(p)
        while len(out) > 1 and out[-2][1] >= out[-1][1]:
            w, m, _ = out.pop()
            out[-1] = [out[-1][0] + w, (out[-1][1] * out[-1][0] + m * w) / (out[-1][0] + w), out[-1][2]]
    return np.array([p[2] for p in out]), np.array([p[1] for p in out])


@dataclass
class Model:
    """The fitted model; bounded by the texts of MAX_EXAMPLES examples and MAX_TERMS."""

    terms: dict[str, int]  # telling terms
    words: dict[str, int]  # all words of the examples, numbered after them
    idf: np.ndarray  # of terms, words, and at last of words that no example holds
    index: BlockMaxIndex | None
    doc_id: np.ndarray
    toxic: np.ndarray
    base: float  # share of toxic documents among examples without a telling term
    curve: tuple[np.ndarray, np.ndarray]
    shared: tuple = ()  # broadcasts of the vocabulary and of (index, doc_id, toxic)

    def ship(self):
        """A function that gives the model in a task; each part is broadcast once, whatever the number of stages."""
        (blank, rest), base, curve = self.shared, self.base, self.curve

        def get() -> Model:
            v = blank.value
            return Model(v.terms, v.words, v.idf, *rest.value, base, curve)
        return get

    def vector(self, words: Counter, memo: dict) -> tuple[np.ndarray, np.ndarray]:
        """Known terms in order and their TF-IDF weights; of length 1 together with unknown words."""
        count: dict[int, int] = {}
        unknown = []
        for w, n in words.items():
            if (known := memo.get(w)) is None:
                known = memo[w] = (self.words.get(w, -1), tuple(i for t in terms_of(w) if (i := self.terms.get(t)) is not None))
            if known[0] < 0:
                unknown.append(n)
            else:
                count[known[0]] = n
            for t in known[1]:
                count[t] = count.get(t, 0) + n
        if not count:
            return np.zeros(0, np.int64), np.zeros(0)
        terms = np.array(sorted(count), np.int64)
        w = (1 + np.log([count[t] for t in terms.tolist()])) * self.idf[terms]
        other = (1 + np.log(np.array(unknown, float))) * self.idf[-1]
        return terms, w / np.sqrt(w @ w + other @ other)

    def vote(self, near: list[tuple[float, int]]) -> float:
        if not near:
            return -1.0
        w = np.array([1 / (1 - s + SOFT) for s, _ in near])
        y = self.toxic[[i for _, i in near]]
        return float((w @ y + PRIOR_VOTES * self.base) / (w.sum() + PRIOR_VOTES))

    def score(self, near: list[tuple[float, int]]) -> float:
        """Probability of label 1."""
        vote = self.vote(near)
        x, y = self.curve
        if vote < 0 or not len(x):
            return self.base if vote < 0 else vote
        # what the examples with such votes were; a share of the vote itself keeps its order within equal steps
        return float(np.clip(0.2 * vote + 0.8 * np.interp(vote, x, y), 0.0, 1.0))


# ---------------------------------------------------------------- fit


def examples(docs: DataFrame, labels: DataFrame, most: int = MAX_EXAMPLES) -> DataFrame:
    """doc_id, text, toxic of the labelled rows that may be learned from, at most ``most``.

    An id with several labels is toxic if at least half of them are 1; of several texts the first is taken.
    Rows without an id or a label are not labelled.
    """
    known = (pick(labels, "doc_id", "toxic").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
             .filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
             .filter(crc_mod3("doc_id") != 1).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    return step(docs_of(docs).join(F.broadcast(known), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
                .select("doc_id", "text", "toxic"), "examples")


def term_counts(rows: DataFrame) -> DataFrame:
    """term, toxic documents with it, other documents with it; counted in the scan task first."""

    def run(batches):
        held = (Counter(), Counter())
        for b in batches:
            for text, toxic in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                held[1 - toxic].update({t for w in set(LETTERS.findall(text.lower())) for t in terms_of(w)})
            if len(held[0]) + len(held[1]) > 1_000_000:
                yield flush(held)
                held = (Counter(), Counter())
        yield flush(held)

    def flush(held):
        terms = list(held[0].keys() | held[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([h[t] for t in terms], pa.int64()) for h in held)],
                                          ["term", "n1", "n0"])

    return rows.mapInArrow(run, "term string, n1 long, n0 long").groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_EXAMPLES) -> Model:
    """The model; with no toxic or no other example it scores by the share of toxic labels alone."""
    rows = examples(docs, labels, most)
    total = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = total.get(1, 0), total.get(0, 0)

    def part(a, of_all, share):  # one cell of the log-likelihood ratio
        return F.when(a > 0, a * F.log(a / (of_all * share))).otherwise(0.0)

    counts = step(term_counts(rows).withColumn("df", F.col("n1") + F.col("n0")), "terms")
    t = counts.filter(F.col("df") >= LEAST_DOCS)
    share = F.col("df") / F.lit(float(max(1, n1 + n0)))
    ratio = 2 * (part(F.col("n1"), F.lit(float(n1)), share) + part(F.col("n0"), F.lit(float(n0)), share)
                 + part(n1 - F.col("n1"), F.lit(float(n1)), 1 - share) + part(n0 - F.col("n0"), F.lit(float(n0)), 1 - share))
    more = F.col("n1") * F.lit(float(n0)) > 2 * F.col("n0") * F.lit(float(n1))
    chosen = (t.withColumn("ratio", ratio).filter(more & (F.col("ratio") >= LEAST_RATIO))
              .orderBy(F.desc("ratio"), "term").limit(MAX_TERMS).select("term", "df").collect())
    terms = {r["term"]: i for i, r in enumerate(chosen)}
    held = counts.filter(~F.endswith("term", F.lit("*"))).select("term", "df").toArrow().sort_by("term")  # bounded by the texts of the examples
    words = {w: len(terms) + i for i, w in enumerate(held.column("term").to_pylist())}
    idf = np.log((n1 + n0 + 1) / (np.concatenate([[r["df"] for r in chosen], held.column("df").to_numpy(), [0]]) + 1)) + 1
    blank = rows.sparkSession.sparkContext.broadcast(Model(terms, words, idf, None, None, None, 0.0, None))

    def vectors(batches):
        memo: dict = {}
        for b in batches:
            got = [blank.value.vector(Counter(LETTERS.findall(t.lower())), memo) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([g[0].astype(np.int32).tobytes() for g in got], pa.binary()), pa.array([g[1].tobytes() for g in got], pa.binary())],
                ["doc_id", "toxic", "terms", "weights"])

    # at most `most` vectors
    sent = rows.mapInArrow(vectors, "doc_id long, toxic int, terms binary, weights binary").toArrow()
    got = [(d, toxic, np.frombuffer(t.as_buffer(), np.int32), np.frombuffer(w.as_buffer())) for d, toxic, t, w in
           zip(sent.column(0).to_pylist(), sent.column(1).to_pylist(), sent.column(2), sent.column(3), strict=True)]
    bare = [toxic for _, toxic, t, _ in got if not (t < len(terms)).any()]
    base = (sum(bare) + (n1 + 1) / (n1 + n0 + 2)) / (len(bare) + 1)
    # examples with the same strongest terms lie together, which makes block maxima tight
    found = sorted((r for r in got if len(r[2])), key=lambda r: (r[2][np.argsort(-r[3], kind="stable")[:3]].tolist(), r[0]))
    index = BlockMaxIndex([(t, w) for _, _, t, w in found], len(idf))
    del sent, got
    found = [r[:2] for r in found]
    model = Model(terms, words, idf, index, np.array([r[0] for r in found], np.int64), np.array([r[1] for r in found], float), base, ((), ()))
    model.shared = blank, rows.sparkSession.sparkContext.broadcast((index, model.doc_id, model.toxic))
    model.curve = isotonic(*_votes(rows, model)) if found else ((), ())
    return model


def _votes(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Votes and labels of the examples, each left out of its own neighbours; at most MAX_EXAMPLES."""
    get = model.ship()

    def run(batches):
        m, memo = get(), {}
        place = {d: i for i, d in enumerate(m.doc_id.tolist())}
        for b in batches:
            known = [i for i, d in enumerate(b.column(0).to_pylist()) if d in place]
            ids, texts = (b.column(c).take(pa.array(known, pa.int64())).to_pylist() for c in (0, 1))
            b = b.take(pa.array(known, pa.int64()))
            near = m.index.search([m.vector(Counter(LETTERS.findall(t.lower())), memo) for t in texts], NEIGHBOURS, [place[d] for d in ids], True)
            votes = [m.vote(n) for n in near]
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.float64()), b.column(2)], ["vote", "toxic"])

    got = np.array([(r["vote"], r["toxic"]) for r in rows.mapInArrow(run, "vote double, toxic int").collect() if r["vote"] >= 0]).reshape(-1, 2)
    return got[:, 0], got[:, 1]


# ---------------------------------------------------------------- score


def score_documents(docs: DataFrame, labels: DataFrame, most: int = MAX_EXAMPLES) -> DataFrame:
    """doc_id, digest (of the text), score, evidence array<struct<doc_id, similarity, toxic>> (nearest first); a row per input row.

    Texts without a word of an example, empty and null ones too, have no neighbours and get the share of toxic labels among
    examples without a telling term.
    """
    get = fit(docs, labels, most).ship()
    release()  # the driver keeps the base and the curve only
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))

    def make():
        m, memo = get(), {}

        def work(batch):
            if len(memo) > MEMO:
                memo.clear()
            if m.index is None or not m.index.count:
                found = [[]] * batch.num_rows
            else:
                found = m.index.search([m.vector(Counter(LETTERS.findall(t.lower())), memo) for t in batch.column(1).to_pylist()], NEIGHBOURS, ties=True)
            scores = [m.score(near) for near in found]
            evidence = [[{"doc_id": int(m.doc_id[i]), "similarity": s, "toxic": int(m.toxic[i])} for s, i in near[:3]] for near in found]
            return {"doc_id": batch.column(0), "digest": batch.column(2), "score": scores, "evidence": pa.array(evidence, kind)}
        return work

    return map_slices(keyed_docs(docs), make, "doc_id long, digest string, score double, evidence array<struct<doc_id: long, similarity: double, toxic: int>>")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, digest, held_out, score, predicted, evidence."""
    return score_documents(docs, labels).select(
        "doc_id", "digest", F.coalesce(crc_mod3("doc_id") == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= LIMIT).cast("int").alias("predicted"), "evidence")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) that are not predicted toxic; copies of a toxic text share its score."""
    return drop_rows(docs, verdict(docs.sparkSession, lambda: judge(docs, labels).filter("predicted = 1").select("doc_id", "digest"), "toxic"))
