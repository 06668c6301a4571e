"""Exact deduplication by content-defined chunk recipes.

Texts are equal when they are identical after every run of ASCII white space is
one space.  A scan cuts each normalised text where a rolling hash of its own
last 32 bytes says so, and writes two things: the document's recipe (its chunk
digests in order) and the chunks that its task had not yet written.  Long
documents move no further.  Documents with equal recipes are candidates; the
chunks of those recipes, and only those, are compared byte for byte, which turns
a digest into a verified identifier.  Equal ordered identifier lists are equal
texts.  Should verification ever find one digest for different bytes, the run is
repeated with longer digests.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blotter.llm.common import docs_of, drop_rows, map_slices, runs, step, text_digest, verdict

#: Chunk sizes in bytes: least, about the mean beyond the least (a power of two), largest.
LEAST, SPREAD, LARGEST = 512, 2048, 16384
WINDOW = 32
#: Chunk bytes that a task remembers as written.
SEEN_BYTES = 12 << 20
_BLANKS = bytes.maketrans(b"\t\n\r\x0b\x0c", b"     ")
_MANY = re.compile(b"  +")


def normalise(text: str) -> bytes:
    """UTF-8 with every run of ASCII white space as one space."""
    data = text.encode().translate(_BLANKS)
    return _MANY.sub(b" ", data) if b"  " in data else data


def _gear() -> np.ndarray:
    """256 fixed 32-bit words, from md5 of the byte."""
    return np.array([int.from_bytes(hashlib.md5(bytes([b])).digest()[:4], "little") for b in range(256)], np.uint32)


GEAR = _gear()


def rolling(data: np.ndarray) -> np.ndarray:
    """h[i] = sum over k < 32 of gear(data[i - k]) << k, by doubling."""
    h, width = GEAR[data], 1
    while width < WINDOW:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return h


def chunk_ends(size: int, marks: list[int]) -> list[int]:
    """Ends of the chunks of a text of ``size`` bytes; ``marks``: where its rolling hash allows a cut."""
    out, begin = [], 0
    for m in [*marks, size]:
        while m - begin > LARGEST:
            begin += LARGEST
            out.append(begin)
        if m == size or m - begin >= LEAST:
            if m > begin:
                out.append(m)
                begin = m
    return out


def cut_documents(docs: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """Written rows of two kinds: recipes (uid, doc_id, text_sha256, recipe) and chunks (digest, body).

    ``uid`` names the row: its scan task and place there.  Chunks come once per task, as far as it remembers.
    """
    def digest(data: bytes) -> bytes:
        return (hashlib.sha256 if digest_bytes <= 32 else hashlib.sha512)(data).digest()[:digest_bytes]

    def make():
        from pyspark import TaskContext

        seen: dict[bytes, list[bytes]] = {}
        state = {"uid": TaskContext.get().partitionId() << 33, "bytes": 0}

        def work(batch):
            texts = [normalise(t) for t in batch.column(1).to_pylist()]
            at = runs(np.fromiter(map(len, texts), np.int64, len(texts)))
            marks = np.flatnonzero((rolling(np.frombuffer(b"".join(texts), np.uint8)) & np.uint32(SPREAD - 1)) == 0) + 1
            cuts = np.searchsorted(marks, at, side="right")
            recipes, digests, bodies = [], [], []
            for i, t in enumerate(texts):
                # a cut looks at 32 bytes before it, all of this text as no chunk is shorter than that
                own = (marks[cuts[i]:cuts[i + 1]] - at[i]).tolist() if len(t) > LEAST else []
                begin, recipe = 0, []
                for end in chunk_ends(len(t), own):
                    body, begin = t[begin:end], end
                    d = digest(body)
                    recipe.append(d)
                    if body not in (known := seen.setdefault(d, [])):
                        known.append(body)
                        digests.append(d)
                        bodies.append(body)
                        state["bytes"] += len(body)
                recipes.append(recipe)
            if state["bytes"] > SEEN_BYTES:
                seen.clear()
                state["bytes"] = 0
            n, m = len(texts), len(digests)
            uid = state["uid"] + np.arange(n)
            state["uid"] += n
            none = lambda k, t: pa.nulls(k, t)
            join = pa.concat_arrays
            return {"uid": join([pa.array(uid), none(m, pa.int64())]),
                    "doc_id": join([batch.column(0), none(m, pa.int64())]),
                    "text_sha256": join([pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), none(m, pa.string())]),
                    "recipe": pa.array([*recipes, *[None] * m], pa.list_(pa.binary())),
                    "digest": join([none(n, pa.binary()), pa.array(digests, pa.binary())]),
                    "body": join([none(n, pa.binary()), pa.array(bodies, pa.binary())])}
        return work

    return step(map_slices(docs_of(docs), make, "uid long, doc_id long, text_sha256 string, recipe array<binary>, digest binary, body binary"), "chunks")


def recipes_of(cut: DataFrame) -> DataFrame:
    return cut.filter("uid is not null").select("uid", "doc_id", "text_sha256", "recipe")


def chunks_of(cut: DataFrame) -> DataFrame:
    return cut.filter("digest is not null").select("digest", "body")


def unverified(groups: DataFrame, chunks: DataFrame) -> DataFrame:
    """Digests of shared recipes that stand for different bytes (none, unless digests collide)."""
    shared = groups.filter("group_size > 1").select(F.explode("recipe").alias("digest")).distinct()
    return (chunks.join(shared, "digest", "left_semi").groupBy("digest")
            .agg(F.min("body").alias("low"), F.max("body").alias("high")).filter("low <> high").select("digest"))


def dedup(docs: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """uid, doc_id, text_sha256, recipe, keep_id, group_size, kept; a row per input row.

    Of equal texts the row with the smallest doc_id stays (rows without an id come last; of repeated rows one
    stays).  A null text counts as empty, and empty texts are equal.
    """
    while True:
        cut = cut_documents(docs, digest_bytes)
        recipes = recipes_of(cut)
        groups = step(recipes.groupBy("recipe").agg(
            F.count("*").alias("group_size"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")).alias("first")), "recipes")
        if unverified(groups, chunks_of(cut)).isEmpty():
            break
        digest_bytes *= 2
        if digest_bytes > 64:
            raise ValueError("chunk digests collide at 512 bits")
    return recipes.join(groups, "recipe").select(
        "uid", "doc_id", "text_sha256", "recipe", F.col("first.doc_id").alias("keep_id"), "group_size",
        (F.col("uid") == F.col("first.uid")).alias("kept"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256; a row per input row."""
    return dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def keep_distinct(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) that stay; one of repeated rows."""
    def judged():
        rows = dedup(docs).select("doc_id", F.col("text_sha256").alias("digest"), "kept")
        return rows.groupBy("doc_id", "digest").agg(F.max("kept").alias("stays"), F.count("*").alias("n")).filter("not stays or n > 1")

    verdicts = verdict(docs.sparkSession, judged, "verdicts")
    out = drop_rows(docs, verdicts.filter("not stays"), blank=True)
    repeated = step(verdicts.filter("stays and n > 1").select("doc_id", "digest"), "repeated")
    if repeated.isEmpty():
        return out
    names = docs.columns
    few = drop_rows(docs, repeated, blank=True, keep=True).toDF(*[f"_c{i}" for i in range(len(names))])
    few = few.withColumn("_digest", text_digest(F.col(f"_c{names.index('text')}"), True)).dropDuplicates([f"_c{names.index('doc_id')}", "_digest"])
    return drop_rows(out, repeated, blank=True).union(few.drop("_digest").toDF(*names))


def rebuild(cut: DataFrame) -> DataFrame:
    """uid, text: documents put together again from recipes and chunks (normalised, whole)."""
    chunks = chunks_of(cut).dropDuplicates(["digest"])
    parts = recipes_of(cut).select("uid", F.posexplode("recipe").alias("at", "digest")).join(chunks, "digest")
    whole = parts.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("at", "body"))).alias("p")).select(
        "uid", F.expr("decode(aggregate(p, cast('' as binary), (a, x) -> a || x.body), 'utf-8')").alias("text"))
    return recipes_of(cut).select("uid", "doc_id").join(whole, "uid", "left").select("uid", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
