"""Column picking, scratch tables and Arrow batch helpers shared by the operators."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from blotter.session import materialize, settle

#: 64-bit words (a power of two) of the Bloom filter that tells which rows might go; it bounds what is broadcast.
BLOOM_WORDS = 1 << 20
#: Text bytes handled at once inside a task; bounds the working set of a worker.
SLICE_BYTES = 6 << 20
#: Bytes of an Arrow batch and rows of a Parquet batch while operators write tables (Spark: 64 MB and 10,000 rows; 4,096 rows).
#: Texts are long: a task holds such a batch in the JVM, outside the heap, and in its Python worker, whose slices are cut from it.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(3 << 20), "spark.sql.parquet.columnarReaderBatchSize": "512"}


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns by exact name, whatever else the table holds.

    A table may carry further columns, also ones that differ from a wanted one
    in case only; those would make a plain ``select`` ambiguous.
    """
    if len({c.lower() for c in df.columns}) < len(df.columns):
        df = df.toDF(*[f"_c{i}" for i in range(len(df.columns))]).select(
            *[F.col(f"_c{df.columns.index(n)}").alias(n) for n in names])
        return df
    return df.select(*names)


def docs_of(df: DataFrame) -> DataFrame:
    """(doc_id long, text string) with a null text as the empty string."""
    return pick(df, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Queries that run inside move texts in ``BATCHES``; what the session sets itself stays."""
    own = [k for k in BATCHES if spark.conf.get(k, None) is None]
    for k in own:
        spark.conf.set(k, BATCHES[k])
    try:
        yield
    finally:
        for k in own:
            spark.conf.unset(k)


def step(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    with small_batches(df.sparkSession):
        return materialize(df, f"llm-{name}")


def verdict(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make()`` decides, written; the tables it wrote on the way are deleted, for nothing reads them any more."""
    with small_batches(spark):
        return settle(spark, make, f"llm-{name}")


def text_digest(text: str | Column = "text", blank: bool = False) -> Column:
    """SHA-256 of a text, null as empty; with ``blank`` every run of white space counts as one space."""
    whole = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.sha2(F.regexp_replace(whole, r"[\x20\t-\r]+", " ") if blank else whole, 256)


def keyed_docs(df: DataFrame) -> DataFrame:
    """(doc_id, text, digest): what tells rows apart that share an id or have none."""
    return docs_of(df).withColumn("digest", text_digest())


def bloom_place(doc_id: str, digest: str) -> tuple[Column, Column]:
    """(word, bits) of a row in a blocked Bloom filter: four bits of one 64-bit word, all from one hash."""
    h = F.xxhash64(doc_id, digest)
    bits = F.lit(0).cast("long")
    for at in (40, 46, 52, 58):
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, at).bitwiseAND(F.lit(63).cast("long")).cast("int")))
    return h.bitwiseAND(F.lit(BLOOM_WORDS - 1).cast("long")), bits


def drop_rows(docs: DataFrame, dropped: DataFrame, blank: bool = False, keep: bool = False) -> DataFrame:
    """``docs`` without the rows whose (doc_id, text digest) is in ``dropped`` (doc_id, digest); with ``keep`` only those.

    ``dropped`` should be a written table, as it is read twice.  A Bloom filter over it, at most ``BLOOM_WORDS`` rows
    whatever its size, is broadcast; rows that miss it stay where they are, only the others (those to drop and a few
    more) are moved and compared with ``dropped`` itself, so the result is exact however full the filter is.

    A row without an id goes by its text, a row that shares its id with a dropped one stays if its text is another.
    Columns are handled by place, so names that differ in case only do no harm.
    """
    names = docs.columns
    placed = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    mine = [F.col(f"_c{names.index('doc_id')}").cast("long"), text_digest(F.col(f"_c{names.index('text')}"), blank)]
    gone = dropped.select(F.col("doc_id").alias("_gone"), F.col("digest").alias("_text")).distinct()
    word, bits = bloom_place("_gone", "_text")
    words = gone.select(word.alias("_word"), bits.alias("_bits")).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    word, bits = bloom_place("_id", "_digest")
    keyed = (placed.withColumns({"_id": mine[0], "_digest": mine[1]}).withColumn("_word", word)
             .join(F.broadcast(words), "_word", "left"))
    maybe = F.coalesce(F.col("_bits").bitwiseAND(bits) == bits, F.lit(False))
    same = F.col("_id").eqNullSafe(F.col("_gone")) & (F.col("_digest") == F.col("_text"))
    met = keyed.filter(maybe).join(gone, same, "left_semi" if keep else "left_anti")
    out = met if keep else keyed.filter(~maybe).unionAll(met)
    return out.select(*placed.columns).toDF(*names)


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``size`` bytes of ``column``; a longer single row is a run of its own."""
    n = batch.num_rows
    if not n:
        return
    col = batch.column(batch.schema.get_field_index(column))
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
    cut = np.cumsum(sizes) // size
    edges = np.flatnonzero(np.diff(cut)) + 1
    begin = 0
    for end in [*edges.tolist(), n]:
        if end > begin:
            yield batch.slice(begin, end - begin)
            begin = end


#: What a worker process holds on to between tasks, and the names that the running task asked for.
KEPT: dict[str, object] = {}
WANTED: set[str] = set()


def kept(name: str, make: Callable):
    """``make()``, held by the worker process as long as its tasks ask for it when they start."""
    WANTED.add(name)
    if name not in KEPT:
        KEPT[name] = make()
    return KEPT[name]


def started(make: Callable):
    """``make()``; what the worker holds from tasks of another kind goes before a row is read."""
    WANTED.clear()
    work = make()
    others = KEPT.keys() - WANTED
    for name in others:
        del KEPT[name]
    if others:
        release()
    return work


def map_slices(df: DataFrame, make: Callable, schema: str, column: str = "text", size: int = SLICE_BYTES) -> DataFrame:
    """``make()`` is called once per task and returns a function from a slice (of about ``size`` bytes) to a dict of columns (or None).

    Columns come as numpy arrays, lists or Arrow arrays; they are cast to ``schema``.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        work = started(make)
        try:
            yield from rows(work, batches)
        finally:
            del work
            release()

    def rows(work, batches):
        for batch in batches:
            for part in slices(batch, column, size):
                out = work(part)
                if out is not None:
                    yield pa.RecordBatch.from_arrays(
                        [x if isinstance(x := out[f.name], pa.Array) and x.type == f.type
                         else x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, type=f.type)
                         for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def release() -> None:
    """Give freed memory back to the system: a worker process lives on after its task, beside the executor's heap."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def list_of(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array from flat values and n + 1 offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))


def binary_of(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary array whose row i holds the bytes of values[offsets[i]:offsets[i + 1]]."""
    width = values.dtype.itemsize
    return pa.Array.from_buffers(
        pa.binary(), len(offsets) - 1,
        [None, pa.py_buffer((offsets * width).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(values))])


def runs(lengths: np.ndarray) -> np.ndarray:
    """Offsets (n + 1) of consecutive runs of the given lengths."""
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The pieces flat[starts[i]:starts[i] + lengths[i]], one after another."""
    at = runs(lengths)
    return flat[np.repeat(starts - at[:-1], lengths) + np.arange(at[-1], dtype=np.int64)]


def crc_mod3(doc_id: str | Column) -> Column:
    """crc32 of the id's decimal text, modulo 3."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 3
