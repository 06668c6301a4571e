"""Token ids as ORC files in ascending document order.

Layout of a folder: ``ids/`` holds ORC files, one range of doc_ids each, with a
row per document (doc_id, n_tokens, first, ids array<int>); ``files/`` holds one
row per file (range of doc_ids, documents, ids, ids before it).  ORC stores the
id lists by integer run-length encoding in stripes that are read in parallel; row
indexes (least and largest doc_id of every ``ROW_STRIDE`` rows) and Bloom filters
on doc_id let a lookup skip stripes and strides from metadata alone.

``first`` is the document's place within its file, known when it is written; the
place in the whole sequence adds the ids of the files before, one number per
file.  So the text is shuffled once, into its range, and the ids never.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blotter.llm.common import docs_of, list_of, map_slices, runs
from blotter.llm.tokens import ENCODE_BYTES, default_vocabulary, word_encoder

ROW_STRIDE = 2_000
STRIPE_BYTES = 16 << 20
END_ID = 2


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID) -> None:
    """Encode (doc_id, text) and write the folder ``path``.

    Repeated ids stay separate rows next to each other; rows without an id come first; a null text counts
    as empty and has only the end id.
    """
    vocab = vocabulary or default_vocabulary("word_bpe_49k.json")
    spark = docs.sparkSession
    ranged = docs_of(docs).withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie")

    def make():
        encoder, before = word_encoder(vocab), [0]

        def work(batch):
            ids, at = encoder.encode(batch.column(1))
            n = np.diff(at) + 1
            ends = runs(n)
            flat = np.full(int(ends[-1]), end_id, np.int32)
            keep = np.ones(len(flat), bool)
            keep[ends[1:] - 1] = False
            flat[keep] = ids
            first = before[0] + ends[:-1]
            before[0] += int(ends[-1])
            return {"doc_id": batch.column(0), "n_tokens": n, "first": first, "ids": list_of(flat, ends, pa.int32())}
        return work

    rows = map_slices(ranged.sortWithinPartitions("doc_id", "tie").drop("tie"), make,
                      "doc_id long, n_tokens long, first long, ids array<int>", size=ENCODE_BYTES)
    (rows.write.mode("overwrite").option("compression", "zstd")
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
     .option("orc.row.index.stride", str(ROW_STRIDE)).option("orc.stripe.size", str(STRIPE_BYTES))
     .option("orc.create.index", "true").orc(f"{path}/ids"))
    by_file = (spark.read.orc(f"{path}/ids").select("doc_id", "n_tokens", F.col("_metadata.file_name").alias("file"))
               .groupBy("file").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"),
                                    F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")))
    # one row per file, so the running sum is over a list of files, not over documents
    order = Window.orderBy("first_doc", "last_doc", "file").rowsBetween(Window.unboundedPreceding, -1)
    by_file.withColumn("tokens_before", F.coalesce(F.sum("tokens").over(order), F.lit(0))).write.mode("overwrite").orc(f"{path}/files")


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, n_tokens, first, ids, file; with ``doc_ids`` only those, pruned by range, row index and Bloom filter."""
    rows = spark.read.orc(f"{path}/ids").withColumn("file", F.col("_metadata.file_name"))
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(doc_ids))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.orc(f"{path}/files")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, all read back from the files."""

    def run(batches):
        for b in batches:
            ids = b.column(3)
            flat = np.ascontiguousarray(np.asarray(ids.flatten(), dtype="<u4"))
            at = (np.asarray(ids.offsets) - ids.offsets[0].as_py()).tolist()
            n = np.diff(at)
            crc = [zlib.crc32(flat[i:j]) for i, j in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                                             ["doc_id", "file", "first", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, path).select("doc_id", "file", "first", "ids").mapInArrow(
        run, "doc_id long, file string, first long, n_tokens long, ids_crc32 long")
    return rows.join(read_files(spark, path).select("file", "tokens_before"), "file").select(
        "doc_id", (F.col("first") + F.col("tokens_before")).alias("start"), "n_tokens", "ids_crc32")
