"""A training corpus from ``documents``: each stage is one operator, written as Parquet and read again by the next.

toxicity (rejected documents go) -> exact dedup (one of equal texts stays) -> MinHash near-dedup (one of each
group stays) -> secret scans (documents that leak a credential go) -> best-fit packing (a row per piece).
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from blotter.llm import exact_dedup, near_dup, packing, secret_scan, toxicity
from blotter.llm.common import read, verdict


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_distinct(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one_per_group(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.drop_leaking(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("toxicity", toxicity_stage), ("exact dedup", exact_stage), ("near dedup", near_stage),
          ("secret scan", secret_stage), ("packing", packing_stage)]

#: SQL has no form for nearest-neighbour scores, token ids and packing; tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage wrote on the way is deleted once its own table is written."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = verdict(spark, partial(stage, spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
