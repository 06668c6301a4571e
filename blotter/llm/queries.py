"""The registered queries: each operator over its whole table, with its digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from blotter.llm import (bpe, exact_dedup, html_extract, license_scan, near_dup, packing, prefix_trie, quality_rules, secret_scan,
                         token_orc, toxicity, url_filter, whitening)
from blotter.llm.common import read
from blotter.llm.sql import ORACLE  # noqa: F401
from blotter.session import scratch_dir


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read(spark, sf_dir, "documents"))


def op2_license_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_passages(read(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digests(read(spark, sf_dir, "documents"))


def op7_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "llm-tokens")
    token_orc.write_tokens(read(spark, sf_dir, "documents"), path)
    return token_orc.token_digests(spark, path)


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(read(spark, sf_dir, "conversations"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op13_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(read(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (
    op1_minhash_near_dedup, op2_license_scan, op2_license_passages, op3_quality_rules, op4_best_fit_packing, op5_exact_dedup,
    op6_secret_scan, op7_token_orc, op8_bpe_round_trip, op9_toxicity, op10_url_filter, op11_prefix_trie, op12_embedding_whitening,
    op13_html_extract)}
