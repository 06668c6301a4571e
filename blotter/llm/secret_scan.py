"""Secret scans over an incremental blob ledger.

A blob is a distinct text, named by the SHA-256 of its content; every row of a
table of versions is a path to a blob.  The ledger remembers which (blob, rule,
rule version) pairs were scanned.  A run adds the blobs it has not met, scans only
unseen pairs, appends findings and pairs, and joins the findings back to all
paths.  A new rule version rescans every blob for that rule only; an unchanged
table scans nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from blotter.llm.common import docs_of, drop_rows, map_slices, small_batches, step, verdict
from blotter.session import scratch_dir


@dataclass(frozen=True)
class Rule:
    """A kind of secret: spans are whole matches whose ``group`` has at least ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base kinds in their order, then the kinds that this method adds.
BASE = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", 1, r"[0-9a-f]+", 0, 16),
)
ADDED = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
)
RULES = BASE + ADDED
SCANS = "blob string, rules array<string>, findings array<struct<kind: string, rule: string, start: int, end: int>>"


class Scanner:
    """Spans of one rule in a text, leftmost and non-overlapping; a match that is too short is dropped, not retried."""

    def __init__(self, rule: Rule):
        self.rule = rule
        pattern = rule.pattern
        if rule.group == 0 and re.fullmatch(r"\[[^]]*\]\+", pattern):
            pattern = f"{pattern[:-1]}{{{rule.least},}}"  # a whole run or nothing: short runs need not be matched first
        self.pattern = re.compile(pattern, re.ASCII | (re.IGNORECASE if rule.any_case else 0))

    def __call__(self, text: str) -> list[tuple[int, int]]:
        r = self.rule
        return [m.span() for m in self.pattern.finditer(text) if m.end(r.group) - m.start(r.group) >= r.least]


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, text, need array<string>) -> (blob, rules, findings): one row per blob, for the rules it needs.

    Findings are whole spans in code points, end exclusive, in order of start, then of the rules.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def make():
        scanners = {r.name: (i, r.kind, Scanner(r)) for i, r in enumerate(rules)}

        def work(batch):
            found = []
            for text, need in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                rows = sorted((i, n, k, j, name) for name in need for n, k, s in [scanners[name]] for i, j in s(text))
                found.append([{"kind": k, "rule": name, "start": i, "end": j} for i, n, k, j, name in rows])
            return {"blob": batch.column(0), "rules": batch.column(2), "findings": pa.array(found, type=kind)}
        return work

    return map_slices(blobs.select("blob", "text", "need"), make, SCANS)


class Ledger:
    """An append-only table under one folder: a row per scanned blob with the rules run and what they found.

    Pairs and findings are one row, so a run that dies leaves no pair marked without its findings.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def scans(self) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(SCANS).parquet(f"{self.path}/scans")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            # no rows by Spark alone: a table made from Python's rows starts more workers, which stay
            return self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(SCANS)])

    def update(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> None:
        """Scan the unseen (blob, rule version) pairs of (doc_id, text)."""
        names = F.array(*[F.lit(r.name) for r in rules])
        blobs = docs_of(versions).select(F.sha2("text", 256).alias("blob"), "text")
        known = self.scans().select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        if known.isEmpty():
            unseen = blobs.groupBy("blob").agg(F.first("text").alias("text")).withColumn("need", names)
        else:
            need = known.select("blob", F.array_except(names, "seen").alias("need"))
            unseen = blobs.join(need.filter("size(need) = 0"), "blob", "left_anti").groupBy("blob").agg(F.first("text").alias("text"))
            unseen = unseen.join(need, "blob", "left").withColumn("need", F.coalesce("need", names))
        with small_batches(self.spark):
            scan_blobs(unseen, rules).write.mode("append").parquet(f"{self.path}/scans")

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """blob, findings: a row per blob in which the given rule versions found something."""
        rows = self.scans().select("blob", F.explode("findings").alias("f")).filter(F.col("f.rule").isin([r.name for r in rules]))
        rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
        span = F.struct(F.col("f.start").alias("start"), rank[F.col("f.kind")].alias("rank"), F.col("f.end").alias("end"),
                        F.col("f.kind").alias("kind"), F.col("f.rule").alias("rule"))
        return rows.groupBy("blob").agg(F.array_sort(F.collect_set(span)).alias("findings"))


def scan_secrets(docs: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, blob, findings array<struct<start, rank, end, kind, rule>>; a row per input row, [] where nothing was found.

    Without a ledger, a new one in the shared folder is filled and used.  Null and empty texts are one blob
    without findings; repeated rows share theirs.
    """
    spark = docs.sparkSession
    ledger = ledger or Ledger(spark, scratch_dir(spark, "llm-ledger"))
    ledger.update(docs, rules)
    found = step(ledger.findings(rules), "findings")
    paths = docs_of(docs).select("doc_id", F.sha2("text", 256).alias("blob"))
    return paths.join(found, "blob", "left").select(
        "doc_id", "blob", F.coalesce("findings", F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string,rule:string>>)")).alias("findings"))


def secret_digests(docs: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_spans."""
    found = scan_secrets(docs, ledger)
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    text = "array_join(transform({}, f -> concat_ws(':', f.kind, f.start, f.end)), ',')"
    kinds = [F.expr(f"cast(size(filter(findings, f -> f.kind = '{r.kind}')) as bigint)").alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc_id", *kinds,
                        F.expr(f"sha2({text.format(f'filter(findings, f -> f.kind in ({base}))')}, 256)").alias("base_sha256"),
                        F.expr(text.format("findings")).alias("spans"), F.size("findings").cast("long").alias("n_spans"))


def drop_leaking(docs: DataFrame, ledger: Ledger | None = None, kinds: tuple[str, ...] = ("assign", "access", "pem", "jwt")) -> DataFrame:
    """``docs`` (all columns) without the rows whose text holds a secret of the given kinds.

    A lone hex run is no proof of a secret (digests, numbers), so that kind is reported but drops nothing.
    """
    def leaking():
        found = scan_secrets(docs, ledger).filter(F.exists("findings", lambda f: f["kind"].isin(list(kinds))))
        return found.select("doc_id", F.col("blob").alias("digest"))

    return drop_rows(docs, verdict(docs.sparkSession, leaking, "leaking"))
