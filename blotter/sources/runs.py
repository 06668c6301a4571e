"""Run log: an append-only table of experiment runs.

A run is one row: experiment, run name, status, params map<string,string>,
metrics map<string,double>, artifacts array<string>, path of the model, time of
the start and an id made of what names the run.  Writers append a batch in a
folder named by the ids it holds; Spark's ``_SUCCESS`` file commits it.  A batch
without that file is not read, one that is there already is not written again,
and a run that two batches hold counts once: appends may be repeated. Readers flatten the maps into wide columns with
plain map lookups (no explode / pivot shuffle): params keep their names,
metrics become ``metric_<name>`` rounded to 4 decimals.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blotter.sources import files

RUN_SCHEMA = T.StructType([
    T.StructField("experiment", T.StringType()),
    T.StructField("run_name", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("artifacts", T.ArrayType(T.StringType())),
    T.StructField("model", T.StringType()),
    T.StructField("started", T.TimestampType()),
    T.StructField("run_id", T.StringType()),
])

METRIC_PREFIX = "metric_"


def make_runs(df: DataFrame, experiment, run_name, params: dict, metrics: dict,
              status: str = "FINISHED", artifacts: list[str] | None = None, model: str | None = None,
              started: dt.datetime | None = None) -> DataFrame:
    """Shape rows of ``df`` into run records; NULL params / metrics are left out,
    so runs may carry different keys.

    The id is a digest of experiment, name, start and params.  Give ``started`` once per run, so that a repeated append
    keeps its id and a second run with the same params has another; without it, equal runs are one.
    """
    pm = F.map_filter(F.create_map(*[x for k, v in params.items() for x in (F.lit(k), v.cast("string"))]),
                      lambda k, v: v.isNotNull())
    mm = F.map_filter(F.create_map(*[x for k, v in metrics.items() for x in (F.lit(k), v.cast("double"))]),
                      lambda k, v: v.isNotNull())
    arts = F.array(*[F.lit(a) for a in (artifacts or [])]).cast("array<string>")
    out = df.select(experiment.alias("experiment"), run_name.alias("run_name"), F.lit(status).alias("status"),
                    pm.alias("params"), mm.alias("metrics"), arts.alias("artifacts"), F.lit(model).cast("string").alias("model"),
                    F.lit(started).cast("timestamp").alias("started"))
    named = F.to_json(F.struct("experiment", "run_name", "started", F.array_sort(F.map_entries("params")).alias("params")))
    return out.withColumn("run_id", F.sha2(named, 256))


def _committed(spark: SparkSession, path: str) -> list[str]:
    return [n for n in files.names(spark, path) if n.startswith("batch-") and files.exists(spark, f"{path}/{n}/_SUCCESS")]


def _batch_name(runs: DataFrame) -> str | None:
    """A name that equal sets of runs share, from one small aggregate."""
    once = runs.select("run_id").distinct()
    r = once.agg(F.count("*").alias("n"), *[F.bit_xor(F.xxhash64("run_id", F.lit(i))).alias(f"h{i}") for i in range(2)]).first()
    return f"batch-{r.n}-{r.h0 & 2**64 - 1:016x}{r.h1 & 2**64 - 1:016x}" if r.n else None


def _write_batch(runs: DataFrame, path: str) -> str | None:
    spark, name = runs.sparkSession, _batch_name(runs)
    if name is not None and not files.exists(spark, f"{path}/{name}/_SUCCESS"):
        runs.write.mode("overwrite").parquet(f"{path}/{name}")
    return name


def log_runs(runs: DataFrame, path: str) -> None:
    """Append run records to the log (S11); once, however often it is called with the same runs."""
    _write_batch(runs.select(*[F.col(f.name).cast(f.dataType) for f in RUN_SCHEMA.fields]), path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All committed runs, each once; an absent log reads as empty."""
    batches = [f"{path}/{n}" for n in _committed(spark, path)]
    if not batches:
        return spark.createDataFrame([], RUN_SCHEMA)
    return spark.read.schema(RUN_SCHEMA).parquet(*batches).dropDuplicates(["run_id"])


def compact_runs(spark: SparkSession, path: str) -> None:
    """Put all committed batches together as one.

    The old ones go after the new one is committed; a crash in between leaves runs twice, which readers count once.
    Run it while nobody else compacts.
    """
    old = _committed(spark, path)
    if len(old) < 2:
        return
    new = _write_batch(read_runs(spark, path).coalesce(1), path)
    for name in old:
        if name != new:
            files.delete(spark, f"{path}/{name}")


def _keys(runs: DataFrame, col: str) -> list[str]:
    return [r[0] for r in runs.select(F.explode(F.map_keys(col)).alias("k")).distinct().orderBy("k").collect()]


def flatten_runs(runs: DataFrame, decimals: int = 4) -> DataFrame:
    """Wide run table: params as columns, metrics as metric_<k> (M1)."""
    pkeys, mkeys = _keys(runs, "params"), _keys(runs, "metrics")
    return runs.select("experiment", "run_name", "status",
                       *[F.col("params")[k].alias(k) for k in pkeys],
                       *[F.bround(F.col("metrics")[k], decimals).alias(f"{METRIC_PREFIX}{k}") for k in mkeys])


def union_ragged(frames: list[DataFrame]) -> DataFrame:
    """Union of tables whose columns differ; absent columns become NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def metric_columns(flat: DataFrame) -> list[str]:
    """Columns holding metrics, chosen by name prefix."""
    return [c for c in flat.columns if c.startswith(METRIC_PREFIX)]


def metric_compare(flat: DataFrame, metric: str) -> DataFrame:
    """Runs that report ``metric``, with the number of runs in the log (U4)."""
    if metric not in metric_columns(flat):
        raise ValueError(f"{metric} is not a metric column")
    total = flat.count()  # one scalar from a small log table
    return (flat.where(F.col(metric).isNotNull()).select("run_name", "experiment", metric)
            .withColumn("runs_total", F.lit(total).cast("long")))
