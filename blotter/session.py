"""Session defaults and shared scratch locations.

On a cluster the shared folder comes from ``spark.checkpoint.dir``.  Only a
session whose executors are threads of the driver (``local[...]``) gets a
folder of its own in the temp area when nothing is configured; any other master
raises, since executors would each write to their own disk.
"""

from __future__ import annotations

import contextlib
import contextvars
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "blotter", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``blotter`` importable on every executor (Python workers unpickle
    task functions by module path): zip the package once per process and add
    it to the SparkContext, as for any cluster deployment."""
    import zipfile

    sc = spark.sparkContext
    key = (id(sc), sc.applicationId)
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="blotter-pkg-"), "blotter.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def _is_local(master: str) -> bool:
    """Executors are threads of the driver: ``local``, ``local[4]``, ``local[*, 2]``; not ``local-cluster``."""
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only if unset and the master is local."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not _is_local(sc.master):
            raise RuntimeError(f"spark.checkpoint.dir is not set; master {sc.master} needs a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="blotter-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_dir(spark: SparkSession, name: str = "scratch") -> str:
    """A fresh, unique path below the shared checkpoint folder; Spark's writer creates it."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/blotter-{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables materialised inside are deleted at the end: write or collect the result before.

    >>> with scratch(spark):
    ...     dbscan(points, "id", "x", "y").write.parquet(path)
    """
    token = _MADE.set([])
    try:
        yield
    finally:
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        for path in _MADE.get():
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(hadoop).delete(where, True)
        _MADE.reset(token)


_MADE: contextvars.ContextVar = contextvars.ContextVar("blotter_scratch", default=None)


def materialize(df, name: str = "step"):
    """Cut lineage by writing ``df`` as a parquet table in the shared folder.

    Unlike ``checkpoint()``, the table read back carries statistics of the
    written files, so iterative joins do not compound their size estimates.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    if _MADE.get() is not None:
        _MADE.get().append(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def settle(spark: SparkSession, make, name: str = "settled"):
    """Write the table that ``make()`` returns, then delete the tables materialised on the way to it."""
    path = scratch_dir(spark, name)
    if _MADE.get() is not None:
        _MADE.get().append(path)
    with scratch(spark):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
