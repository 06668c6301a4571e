"""Small file-system steps on any Hadoop path: listing, marker files, deletion."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names directly below ``path``, sorted; none if it is absent."""
    fs, where = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def listing(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, length, modification time) of every file below ``path``, sorted."""
    fs, where = _fs(spark, path)
    out, walk = [], fs.listFiles(where, True)
    while walk.hasNext():
        s = walk.next()
        out.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return sorted(out)


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that must not exist yet; False if another writer was first."""
    fs, where = _fs(spark, path)
    if fs.exists(where):
        return False
    try:
        stream = fs.create(where, False)
    except Exception:
        if fs.exists(where):
            return False
        raise
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return True


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
