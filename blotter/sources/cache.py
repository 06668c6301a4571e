"""Cached scans by key (S4): reused while the files are the same, released when they change or others push them out."""

from __future__ import annotations

import hashlib
from collections import OrderedDict

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from blotter.sources import files
from blotter.sources.io import read_table


class ScanCache:
    """At most ``most`` persisted scans; the least recently used one is released first.

    The key is the session, path and columns; the listing of the files (names, sizes, times) tells whether a kept
    scan is still valid.  A released scan that somebody still holds stays correct, it is read from its files again.
    """

    def __init__(self, most: int = 8):
        if most < 1:
            raise ValueError("room for one scan at least")
        self.most = most
        self._kept: OrderedDict[tuple, tuple[str, DataFrame]] = OrderedDict()

    def get(self, spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
        key = (spark.sparkContext.applicationId, id(spark), path, tuple(columns) if columns else None)
        state = hashlib.sha256(repr(files.listing(spark, path)).encode()).hexdigest()
        if key in self._kept:
            known, df = self._kept[key]
            if known == state:
                self._kept.move_to_end(key)
                return df
            self.release(key)
            spark.catalog.refreshByPath(path)
        df = read_table(spark, path, columns).persist(StorageLevel.MEMORY_AND_DISK)
        self._kept[key] = (state, df)
        while len(self._kept) > self.most:
            self.release(next(iter(self._kept)))
        return df

    def release(self, key: tuple) -> None:
        _, df = self._kept.pop(key)
        if df.sparkSession.sparkContext._jsc is not None:  # else the session has ended and its blocks with it
            df.unpersist()

    def clear(self) -> None:
        for key in list(self._kept):
            self.release(key)

    def __len__(self) -> int:
        return len(self._kept)


SCANS = ScanCache()


def cached_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Scan kept in executor memory / disk for repeated interactive queries (S4); only the listed columns are kept."""
    return SCANS.get(spark, path, columns)
