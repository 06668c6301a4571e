"""Tables that belong together, published as one version.

Every version has a folder of its own; the manifest that names its tables is
written last, in one step that fails if another writer was first.  Readers
follow the newest manifest, so they see all tables of a version or none: a
crash between two writes leaves a folder that no manifest names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from blotter.sources import files
from blotter.sources.io import read_table, write_table

_MANIFESTS = "_manifests"


def versions(spark: SparkSession, path: str) -> list[tuple[int, dict]]:
    """(number, manifest) of every complete version, oldest first."""
    out = []
    for name in files.names(spark, f"{path}/{_MANIFESTS}"):
        text = files.read_text(spark, f"{path}/{_MANIFESTS}/{name}") if name.endswith(".json") else ""
        try:
            out.append((int(name.removesuffix(".json")), json.loads(text)))
        except ValueError:  # a writer that died while it wrote the manifest
            continue
    return out


def publish(tables: dict[str, DataFrame], path: str, partition_by: dict[str, list[str]] | None = None) -> int:
    """Write ``tables`` as the next version of ``path``; its number."""
    spark = next(iter(tables.values())).sparkSession
    folder = f"v-{uuid.uuid4().hex}"
    for name, df in tables.items():
        write_table(df, f"{path}/{folder}/{name}", partition_by=(partition_by or {}).get(name))
    manifest = json.dumps({"folder": folder, "tables": sorted(tables)})
    taken = [int(n.removesuffix(".json")) for n in files.names(spark, f"{path}/{_MANIFESTS}") if n.endswith(".json")]
    number = max(taken, default=0) + 1
    while not files.create_new(spark, f"{path}/{_MANIFESTS}/{number:012d}.json", manifest):
        number += 1
    return number


def read_published(spark: SparkSession, path: str, table: str, version: int | None = None) -> DataFrame:
    """A table of the newest version, or of the one named."""
    known = dict(versions(spark, path))
    number = max(known, default=None) if version is None else version
    if number not in known or table not in known[number]["tables"]:
        raise FileNotFoundError(f"{path} has no version {'' if version is None else version} with table {table}")
    return read_table(spark, f"{path}/{known[number]['folder']}/{table}")


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete all but the newest ``keep`` versions and the folders of writers that died.

    Run it while nobody publishes: a folder without a manifest may be a version still being written.
    """
    if keep < 1:
        raise ValueError("at least one version stays")
    known = versions(spark, path)
    for number, _ in known[:-keep]:
        files.delete(spark, f"{path}/{_MANIFESTS}/{number:012d}.json")
    live = {m["folder"] for _, m in known[-keep:]}
    for name in files.names(spark, path):
        if name.startswith("v-") and name not in live:
            files.delete(spark, f"{path}/{name}")
