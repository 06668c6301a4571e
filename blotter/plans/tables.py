"""Test-table loaders and the role mapping of the driver tables.

``events`` plays the incident table: ts -> Date, event_type -> Primary Type,
event_id -> ID, user_id -> District / Beat, the number in ``props`` -> Ward /
Community Area, value -> Latitude and props number -> Longitude (any two
numeric columns serve as a plane), event_type = 'error' -> Arrest and
value >= 100 -> Domestic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def props_k():
    return F.get_json_object(F.col("props"), "$.k").try_cast("int")


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw-incident shaped view of ``events`` (timestamp already typed)."""
    ev = table(spark, sf_dir, "events")
    k = props_k()
    return ev.select(
        F.col("event_id").alias("ID"),
        F.col("ts").alias("Date"),
        F.upper("event_type").alias("Primary Type"),
        F.col("event_type").alias("Description"),
        F.concat(F.lit("K"), k.cast("string")).alias("Location Description"),
        (F.col("event_type") == "error").alias("Arrest"),
        (F.col("value") >= 100).alias("Domestic"),
        F.col("user_id").cast("int").alias("Beat"),
        F.col("user_id").cast("double").alias("District"),
        k.cast("double").alias("Ward"),
        k.cast("double").alias("Community Area"),
        F.year("ts").alias("Year"),
        F.col("value").alias("Latitude"),
        k.cast("double").alias("Longitude"),
    )


def documents_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents LEFT JOIN labels: a table with real missing values."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return docs.join(labels, "doc_id", "left")


def embedding_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, x, y): the first two embedding coordinates as a plane."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select("vec_id", "label",
                      F.col("embedding")[0].cast("double").alias("x"),
                      F.col("embedding")[1].cast("double").alias("y"))


def embedding_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, features: array<double>)."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("features"))
