"""Stage 1 derivations: time features and severity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blotter.functions import temporal as tf


def add_temporal_features(df: DataFrame, ts_col: str = "Date", parse_text: bool = True,
                          fmt: str | None = None) -> DataFrame:
    """Replace a text timestamp by a parsed one and add Hour, Day_of_Week,
    Month, Is_Weekend and Season."""
    ts = F.col(f"`{ts_col}`")
    if parse_text:
        ts = tf.parse_timestamp(ts, fmt) if fmt else tf.parse_timestamp(ts)
    out = df.withColumn(ts_col, ts)
    t = F.col(f"`{ts_col}`")
    return (out.withColumn("Hour", tf.hour_of(t))
            .withColumn("Day_of_Week", tf.day_name(t))
            .withColumn("Month", tf.month_of(t))
            .withColumn("Is_Weekend", tf.is_weekend(t))
            .withColumn("Season", tf.season_of_month(F.col("Month"))))


def add_severity(df: DataFrame, type_col: str = "Primary Type",
                 out_col: str = "Crime_Severity_Score") -> DataFrame:
    """Severity score of the incident type, default 2."""
    return df.withColumn(out_col, tf.severity_of_type(F.col(f"`{type_col}`")))


def preprocess(raw: DataFrame) -> DataFrame:
    """Whole stage 1 as one lazy plan (medians are the only eager job)."""
    from blotter.operators.quality import clean_incidents

    return add_severity(add_temporal_features(clean_incidents(raw)))
