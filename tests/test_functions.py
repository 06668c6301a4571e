import datetime as dt

from pyspark.sql import functions as F

from blotter.functions import temporal as tf
from blotter.operators import prepare


def test_parse_timestamp_fixture(spark):
    rows = [("01/05/2020 11:30:00 PM",), ("07/04/2021 12:00:00 AM",), ("1/5/2020 1:30:00 PM",), ("bad",), (None,)]
    df = spark.createDataFrame(rows, "Date string")
    out = prepare.add_temporal_features(df, "Date").collect()
    assert out[0]["Date"] == dt.datetime(2020, 1, 5, 23, 30)
    assert out[0]["Hour"] == 23 and out[0]["Day_of_Week"] == "Sunday" and out[0]["Is_Weekend"] is True
    assert out[1]["Hour"] == 0 and out[1]["Month"] == 7 and out[1]["Season"] == "Summer"
    assert out[2]["Date"] == dt.datetime(2020, 1, 5, 13, 30) and out[2]["Season"] == "Winter"
    for r in out[3:]:
        assert r["Date"] is None and r["Hour"] is None and r["Season"] is None
        assert r["Is_Weekend"] is False  # missing date is not weekend


def test_severity_lookup_is_exact_and_defaults(spark):
    df = spark.createDataFrame([("HOMICIDE",), ("UNKNOWN TYPE",), ("homicide",), (None,)], "t string")
    got = [r[0] for r in df.select(tf.severity_of_type("t")).collect()]
    assert got == [10.0, 2.0, 2.0, 2.0]


def test_period_label_rounds_first(spark):
    df = spark.createDataFrame([(5.996,), (5.994,), (11.999,), (16.9,), (17.0,)], "h double")
    got = [r[0] for r in df.select(tf.period_label("h")).collect()]
    # 5.996 rounds to 6.00 -> Morning; 11.999 -> 12.00 -> Afternoon
    assert got == ["Morning", "Late Night", "Afternoon", "Afternoon", "Evening"]


def test_round_half_even(spark):
    df = spark.createDataFrame([(0.125,), (0.5,), (2.5,)], "x double")
    r = df.select(tf.round_half_even("x", 2).alias("a"), tf.round_half_even("x", 0).alias("b")).collect()
    assert [x["a"] for x in r] == [0.12, 0.5, 2.5]
    assert [x["b"] for x in r] == [0.0, 0.0, 2.0]


def test_ordinal_default(spark):
    df = spark.createDataFrame([("Monday",), ("Sunday",), ("Funday",), (None,)], "d string")
    from blotter.functions import fixed
    got = [r[0] for r in df.select(tf.ordinal_of("d", fixed.DAY_ORDER)).collect()]
    assert got == [0, 6, 0, 0]
