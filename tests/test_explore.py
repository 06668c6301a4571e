from pyspark.sql import functions as F

from blotter.operators import explore as ex
from blotter.operators import sampling
from blotter.operators.reduce import top_k_per_group


def test_frequency_tie_rule(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,)], "t string")
    assert [tuple(r) for r in ex.frequency(df, "t").collect()] == [("a", 2), ("b", 2), ("c", 1)]


def test_mode_per_group_ties_to_smaller_value(spark):
    rows = [(1, "y"), (1, "x"), (1, "y"), (1, "x"), (2, "z")] + [(3, "q")] * 5
    df = spark.createDataFrame(rows, "g int, v string")
    got = {r["g"]: (r["mode_v"], r["mode_count"]) for r in ex.mode_per_group(df, "g", "v").collect()}
    assert got == {1: ("x", 2), 2: ("z", 1), 3: ("q", 5)}


def test_domain_completion_missing_days(spark):
    df = spark.createDataFrame([("Monday",), ("Wednesday",), ("Monday",)], "d string")
    got = [tuple(r) for r in ex.dow_counts_complete(df, "d").collect()]
    assert got == [("Monday", 2), ("Tuesday", None), ("Wednesday", 1), ("Thursday", None), ("Friday", None),
                   ("Saturday", None), ("Sunday", None)]


def test_sample_exact_is_plan_independent(spark):
    base = spark.range(0, 5000).withColumnRenamed("id", "k")
    a = sampling.sample_exact(base.repartition(1), 300, "k")
    b = sampling.sample_exact(base.repartition(13), 300, "k")
    ka = sorted(r[0] for r in a.collect())
    kb = sorted(r[0] for r in b.collect())
    assert len(ka) == 300 and ka == kb
    brute = base.orderBy(sampling.sample_hash("k"), "k").limit(300)
    assert sorted(r[0] for r in brute.collect()) == ka
    assert sampling.sample_exact(base, 10_000, "k").count() == 5000


def test_top_k_per_group_skewed(spark):
    hot = spark.range(0, 20000).select(F.lit(0).alias("g"), F.col("id").alias("v"))
    cold = spark.range(0, 10).select(F.lit(1).alias("g"), F.col("id").alias("v"))
    df = hot.unionByName(cold).repartition(16)
    out = top_k_per_group(df, "g", [F.desc("v")], 3).orderBy("g", "rank").collect()
    assert [(r["g"], r["v"], r["rank"]) for r in out] == [(0, 19999, 1), (0, 19998, 2), (0, 19997, 3),
                                                          (1, 9, 1), (1, 8, 2), (1, 7, 3)]


def test_top_k_bucket(spark):
    df = spark.createDataFrame([(x,) for x in "aaabbbccd"], "c string")
    got = sorted(r["c"] for r in sampling.top_k_bucket(df, "c", 2).collect())
    assert got == ["Other"] * 3 + ["a"] * 3 + ["b"] * 3
