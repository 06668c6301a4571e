import numpy as np
import pandas as pd
import pytest

from blotter.operators import quality
from blotter.operators.stats import exact_quantiles


def test_null_profile_and_duplicates(spark):
    rows = [(1, "a", None), (1, "a", None), (2, None, 3.0), (3, "b", 4.0)]
    df = spark.createDataFrame(rows, "k long, s string, v double")
    prof = {r["column"]: (r["missing_count"], r["missing_pct"]) for r in quality.null_profile(df).collect()}
    assert prof == {"s": (1, 25.0), "v": (2, 50.0)}
    d = quality.duplicate_count(df).collect()[0]
    assert (d["total_rows"], d["distinct_rows"], d["duplicate_rows"], d["total_columns"]) == (4, 3, 1, 3)


def test_fill_median_even_count(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (4.0,), (5.0,)], "x double")
    out = [r[0] for r in quality.fill_median(df, ["x"]).collect()]
    assert out == [1.0, 2.0, 3.0, 4.0, 5.0]
    df2 = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    assert [r[0] for r in quality.fill_median(df2, ["x"]).collect()] == [1.0, 2.0, 1.5]


@pytest.mark.parametrize("seed", [0, 1])
def test_exact_quantiles_match_numpy_with_refinement(spark, seed):
    rng = np.random.default_rng(seed)
    vals = np.concatenate([rng.normal(size=4000), np.full(3000, 0.25), rng.exponential(size=2000)])
    rng.shuffle(vals)
    pdf = pd.DataFrame({"x": vals, "y": np.round(vals * 3)})
    pdf.loc[::17, "y"] = np.nan
    df = spark.createDataFrame(pdf).repartition(7)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    # a tiny local bound forces the distributed refinement passes
    got = exact_quantiles(df, ["x", "y"], probs, max_local=50, buckets=16)
    for c in ["x", "y"]:
        want = np.quantile(pdf[c].dropna().to_numpy(), probs)
        assert np.allclose(got[c], want, rtol=0, atol=1e-12), (c, got[c], want)


def test_clean_incidents_order_of_steps(spark):
    rows = [(1, 10.0, 1.0, 2.0, None), (1, 10.0, 1.0, 2.0, None), (2, None, 1.0, 2.0, "X"),
            (3, 20.0, None, 2.0, "Y"), (4, 30.0, 3.0, 2.0, "Z")]
    df = spark.createDataFrame(rows, "ID long, District double, Latitude double, Longitude double, "
                                     "`Location Description` string")
    out = quality.clean_incidents(df, median_cols=["District"]).orderBy("ID").collect()
    # median taken after coordinate drop (10, 10, None, 30 -> 10) and before dedup
    assert [r["ID"] for r in out] == [1, 2, 4]
    assert out[1]["District"] == 10.0
    assert out[0]["Location Description"] == "UNKNOWN"


def test_raw_csv_stage1_end_to_end(spark, tmp_path):
    from blotter.operators.prepare import preprocess
    from blotter.sources.io import read_raw_csv

    text = (",ID,Date,Primary Type,Description,Location Description,Arrest,Domestic,Beat,District,Ward,"
            "Community Area,Year,Latitude,Longitude\n"
            "0,1,01/05/2020 11:30:00 PM,THEFT,x,STREET,True,False,111,1.0,2.0,3.0,2020,41.8,-87.6\n"
            "1,2,07/04/2021 12:00:00 AM,HOMICIDE,y,NA,False,True,112,,4.0,N/A,2021,41.9,-87.7\n"
            "2,3,bad,battery,z,,False,False,113,3.0,,5.0,2021,41.7,-87.5\n"
            "3,4,1/5/2020 1:30:00 PM,THEFT,x,STREET,True,False,111,1.0,2.0,3.0,2020,,-87.6\n"
            "4,1,01/05/2020 11:30:00 PM,THEFT,x,STREET,True,False,111,1.0,2.0,3.0,2020,41.8,-87.6\n")
    p = tmp_path / "raw.csv"
    p.write_text(text)
    raw = read_raw_csv(spark, str(p))
    assert "_c0" not in raw.columns and raw.schema["Latitude"].dataType.simpleString() == "double"
    out = {r["ID"]: r for r in preprocess(raw).collect()}
    assert sorted(out) == [1, 2, 3]  # no coordinates -> dropped; exact copy -> deduplicated
    # medians are taken before dedup, so the exact copy counts: District [1, 3, 1] -> 1
    assert out[2]["Location Description"] == "UNKNOWN" and out[2]["District"] == 1.0
    assert out[2]["Community Area"] == 3.0 and out[3]["Ward"] == 2.0
    assert out[1]["Crime_Severity_Score"] == 5.0 and out[2]["Crime_Severity_Score"] == 10.0
    assert out[3]["Crime_Severity_Score"] == 2.0  # lower-case type is not in the map
    assert out[3]["Date"] is None and out[3]["Is_Weekend"] is False and out[3]["Season"] is None


def test_approx_options_close_to_exact(spark):
    from blotter.operators.explore import describe_columns

    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"x": rng.normal(size=5000)})
    df = spark.createDataFrame(pdf)
    ex_ = describe_columns(df, ["x"]).collect()[0]
    ap = describe_columns(df, ["x"], approx=True).collect()[0]
    for q in ["q25", "q50", "q75"]:
        assert abs(ex_[q] - ap[q]) < 0.01
    assert abs(ex_["q50"] - round(float(np.median(pdf.x)), 3)) < 1e-9
    filled = quality.fill_median(df.union(spark.createDataFrame([(None,)], "x double")), ["x"], approx=True)
    assert filled.where("x IS NULL").count() == 0


def test_audit_counts_in_the_pass_that_cleans(spark, tmp_path):
    from blotter.operators import quality

    rows = [(i % 5, None if i % 4 == 0 else i % 3) for i in range(60)]
    spark.createDataFrame(rows, "a int, b int").write.parquet(f"{tmp_path}/raw")
    steps = [("dropna", lambda d: quality.dropna_subset(d, ["b"])), ("fill", lambda d: quality.fill_constant(d, {"a": 0})), ("dedup", quality.dedup_rows)]
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    sc.setJobGroup("audit", "audit")
    clean, audit = quality.audited(spark.read.parquet(f"{tmp_path}/raw"), steps, f"{tmp_path}/clean")
    jobs = tracker.getJobIdsForGroup("audit")
    sc.setLocalProperty("spark.jobGroup.id", None)
    kept = [r for r in rows if r[1] is not None]
    assert [tuple(r) for r in audit.collect()] == [(0, "input", 60), (1, "dropna", len(kept)), (2, "fill", len(kept)), (3, "dedup", len(set(kept)))]
    assert sorted(tuple(r) for r in clean.collect()) == sorted(set(kept))
    assert len(jobs) <= 4, jobs  # two schema reads, the shuffle's map side and the write: no count per step


def test_audit_of_nothing(spark):
    from blotter.operators import quality

    audit = quality.cleaning_audit(spark.createDataFrame([], "a int"), [("dropna", quality.dropna_any)])
    assert [tuple(r) for r in audit.collect()] == [(0, "input", 0), (1, "dropna", 0)]
