import numpy as np
import pandas as pd

from blotter.operators import features as fe


def test_bins_match_pandas_cut(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.uniform(41.6, 42.1, 3000), 3)
    x[:5] = [41.6, 42.1, 41.625, 41.65, 41.85]  # minimum, maximum and values on edges
    pdf = pd.DataFrame({"i": np.arange(len(x)), "x": x})
    pdf.loc[7, "x"] = np.nan
    df = spark.createDataFrame(pdf)
    got = fe.equal_width_bins(df, {"x": "b"}, 20).orderBy("i").toPandas()["b"].to_numpy()
    want = pd.cut(pdf["x"], bins=20, labels=False).fillna(0).astype(int).to_numpy()
    assert (got == want).all()


def test_bins_constant_column(spark):
    pdf = pd.DataFrame({"i": range(4), "x": [5.0, 5.0, 5.0, 5.0]})
    got = fe.equal_width_bins(spark.createDataFrame(pdf), {"x": "b"}, 20).orderBy("i").toPandas()["b"]
    want = pd.cut(pdf["x"], bins=20, labels=False).astype(int)
    assert list(got) == list(want)


def test_minmax_and_standard_scale(spark):
    pdf = pd.DataFrame({"a": [1.0, 2.0, 3.0, 5.0], "c": [7.0] * 4, "t": [0.0, 1.0, 0.0, 1.0]})
    df = spark.createDataFrame(pdf)
    mm = fe.minmax_scale(df, {"a": "a_s", "c": "c_s"}).toPandas()
    assert np.allclose(mm["a_s"], (pdf.a - 1) / 4) and (mm["c_s"] == 0).all()
    st = fe.standard_scale(df, {"t": "t_s", "c": "c_s"}).toPandas()
    assert np.allclose(st["t_s"], (pdf.t - pdf.t.mean()) / pdf.t.std(ddof=0))
    assert (st["c_s"] == 0).all()


def test_label_encode_sorted_names_with_nan(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("B",), ("a",)], "c string")
    out = [r["c_Enc"] for r in fe.label_encode(df, ["c"]).collect()]
    # sorted classes: "B" < "a" < "b" < "nan"
    assert out == [2, 1, 3, 0, 1]


def test_feature_matrix_drops_null_rows_and_aligns(spark):
    df = spark.createDataFrame([("1", 1, True, "x"), ("2", None, False, "y"), ("3", 3, None, "z")],
                               "row_key string, h int, Arrest boolean, name string")
    X, meta = fe.feature_matrix(df, ["h", "Arrest"], ["name"])
    assert [tuple(r) for r in X.orderBy("row_key").collect()] == [("1", 1, 1)]
    assert [tuple(r) for r in meta.collect()] == [("1", "x")]
