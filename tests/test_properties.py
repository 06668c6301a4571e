"""Results must not depend on how the input is partitioned."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from blotter.operators import explore as ex
from blotter.operators import quality
from blotter.operators.dbscan import dbscan
from blotter.operators.stats import exact_quantiles


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    n = 3000
    pdf = pd.DataFrame({
        "id": np.arange(n),
        "g": rng.choice(["a", "b", "c", "d"], size=n, p=[0.34, 0.33, 0.2, 0.13]),
        "x": np.round(rng.normal(size=n), 2),
        "h": rng.integers(0, 24, size=n),
    })
    pdf.loc[::11, "x"] = np.nan
    return spark.createDataFrame(pdf)


@pytest.mark.parametrize("parts", [1, 4, 32])
def test_aggregates_invariant(table, parts):
    df = table.repartition(parts)
    assert [tuple(r) for r in ex.frequency(df, "g").collect()] == \
        [tuple(r) for r in ex.frequency(table.coalesce(1), "g").collect()]
    got = exact_quantiles(df, ["x"], [0.25, 0.5, 0.75], max_local=100, buckets=8)["x"]
    want = np.quantile(table.toPandas()["x"].dropna(), [0.25, 0.5, 0.75])
    assert np.allclose(got, want, atol=1e-12)
    modes = {r["g"]: r["mode_h"] for r in ex.mode_per_group(df, "g", "h").collect()}
    pdf = table.toPandas()
    for g, sub in pdf.groupby("g"):
        vc = sub["h"].value_counts()
        assert modes[g] == min(vc[vc == vc.max()].index)
    d = quality.duplicate_count(df.select("g", "h")).collect()[0]
    assert d["distinct_rows"] == len(pdf[["g", "h"]].drop_duplicates())


@pytest.mark.parametrize("parts", [1, 7])
def test_dbscan_invariant(spark, parts):
    rng = np.random.default_rng(4)
    X = np.vstack([rng.normal(0.3, 0.02, size=(60, 2)), rng.normal(0.7, 0.02, size=(60, 2)),
                   rng.uniform(0, 1, size=(30, 2))])
    pdf = pd.DataFrame({"id": np.arange(len(X)), "x": X[:, 0], "y": X[:, 1]})
    base = dbscan(spark.createDataFrame(pdf).coalesce(1), "id", "x", "y", 0.05, 5).orderBy("id").toPandas()
    other = dbscan(spark.createDataFrame(pdf).repartition(parts), "id", "x", "y", 0.05, 5).orderBy("id").toPandas()
    assert (base["cluster"].to_numpy() == other["cluster"].to_numpy()).all()
    assert len(base) == len(X)  # every row keeps a label; nothing is dropped
