import os

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

SQL_CHECKS = ["dow_hour_heatmap", "describe_columns", "fill_median", "feature_matrix", "dbscan_geo_wide",
              "sample_exact", "run_log_flatten", "silhouette_exact"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "Grid_ID" in df.columns and len(df.columns) == 20


def test_registry_consistent():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


@pytest.mark.parametrize("name", SQL_CHECKS)
def test_oracle_agrees_at_small_scale(spark, name):
    con = duckdb.connect()
    for t in ["part", "orders", "lineitem", "events", "documents", "embeddings", "labels"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t + '.parquet')}')")
    df = E.queries()[name](spark, SF_SMALL)
    mine = sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in
                  df.select(*sorted(df.columns)).collect()), key=repr)
    cur = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    idx = sorted(range(len(cols)), key=lambda i: cols[i])
    theirs = sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in idx) for r in cur.fetchall()),
                    key=repr)
    assert mine == theirs
