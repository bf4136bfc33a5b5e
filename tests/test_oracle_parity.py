"""Every registered query with an oracle matches DuckDB at sf0.001 (the driver's gate runs sf0.01)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from tools.oracle_check import digest  # noqa: E402

SF = "/root/testdata/sf0.001"
FAST = ["feature_by_segment", "missing_profile", "numeric_describe", "correlation_long", "cluster_profile",
        "boundary_metrics", "rule_explanations", "cluster_recommendations", "persona_top_n", "kmeans_step",
        "silhouette", "unsupported_filters", "ambiguity", "node_stats", "graph_view", "log_reuse"]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    from cohortlens.sources.tables import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", FAST)
def test_parity(spark, duck, name):
    df = E.queries()[name](spark, SF)
    s_rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(E.oracle_sql()[name])
    d_cols = [d[0] for d in cur.description]
    d_rows = cur.fetchall()
    assert sorted(df.columns) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert digest(df.columns, s_rows)[0] == digest(d_cols, d_rows)[0]


def test_entry_smoke(spark):
    out = E.entry(spark)
    assert out.count() > 0 and "median_monthly_spend" in out.columns


def test_every_query_has_known_kind():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 50
