"""Profiling aggregates against pandas."""

import math

import numpy as np
import pandas as pd

from cohortlens.operators import stats


def test_correlation_matches_pandas_pairwise(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.normal(size=400), "b": rng.normal(size=400), "c": np.ones(400)})
    pdf["b"] += pdf["a"] * 0.5
    pdf.loc[::7, "a"] = np.nan
    pdf.loc[::11, "b"] = np.nan
    want = pdf.corr().round(4).fillna(0.0)
    got = stats.correlation_long(spark.createDataFrame(pdf), ["a", "b", "c"]).collect()
    assert len(got) == 9
    for r in got:
        assert math.isclose(round(r.corr, 4), want.loc[r.col_x, r.col_y], abs_tol=1e-4), (r, want)


def test_missing_describe_categorical(spark):
    pdf = pd.DataFrame({"id": ["x", "y", "z", "z"], "v": [1.0, None, 3.0, 4.0]})
    df = spark.createDataFrame(pdf)
    miss = {r.column_name: (r.missing_count, r.missing_percent) for r in stats.missing_profile(df).collect()}
    assert miss["v"] == (1, 25.0) and miss["id"] == (0, 0.0)
    d = stats.numeric_describe(df).first()
    desc = pdf["v"].describe()
    assert d["count"] == 3 and math.isclose(d["std"], desc["std"]) and d["q50"] == desc["50%"] and d["q25"] == desc["25%"]
    c = stats.categorical_summary(df).first()
    assert (c.n_unique, c.top, c.frequency) == (3, "z", 2)


def test_identifier_detection(spark):
    df = spark.createDataFrame([("C1", "T1", 1), ("C2", "T2", 2)], "CUST_ID string, txn_id string, amount int")
    assert stats.identify_identifiers(df) == ("CUST_ID", "txn_id")
    df2 = spark.createDataFrame([(1, 1), (2, 1)], "row_id int, other int")
    assert stats.identify_identifiers(df2) == ("row_id", None)


def test_uniqueness_exact_and_approx(spark):
    df = spark.createDataFrame([(i, i % 3, None if i % 2 else "x") for i in range(100)], "a int, b int, c string")
    exact = {r.column_name: r.n_distinct for r in stats.uniqueness(df).collect()}
    approx = {r.column_name: r.n_distinct for r in stats.uniqueness(df, approx=True).collect()}
    assert exact == {"a": 100, "b": 3, "c": 2}
    assert approx["b"] == 3 and approx["c"] == 2 and abs(approx["a"] - 100) <= 3
