"""Features, imputation, quantiles (E*, P*, A9) against hand values and brute force."""

import math

import numpy as np
import pytest
import pandas as pd
from pyspark.sql import functions as F

from cohortlens.functions.quantile import exact_quantiles, quantile_table
from cohortlens.operators.features import build_customer_features, engineer_features, impute_median, persona_features

UPLOAD_ROWS = [  # valid upload fixture rows (CUST_ID, TENURE, PURCHASES, PURCHASES_TRX, CASH_ADVANCE,
    # INSTALLMENTS_PURCHASES, ONEOFF_PURCHASES, BALANCE, CREDIT_LIMIT, PAYMENTS, MINIMUM_PAYMENTS,
    # PRC_FULL_PAYMENT, CASH_ADVANCE_TRX)
    ("C10001", 12, 100.0, 2, 0.0, 50.0, 50.0, 1000.0, 5000.0, 100.0, 50.0, 0.1, 0),
    ("C10002", 12, 200.0, 4, 0.0, 100.0, 100.0, 2000.0, 5000.0, 200.0, 100.0, 0.2, 0),
]
UPLOAD_SCHEMA = (
    "CUST_ID string, TENURE long, PURCHASES double, PURCHASES_TRX long, CASH_ADVANCE double, INSTALLMENTS_PURCHASES double, "
    "ONEOFF_PURCHASES double, BALANCE double, CREDIT_LIMIT double, PAYMENTS double, MINIMUM_PAYMENTS double, "
    "PRC_FULL_PAYMENT double, CASH_ADVANCE_TRX long"
)


def test_hand_computed_features(spark):
    df = spark.createDataFrame(UPLOAD_ROWS, UPLOAD_SCHEMA)
    r = build_customer_features(df).where("CUST_ID = 'C10001'").first()
    assert math.isclose(r.monthly_spend, 100 / 12)
    assert r.avg_purchase_ticket == 50
    assert math.isclose(r.transaction_frequency_per_month, 2 / 12)
    assert r.cash_advance_ratio == 0
    assert r.installment_purchase_share == 0.5 and r.oneoff_purchase_share == 0.5
    assert r.credit_utilization_ratio == 0.2
    assert r.payment_to_minimum_ratio == 2.0
    assert r.full_payment_ratio == 0.1 and r.cash_advance_intensity == 0 and r.credit_headroom == 4000


def test_zero_denominators_and_missing_minimum(spark):
    rows = [("A", 0, 0.0, 0, 0.0, 0.0, 0.0, 10.0, 0.0, 5.0, None, 0.0, 0)]
    df = spark.createDataFrame(rows, UPLOAD_SCHEMA)
    r = engineer_features(df).first()
    assert r.monthly_spend == 0 and r.avg_purchase_ticket == 0 and r.cash_advance_ratio == 0
    assert r.credit_utilization_ratio == 0 and r.payment_to_minimum_ratio == 0


def test_median_imputation_interpolates(spark):
    df = spark.createDataFrame([(float(v),) if v is not None else (None,) for v in [1, 2, 3, 4, None]], "x double")
    out = [r.x for r in impute_median(df, ["x"]).collect()]
    assert sorted(out) == [1.0, 2.0, 2.5, 3.0, 4.0]


def test_persona_ratios(spark):
    rows = [("A", 500.0, 1000.0, 100.0, 0.0, 0.0), ("B", 5000.0, 1000.0, 0.0, None, 50.0), ("C", 10.0, None, 30.0, 10.0, 0.0)]
    df = spark.createDataFrame(rows, "CUST_ID string, BALANCE double, CREDIT_LIMIT double, PAYMENTS double, MINIMUM_PAYMENTS double, INSTALLMENTS_PURCHASES double")
    for c in ["BALANCE_FREQUENCY", "PURCHASES", "ONEOFF_PURCHASES", "CASH_ADVANCE", "PURCHASES_FREQUENCY",
              "ONEOFF_PURCHASES_FREQUENCY", "PURCHASES_INSTALLMENTS_FREQUENCY", "CASH_ADVANCE_FREQUENCY", "PRC_FULL_PAYMENT"]:
        df = df.withColumn(c, F.lit(0.0))
    for c in ["CASH_ADVANCE_TRX", "PURCHASES_TRX", "TENURE"]:
        df = df.withColumn(c, F.lit(1).cast("long"))
    out = {r.CUST_ID: r for r in persona_features(df).collect()}
    assert out["A"].CREDIT_UTILIZATION == 0.5 and out["A"].PAYMENT_RATIO == 1.0  # minimum 0 → default 1
    assert out["B"].CREDIT_UTILIZATION == 1.0  # clipped
    assert out["C"].CREDIT_LIMIT == 1000.0  # median of {1000, 1000}
    assert math.isclose(out["B"].INSTALLMENT_RATIO, 50.0 / 1e-5)


def test_quantiles_match_numpy_in_every_group(spark):
    rng = np.random.default_rng(5)
    rows = [("a", float(v)) for v in rng.normal(size=30_000)] + [(None, float(i)) for i in range(5)] + [("hot", 7.0)] * 9000 + [("hot", 8.0), ("one", 3.0)]
    rows += [("inf", v) for v in (float("-inf"), 1.0, 2.0, float("inf"), float("inf"))] + [("none", None), ("nan", float("nan")), ("nan", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    probs = [0.0, 0.25, 0.33, 0.5, 0.67, 1.0]
    got = {(r.g, r.p): r.quantile for r in quantile_table(df, ["v"], probs, ["g"]).collect()}
    for g in ("a", None, "hot", "one", "nan"):
        vals = [v for k, v in rows if k == g and v is not None and not np.isnan(v)]
        for p in probs:
            assert got[g, p] == pytest.approx(np.quantile(vals, p)), (g, p)
    assert got["inf", 0.0] == float("-inf") and got["inf", 0.5] == 2.0 and got["inf", 1.0] == float("inf")
    assert all(got["none", p] is None for p in probs)


def test_quantiles_of_empty_and_null_columns(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, b double")
    assert exact_quantiles(df, ["a", "b"], [0.5]) == {("a", 0.5): None, ("b", 0.5): 1.5}
    assert exact_quantiles(df.limit(0), ["b"], [0.5]) == {("b", 0.5): None}

def test_integer_column_imputation_becomes_float(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "n long")
    out = impute_median(df, ["n"])
    assert dict(out.dtypes)["n"] == "double"
    assert sorted(r.n for r in out.collect()) == [1.0, 2.0, 2.5, 3.0, 4.0]


def test_all_null_column_stays_null(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, b double")
    assert [r.a for r in impute_median(df).collect()] == [None, None]
