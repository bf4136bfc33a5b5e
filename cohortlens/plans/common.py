"""Shared building blocks for the registered queries (Spark and SQL side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.expr import round_half_up  # noqa: F401
from cohortlens.operators.features import build_customer_features
from cohortlens.session import on_drop
from cohortlens.sources.profile import PROFILE_SQL, load_profile

R = 4  # decimals for doubles in registered query outputs


def rounded(df: DataFrame, digits: int = R) -> DataFrame:
    """Round every double column (and doubles inside arrays) for stable hashing."""

    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(round_half_up(F.col(f.name), digits).alias(f.name))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.DoubleType, T.FloatType)):
            out.append(F.transform(F.col(f.name), lambda x: round_half_up(x, digits)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


CARRY = ("c_mktsegment",)  # customer columns carried through the materialised tables


def profile(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The derived customer profile, materialised once per session (with the
    carried customer columns); each caller sees the 18 columns plus ``keep``."""

    from cohortlens import catalog
    from cohortlens.session import materialize

    full = materialize(load_profile(spark, sf_dir, CARRY), "profile", (sf_dir, CARRY))
    return full.select(*catalog.REQUIRED_COLUMNS, *keep)


def features(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The feature table (E1, E3-E14), materialised once per session."""

    from cohortlens import catalog
    from cohortlens.session import materialize, reuse

    full = reuse(spark, "features", (sf_dir, CARRY))
    if full is None:
        full = materialize(build_customer_features(profile(spark, sf_dir, CARRY), CARRY), "features", (sf_dir, CARRY))
    return full.select("CUST_ID", *keep, *catalog.FEATURE_COLUMNS)


def fixed_label(id_col: str = "CUST_ID", k: int = 3) -> Column:
    """Deterministic fixed labels for the persona path: id number mod k."""

    return (F.substring(F.col(id_col), 2, 100).cast("bigint") % k).cast("int")


#: Fixed cut points on the feature values: every customer's behavioural label.
#: -1 is noise; 5 pays in full, 6 buys exactly once a month, 0 spends much and
#: often, 1 relies on cash advances, 2 uses most of the limit, 3 buys little.
#: The same text is read by Spark and by the SQL twin.
BEHAVIOUR_LABEL = """CAST(CASE
  WHEN TENURE = 6 AND monthly_spend < 90000 THEN -1
  WHEN full_payment_ratio >= 0.9 AND oneoff_purchase_share >= 0.35 THEN 5
  WHEN transaction_frequency_per_month = 1.0 THEN 6
  WHEN monthly_spend >= 300000 AND transaction_frequency_per_month >= 1.2 THEN 0
  WHEN cash_advance_ratio >= 0.3 THEN 1
  WHEN credit_utilization_ratio >= 0.8 THEN 2
  WHEN monthly_spend <= 150000 OR transaction_frequency_per_month <= 0.6 THEN 3
  ELSE 4 END AS INT)"""


def behaviour_label() -> Column:
    return F.expr(BEHAVIOUR_LABEL)


# ---- SQL side -------------------------------------------------------------

FEATURES_SQL = (
    "WITH "
    + PROFILE_SQL
    + """,
med AS (
  SELECT median(CREDIT_LIMIT) AS m_cl, median(MINIMUM_PAYMENTS) AS m_mp FROM profile
),
imp AS (
  SELECT p.* REPLACE (coalesce(CREDIT_LIMIT, m_cl) AS CREDIT_LIMIT, coalesce(MINIMUM_PAYMENTS, m_mp) AS MINIMUM_PAYMENTS)
  FROM profile p, med
),
feat AS (
  SELECT CUST_ID, TENURE,
    {sd('PURCHASES', 'TENURE')} AS monthly_spend,
    {sd('PURCHASES', 'PURCHASES_TRX')} AS avg_purchase_ticket,
    {sd('PURCHASES_TRX', 'TENURE')} AS transaction_frequency_per_month,
    {sd('CASH_ADVANCE', '(CASH_ADVANCE + PURCHASES)')} AS cash_advance_ratio,
    {sd('INSTALLMENTS_PURCHASES', 'PURCHASES')} AS installment_purchase_share,
    {sd('ONEOFF_PURCHASES', 'PURCHASES')} AS oneoff_purchase_share,
    {sd('BALANCE', 'CREDIT_LIMIT')} AS credit_utilization_ratio,
    {sd('PAYMENTS', 'MINIMUM_PAYMENTS')} AS payment_to_minimum_ratio,
    CAST(PRC_FULL_PAYMENT AS DOUBLE) AS full_payment_ratio,
    {sd('CASH_ADVANCE_TRX', 'TENURE')} AS cash_advance_intensity,
    CREDIT_LIMIT - BALANCE AS credit_headroom
  FROM imp
)
"""
)


def sd(num: str, den: str, default: str = "0.0") -> str:
    """SQL safe divide matching ``safe_divide``."""

    return (
        f"(CASE WHEN ({den}) IS NULL OR CAST({den} AS DOUBLE) = 0 OR isinf(CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE)) "
        f"OR isnan(CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE)) OR ({num}) IS NULL "
        f"THEN {default} ELSE CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) END)"
    )


def render(sql: str) -> str:
    """Expand ``{sd(...)}`` templates used in the SQL strings."""

    import re

    def repl(m):
        return eval(m.group(1), {"sd": sd})  # noqa: S307 - trusted literal templates in this package

    return re.sub(r"\{(sd\([^{}]*\))\}", repl, sql)


FEATURES_CTE = render(FEATURES_SQL)

FEATURE_NAMES = [
    "monthly_spend", "avg_purchase_ticket", "transaction_frequency_per_month", "cash_advance_ratio",
    "installment_purchase_share", "oneoff_purchase_share", "credit_utilization_ratio",
    "payment_to_minimum_ratio", "full_payment_ratio", "cash_advance_intensity", "credit_headroom",
]


def r4(expr: str, digits: int = R) -> str:
    """SQL twin of ``round_half_up``."""

    scale = f"{float(10**digits)}"
    return f"(floor(CAST({expr} AS DOUBLE) * {scale} + 0.5) / {scale} + 0.0)"


_FITS: dict = {}
on_drop(_FITS.clear)


def kmeans_result(spark: SparkSession, sf_dir: str, k: int = 3):
    """The fitted k-means segments of the feature table (M2 + M10), labels
    materialised; fitted once per session and input."""

    from cohortlens.operators.registry import segment
    from cohortlens.session import input_state, materialize

    key = (spark.sparkContext.applicationId, sf_dir, k, input_state(spark, sf_dir))
    if key not in _FITS:
        res = segment(features(spark, sf_dir), algorithm="kmeans", params={"n_clusters": k})
        res.labels = materialize(res.labels, "kmeans_labels", (sf_dir, k))
        _FITS[key] = res
    return _FITS[key]


def kmeans_labels(spark: SparkSession, sf_dir: str, k: int = 3) -> DataFrame:
    """(CUST_ID, cluster_label) of the fitted k-means segments."""

    return kmeans_result(spark, sf_dir, k).labels


def persona_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted persona clustering (M15) of the profile, materialised once per session."""

    from cohortlens.operators.personas import fit_personas
    from cohortlens.session import materialize, reuse

    known = reuse(spark, "personas", (sf_dir,))
    if known is not None:
        return known
    return materialize(fit_personas(profile(spark, sf_dir)), "personas", (sf_dir,))
