"""Queries over the derived profile and feature table (E*, P*, M1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens import catalog
from cohortlens.functions.quantile import quantile_table, quantiles_wide
from cohortlens.operators.features import missing_required, persona_features
from cohortlens.operators.scaling import standardize
from cohortlens.plans.common import FEATURE_NAMES, FEATURES_CTE, PROFILE_SQL, features, r4, rounded
from cohortlens.plans.common import profile
from cohortlens.plans.registry import register


# -- feature_table: the 13-column feature table (E1, E3-E14) ------------------
@register(
    "feature_table",
    FEATURES_CTE + "SELECT CUST_ID, TENURE, " + ", ".join(f"{r4(c)} AS {c}" for c in FEATURE_NAMES) + " FROM feat",
)
def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features(spark, sf_dir))


# -- feature_by_segment: flagship (join → aggregate → impute → features → groupBy)
def feature_by_segment_df(feat: DataFrame) -> DataFrame:
    """Per market segment: customers, median monthly spend and utilization.

    Medians per segment come from the distributed exact quantile (segments
    are a low-cardinality key); counts and means from one hash aggregate.
    """

    seg = "c_mktsegment"
    base = feat.groupBy(seg).agg(F.count(F.lit(1)).alias("n_customers"), F.avg("monthly_spend").alias("avg_monthly_spend"))
    medians = {"median_monthly_spend": ("monthly_spend", 0.5), "median_credit_utilization": ("credit_utilization_ratio", 0.5)}
    wide = quantiles_wide(feat, medians, by=[seg]).withColumnRenamed(seg, "segment_")
    joined = base.join(wide, base[seg].eqNullSafe(wide["segment_"]), "left")
    return joined.select(seg, "n_customers", "avg_monthly_spend", *medians)


@register(
    "feature_by_segment",
    FEATURES_CTE.replace("SELECT 'C' || CAST(10000 + c_custkey AS VARCHAR) AS CUST_ID,", "SELECT 'C' || CAST(10000 + c_custkey AS VARCHAR) AS CUST_ID, c_mktsegment,")
    .replace("SELECT CUST_ID, TENURE,", "SELECT CUST_ID, c_mktsegment, TENURE,")
    + f"""SELECT c_mktsegment, count(*) AS n_customers, {r4('avg(monthly_spend)')} AS avg_monthly_spend,
       {r4('median(monthly_spend)')} AS median_monthly_spend,
       {r4('median(credit_utilization_ratio)')} AS median_credit_utilization
FROM feat GROUP BY c_mktsegment""",
)
def feature_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(feature_by_segment_df(features(spark, sf_dir, keep=("c_mktsegment",))))


# -- impute_medians: E1 medians of the profile's numeric columns --------------
_PROFILE_NUMERIC = catalog.REQUIRED_COLUMNS[1:]


@register(
    "impute_medians",
    "WITH "
    + PROFILE_SQL
    + ", m AS (SELECT "
    + ", ".join(f"{r4(f'median({c})')} AS {c}" for c in _PROFILE_NUMERIC)
    + " FROM profile) SELECT * FROM (UNPIVOT m ON "
    + ", ".join(_PROFILE_NUMERIC)
    + " INTO NAME column_name VALUE median_value)",
)
def impute_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    prof = profile(spark, sf_dir)
    return rounded(quantile_table(prof, _PROFILE_NUMERIC, [0.5]).select("column_name", F.col("quantile").alias("median_value")))


# -- required_columns_ok: P4 over the derived profile ---------------------------
@register(
    "required_columns_ok",
    "WITH " + PROFILE_SQL + " " + " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS column_name, true AS present, count({c}) AS filled_rows FROM profile" for i, c in enumerate(catalog.REQUIRED_COLUMNS)),
)
def required_columns_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each required column, whether the profile has it and how many rows fill it."""

    prof = profile(spark, sf_dir)
    missing = missing_required(prof)
    entries = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"), F.lit(c not in missing).alias("present"),
                        (F.lit(0).cast("long") if c in missing else F.col(f"n{i}")).alias("filled_rows")) for i, c in enumerate(catalog.REQUIRED_COLUMNS)]
    counts = prof.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(catalog.REQUIRED_COLUMNS) if c not in missing])
    return counts.select(F.inline(F.array(*entries)))


# -- persona_features: E2 + E15-E17 ---------------------------------------------
_PERSONA_SQL = (
    "WITH "
    + PROFILE_SQL
    + """,
med AS (SELECT median(CREDIT_LIMIT) AS m_cl, median(MINIMUM_PAYMENTS) AS m_mp FROM profile),
imp AS (
  SELECT p.* REPLACE (coalesce(CREDIT_LIMIT, m_cl) AS CREDIT_LIMIT, coalesce(MINIMUM_PAYMENTS, m_mp) AS MINIMUM_PAYMENTS)
  FROM profile p, med
),
pf AS (
  SELECT *,
    least({sd('BALANCE', 'CREDIT_LIMIT')}, 1.0) AS CREDIT_UTILIZATION,
    {sd('PAYMENTS', 'MINIMUM_PAYMENTS', '1.0')} AS PAYMENT_RATIO,
    INSTALLMENTS_PURCHASES / (PURCHASES + 1e-5) AS INSTALLMENT_RATIO
  FROM imp
)
"""
)
from cohortlens.plans.common import render  # noqa: E402

PERSONA_CTE = render(_PERSONA_SQL)
PERSONA_OUT = ["BALANCE", "PURCHASES", "CASH_ADVANCE", "CREDIT_LIMIT", "MINIMUM_PAYMENTS",
               "CREDIT_UTILIZATION", "PAYMENT_RATIO", "INSTALLMENT_RATIO", "PURCHASES_FREQUENCY"]


@register(
    "persona_features",
    PERSONA_CTE + "SELECT CUST_ID, " + ", ".join(f"{r4(c)} AS {c}" for c in PERSONA_OUT) + " FROM pf",
)
def persona_features_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    pf = persona_features(profile(spark, sf_dir))
    return rounded(pf.select("CUST_ID", *PERSONA_OUT))


# -- standardize: M1 on the six persona columns --------------------------------
@register(
    "standardize",
    PERSONA_CTE
    + ", st AS (SELECT "
    + ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in catalog.PERSONA_CLUSTER_FEATURES)
    + " FROM pf) SELECT CUST_ID, "
    + ", ".join(
        f"{r4(f'CASE WHEN s_{c} = 0 OR s_{c} IS NULL THEN 0.0 ELSE ({c} - a_{c}) / s_{c} END')} AS z_{c}"
        for c in catalog.PERSONA_CLUSTER_FEATURES
    )
    + " FROM pf, st",
)
def standardize_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    pf = persona_features(profile(spark, sf_dir))
    z = standardize(pf, catalog.PERSONA_CLUSTER_FEATURES, prefix="z_")
    return rounded(z.select("CUST_ID", *[f"z_{c}" for c in catalog.PERSONA_CLUSTER_FEATURES]))
