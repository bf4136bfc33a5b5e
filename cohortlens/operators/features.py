"""Imputation and behavioural features.

Imputation values are exact medians computed by a distributed aggregation
(``exact_quantiles``) and folded into the plan as literals, so the feature
projection itself is one narrow, codegen'd stage with no join and no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens import catalog
from cohortlens.functions.expr import clip_upper, coerce_number, eps_ratio, safe_divide
from cohortlens.functions.quantile import medians


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns in schema order."""

    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def non_numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, T.NumericType)]


def feature_columns(df: DataFrame, id_col: str = "CUST_ID") -> list[str]:
    """Every column except the id."""

    return [c for c in df.columns if c != id_col]


def missing_required(df: DataFrame, required: Sequence[str] = catalog.REQUIRED_COLUMNS) -> list[str]:
    """Required columns absent from the schema (no job)."""

    have = set(df.columns)
    return [c for c in required if c not in have]


def require_columns(df: DataFrame, required: Sequence[str] = catalog.REQUIRED_COLUMNS) -> DataFrame:
    missing = missing_required(df, required)
    if missing:
        raise ValueError(f"Dataset missing required columns: {missing}")
    return df


def impute_median(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Fill NULL (and NaN) with the column median.

    Only columns that actually hold missing values are aggregated; a column
    that is entirely missing stays missing (the median is undefined).
    """

    cols = list(columns) if columns is not None else numeric_columns(df)
    if not cols:
        return df
    float_cols = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    miss = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count_if(F.col(c).isNull() | (F.isnan(c) if c in float_cols else F.lit(False))).alias(c) for c in cols],
    ).first()
    todo = [c for c in cols if miss[c]]
    if not todo:
        return df
    med = medians(df, todo)
    out = []
    for f in df.schema.fields:
        c = f.name
        if c in todo and med[c] is not None:
            # like pandas, a filled integer column becomes floating (its median may be x.5)
            base = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
            out.append(F.coalesce(base, F.lit(float(med[c]))).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def engineer_features(imputed: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """E3-E14 on an imputed profile: the 13-column feature table (F2).

    ``keep`` carries extra columns (e.g. a market segment) through unchanged.
    """

    c = F.col
    return imputed.select(
        c("CUST_ID"),
        *[c(k) for k in keep],
        c("TENURE"),
        safe_divide("PURCHASES", "TENURE").alias("monthly_spend"),
        safe_divide("PURCHASES", "PURCHASES_TRX").alias("avg_purchase_ticket"),
        safe_divide("PURCHASES_TRX", "TENURE").alias("transaction_frequency_per_month"),
        safe_divide("CASH_ADVANCE", c("CASH_ADVANCE") + c("PURCHASES")).alias("cash_advance_ratio"),
        safe_divide("INSTALLMENTS_PURCHASES", "PURCHASES").alias("installment_purchase_share"),
        safe_divide("ONEOFF_PURCHASES", "PURCHASES").alias("oneoff_purchase_share"),
        safe_divide("BALANCE", "CREDIT_LIMIT").alias("credit_utilization_ratio"),
        safe_divide("PAYMENTS", "MINIMUM_PAYMENTS").alias("payment_to_minimum_ratio"),
        c("PRC_FULL_PAYMENT").cast("double").alias("full_payment_ratio"),
        safe_divide("CASH_ADVANCE_TRX", "TENURE").alias("cash_advance_intensity"),
        (c("CREDIT_LIMIT").cast("double") - c("BALANCE").cast("double")).alias("credit_headroom"),
    )


def build_customer_features(profile: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """E1 then E3-E14 (the segmentation path feature table)."""

    cols = [c for c in numeric_columns(profile) if c not in keep]
    return engineer_features(impute_median(profile, cols), keep)


def persona_features(profile: DataFrame) -> DataFrame:
    """E2 + E15-E17 (persona path): impute two columns, add three ratios."""

    require_columns(profile)
    df = impute_median(profile, ["MINIMUM_PAYMENTS", "CREDIT_LIMIT"])
    return df.select(
        "*",
        clip_upper(safe_divide("BALANCE", "CREDIT_LIMIT", 0.0), 1.0).alias("CREDIT_UTILIZATION"),
        safe_divide("PAYMENTS", "MINIMUM_PAYMENTS", 1.0).alias("PAYMENT_RATIO"),
        eps_ratio("INSTALLMENTS_PURCHASES", "PURCHASES").alias("INSTALLMENT_RATIO"),
    )


def select_features(features: DataFrame, ranked: Sequence[str] | None = None, id_col: str = "CUST_ID") -> list[str]:
    """Ordered feature list; unknown names dropped; empty → all features."""

    available = feature_columns(features, id_col)
    if not ranked:
        return available
    chosen = [f for f in ranked if f in available]
    return chosen or available


def to_matrix(features: DataFrame, id_col: str = "CUST_ID", cols: Sequence[str] | None = None) -> DataFrame:
    """Id + every feature coerced to double with unparsable/NULL → 0."""

    cols = list(cols) if cols is not None else feature_columns(features, id_col)
    types = dict((f.name, f.dataType) for f in features.schema.fields)
    out = []
    for c in cols:
        if isinstance(types[c], T.NumericType):
            v = F.col(c).cast("double")
            out.append(F.coalesce(F.nanvl(v, F.lit(None).cast("double")), F.lit(0.0)).alias(c))
        else:
            out.append(coerce_number(F.col(c)).alias(c))
    return features.select(F.col(id_col), *out)
