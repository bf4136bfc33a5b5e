"""Profiling queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens import catalog
from cohortlens.operators import stats
from cohortlens.operators.features import select_features, to_matrix
from cohortlens.operators.lookup import lookup
from cohortlens.plans.common import FEATURE_NAMES, FEATURES_CTE, PROFILE_SQL, features, r4, rounded
from cohortlens.plans.common import profile
from cohortlens.plans.registry import register
from cohortlens.session import ensure_checkpoint_dir
from cohortlens.sources.tables import preview, read_delimited, schema_probe, table, write_table

PROFILE_CTE = "WITH " + PROFILE_SQL
PROFILE_COLS = catalog.REQUIRED_COLUMNS
NUMERIC_PROFILE = catalog.REQUIRED_COLUMNS[1:]
MATRIX_COLS = ["TENURE", *FEATURE_NAMES]


# -- dataset_shape (A1) -----------------------------------------------------------
@register("dataset_shape", PROFILE_CTE + "SELECT count(*) AS row_count, 18 AS column_count FROM profile")
def dataset_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.shape(profile(spark, sf_dir))


# -- missing_profile (A2, A3) ---------------------------------------------------
_MISSING_SQL = (
    PROFILE_CTE
    + ", m AS (SELECT count(*) AS n, "
    + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL{' OR isnan(' + c + ')' if c not in ('CUST_ID', 'CASH_ADVANCE_TRX', 'PURCHASES_TRX', 'TENURE') else ''}) AS m{i}" for i, c in enumerate(PROFILE_COLS))
    + " FROM profile) "
    + " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS column_name, m{i} AS missing_count, "
        f"{r4(f'CASE WHEN n > 0 THEN m{i} * 100.0 / n ELSE 0.0 END')} AS missing_percent FROM m"
        for i, c in enumerate(PROFILE_COLS)
    )
)


@register("missing_profile", _MISSING_SQL)
def missing_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.missing_profile(profile(spark, sf_dir)))


@register(
    "top_missing",
    "SELECT * FROM (" + _MISSING_SQL + ") ORDER BY missing_count DESC, position ASC LIMIT 3",
)
def top_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.top_missing(profile(spark, sf_dir), 3))


# -- numeric_describe (A4) ------------------------------------------------------
_NUMERIC_DESCRIBE_SQL = (
    PROFILE_CTE
    + ", long AS (SELECT * FROM (UNPIVOT (SELECT "
    + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in NUMERIC_PROFILE)
    + " FROM profile) ON "
    + ", ".join(NUMERIC_PROFILE)
    + " INTO NAME column_name VALUE v)) SELECT column_name, count(v) AS count, "
    + f"{r4('avg(v)')} AS mean, {r4('stddev_samp(v)')} AS std, {r4('min(v)')} AS min, "
    + f"{r4('quantile_cont(v, 0.25)')} AS q25, {r4('quantile_cont(v, 0.5)')} AS q50, "
    + f"{r4('quantile_cont(v, 0.75)')} AS q75, {r4('max(v)')} AS max FROM long GROUP BY column_name"
)


@register("numeric_describe", _NUMERIC_DESCRIBE_SQL)
def numeric_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.numeric_describe(profile(spark, sf_dir)))


# -- categorical_summary (A5) on the raw customer table -------------------------
@register(
    "categorical_summary",
    """WITH long AS (SELECT 'c_name' AS column_name, c_name AS value FROM customer
              UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer),
vc AS (SELECT column_name, value, count(*) AS cnt FROM long GROUP BY column_name, value),
r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, value IS NULL, value) AS rn,
             count(*) OVER (PARTITION BY column_name) AS n_unique FROM vc)
SELECT column_name, n_unique, value AS top, cnt AS frequency FROM r WHERE rn = 1""",
)
def categorical_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.categorical_summary(table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"])


# -- correlation_long (A6) ------------------------------------------------------
def _corr_sql() -> str:
    cols = NUMERIC_PROFILE
    pairs = list(combinations(range(len(cols)), 2)) + [(i, i) for i in range(len(cols))]
    exprs = []
    for i, j in pairs:
        a, b = f"CAST({cols[i]} AS DOUBLE)", f"CAST({cols[j]} AS DOUBLE)"
        both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
        cov = f"covar_samp(CASE WHEN {both} THEN {a} END, CASE WHEN {both} THEN {b} END)"
        den = f"(stddev_samp(CASE WHEN {both} THEN {a} END) * stddev_samp(CASE WHEN {both} THEN {b} END))"
        exprs.append(f"coalesce(CASE WHEN {den} = 0 THEN NULL ELSE {cov} / {den} END, 0.0) AS r_{i}_{j}")
    rows = []
    for i, j in pairs:
        rows.append(f"SELECT '{cols[i]}' AS col_x, '{cols[j]}' AS col_y, {r4(f'r_{i}_{j}')} AS corr FROM w")
        if i != j:
            rows.append(f"SELECT '{cols[j]}' AS col_x, '{cols[i]}' AS col_y, {r4(f'r_{i}_{j}')} AS corr FROM w")
    return PROFILE_CTE + ", w AS (SELECT " + ", ".join(exprs) + " FROM profile) " + " UNION ALL ".join(rows)


@register("correlation_long", _corr_sql())
def correlation_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.correlation_long(profile(spark, sf_dir), NUMERIC_PROFILE))


# -- tier_thresholds (A9) -------------------------------------------------------
@register(
    "tier_thresholds",
    FEATURES_CTE
    + f"""SELECT {r4('quantile_cont(monthly_spend, 0.67)')} AS spend_q67,
       {r4('quantile_cont(monthly_spend, 0.33)')} AS spend_q33,
       {r4('quantile_cont(transaction_frequency_per_month, 0.67)')} AS frequency_q67,
       {r4('quantile_cont(transaction_frequency_per_month, 0.33)')} AS frequency_q33,
       {r4('median(credit_headroom)')} AS credit_headroom_median FROM feat""",
)
def tier_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.tier_thresholds(features(spark, sf_dir)))


# -- matrix_profile (A8) and feature_summary (A7) ---------------------------------
@register(
    "matrix_profile",
    FEATURES_CTE
    + ", w AS (SELECT count(*) AS row_count, "
    + ", ".join(f"min({c}) AS lo{i}, max({c}) AS hi{i}, var_samp({c}) AS v{i}" for i, c in enumerate(MATRIX_COLS))
    + " FROM feat) "
    + " UNION ALL ".join(
        f"SELECT row_count, {len(MATRIX_COLS)} AS feature_count, '{c}' AS feature, {r4(f'lo{i}')} AS minimum, "
        f"{r4(f'hi{i}')} AS maximum, {r4(f'v{i}')} AS variance FROM w"
        for i, c in enumerate(MATRIX_COLS)
    ),
)
def matrix_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = to_matrix(features(spark, sf_dir))
    return rounded(stats.matrix_profile(m, MATRIX_COLS))


@register(
    "feature_summary",
    FEATURES_CTE
    + ", w AS (SELECT "
    + ", ".join(f"avg({c}) AS a{i}, stddev_samp({c}) AS s{i}, min({c}) AS lo{i}, max({c}) AS hi{i}" for i, c in enumerate(MATRIX_COLS))
    + " FROM feat) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {r4(f'a{i}')} AS mean, {r4(f's{i}')} AS std, {r4(f'lo{i}')} AS min, {r4(f'hi{i}')} AS max, "
        f"{len(MATRIX_COLS)} AS feature_count FROM w"
        for i, c in enumerate(MATRIX_COLS)
    ),
)
def feature_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.feature_summary(features(spark, sf_dir), MATRIX_COLS))


# -- identifier_uniqueness (A19, D1, X3) ------------------------------------------
def _ident_sql() -> str:
    parts = []
    for pos, c in enumerate(PROFILE_COLS):
        nn = "".join(ch for ch in c.lower() if ch.isalnum())
        if nn.endswith("id"):
            nd = f"(SELECT count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) FROM profile)"
            ratio = f"({nd} / greatest((SELECT count(*) FROM profile), 1))"
        else:
            nd, ratio = "CAST(NULL AS BIGINT)", "CAST(NULL AS DOUBLE)"
        cust_name = "custid" in nn or ("customer" in nn and "id" in nn)
        cust = "true" if cust_name else (f"({ratio} > 0.9)" if nn.endswith("id") else "false")
        txn = "transactionid" in nn or ("trans" in nn and "id" in nn) or ("txn" in nn and "id" in nn)
        parts.append(
            f"SELECT {pos} AS position, '{c}' AS column_name, '{nn}' AS normalized_name, {nd} AS n_distinct, "
            f"{r4(ratio)} AS uniqueness_ratio, {cust} AS customer_rule, {'true' if txn else 'false'} AS transaction_rule"
        )
    return PROFILE_CTE + " " + " UNION ALL ".join(parts)


@register("identifier_uniqueness", _ident_sql())
def identifier_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.identifier_candidates(profile(spark, sf_dir)))


# -- lookup_top_n (P5 + W1) ---------------------------------------------------------
@register(
    "lookup_top_n",
    PROFILE_CTE + f"SELECT CUST_ID, {r4('PURCHASES')} AS PURCHASES, {r4('BALANCE')} AS BALANCE FROM profile "
    "ORDER BY PURCHASES DESC, CUST_ID LIMIT 10",
)
def lookup_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    prof = profile(spark, sf_dir)
    return rounded(lookup(prof, ["CUST_ID", "PURCHASES", "BALANCE", "AGE"], top_n=10, tiebreak="CUST_ID"))


# -- delimited_round_trip (S1-S3) ------------------------------------------------------
@register(
    "delimited_round_trip",
    PROFILE_CTE + " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS column_name, count({c}) AS filled_rows, CAST(min({c}) AS VARCHAR) = CAST(min({c}) AS VARCHAR) AS same FROM profile"
        for i, c in enumerate(catalog.REQUIRED_COLUMNS)),
)
def delimited_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile written as delimited text to the shared folder and read back with
    its schema: per column the filled rows, and whether extremes came back the same."""

    import uuid

    prof = profile(spark, sf_dir)
    path = write_table(prof, f"{ensure_checkpoint_dir(spark).rstrip('/')}/cohortlens-tables/delimited-{uuid.uuid4().hex}", "csv")
    back = read_delimited(spark, path, prof.schema)
    cols = schema_probe(back)
    ends = [F.struct(F.min(c), F.max(c)).alias(f"e{i}") for i, c in enumerate(cols)]
    new = back.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(cols)], *ends)
    old = prof.agg(*[x.alias(f"o{i}") for i, x in enumerate(ends)])
    entries = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"), F.col(f"n{i}").alias("filled_rows"), F.col(f"e{i}").eqNullSafe(F.col(f"o{i}")).alias("same")) for i, c in enumerate(cols)]
    return new.crossJoin(old).select(F.inline(F.array(*entries)))


# -- ranked_features (E18) ---------------------------------------------------------------
_RANKED = ["monthly_spend", "not_a_feature", "TENURE", "credit_headroom"]


@register("ranked_features", FEATURES_CTE + f"SELECT CUST_ID, {r4('monthly_spend')} AS monthly_spend, TENURE, {r4('credit_headroom')} AS credit_headroom FROM feat")
def ranked_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    feat = features(spark, sf_dir)
    return rounded(feat.select("CUST_ID", *select_features(feat, _RANKED)))


# -- sample_rows (S7) -----------------------------------------------------------------
@register(
    "sample_rows",
    PROFILE_CTE
    + "SELECT CUST_ID, "
    + ", ".join(f"{r4(c)} AS {c}" if c not in ("CASH_ADVANCE_TRX", "PURCHASES_TRX", "TENURE") else c for c in NUMERIC_PROFILE)
    + " FROM profile ORDER BY CUST_ID LIMIT 5",
)
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(preview(profile(spark, sf_dir), 5, "CUST_ID"))


# -- dataset_report (D2, S12): tidy report rows -------------------------------------
def _report_sql() -> str:
    desc = _NUMERIC_DESCRIBE_SQL
    metrics = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]
    num = " UNION ALL ".join(
        f"SELECT 'numeric' AS section, column_name, '{m}' AS metric, {r4(f'd.{m}')} AS value, CAST(NULL AS VARCHAR) AS text FROM ({desc}) d WHERE d.{m} IS NOT NULL"
        for m in metrics
    )
    return f"""SELECT 'shape' AS section, CAST(NULL AS VARCHAR) AS column_name, 'row_count' AS metric, CAST(count(*) AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS text
FROM ({PROFILE_CTE} SELECT * FROM profile) p
UNION ALL SELECT 'shape', NULL, 'column_count', 18.0, NULL
UNION ALL SELECT 'missing', column_name, 'missing_count', CAST(missing_count AS DOUBLE), NULL FROM ({_MISSING_SQL}) m
UNION ALL SELECT 'missing', column_name, 'missing_percent', missing_percent, NULL FROM ({_MISSING_SQL}) m
UNION ALL {num}
UNION ALL SELECT 'categorical', 'CUST_ID', 'unique', CAST(count(DISTINCT CUST_ID) + max(CASE WHEN CUST_ID IS NULL THEN 1 ELSE 0 END) AS DOUBLE), NULL FROM ({PROFILE_CTE} SELECT * FROM profile) p
UNION ALL SELECT 'categorical', 'CUST_ID', 'top', NULL, (SELECT CUST_ID FROM ({PROFILE_CTE} SELECT CUST_ID, count(*) AS c FROM profile GROUP BY CUST_ID) ORDER BY c DESC, CUST_ID LIMIT 1)
UNION ALL SELECT 'categorical', 'CUST_ID', 'frequency', (SELECT CAST(max(c) AS DOUBLE) FROM ({PROFILE_CTE} SELECT count(*) AS c FROM profile GROUP BY CUST_ID)), NULL
UNION ALL SELECT 'identifiers', NULL, 'customer_identifier', NULL, 'CUST_ID'
UNION ALL SELECT 'identifiers', NULL, 'transaction_identifier', NULL, NULL
UNION ALL SELECT 'notes', NULL, 'note', NULL, 'Dataset is customer-level, so no transaction identifier was detected.'"""


@register("dataset_report", _report_sql())
def dataset_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.dataset_report(profile(spark, sf_dir)))
