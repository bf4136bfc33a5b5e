"""Combined views."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.expr import round_half_up
from cohortlens.operators import explain as H
from cohortlens.operators import personas as P
from cohortlens.operators import querylog as L
from cohortlens.operators import segments as S
from cohortlens.plans.common import r4
from cohortlens.plans.q_segments import LAB_CTE, MATRIX_COLS, PERSONA_JOIN_CTE, RECS_CTE, RULE_CTE, _rules, labelled, labelled_matrix, with_personas
from cohortlens.plans.registry import register
from cohortlens.session import ensure_checkpoint_dir, remember

PANEL_CTE = RULE_CTE + RECS_CTE[len(LAB_CTE):]


@register(
    "explanation_panel",
    PANEL_CTE + """ SELECT e.customer_id, e.cluster_label, e.explanation, coalesce(r.tier, '') AS tier,
  coalesce(r.message, '') AS primary_recommendation, coalesce(array_to_string(r.tags, '|'), '') AS behavioral_products
FROM expl e LEFT JOIN recs r ON r.cluster_label = e.cluster_label ORDER BY e.customer_id LIMIT 25""",
)
def explanation_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7 + W8: explanations ⟕ customer recommendations ⟕ tiers, '' defaults,
    first 25 customers by id (TakeOrderedAndProject)."""

    first = _rules(spark, sf_dir).select("customer_id", "cluster_label", "explanation").orderBy("customer_id").limit(25)
    recs = S.cluster_recommendations(labelled(spark, sf_dir)).select("cluster_label", "tier", "message", "behavioral_products")
    return first.join(recs, "cluster_label", "left").select(
        "customer_id", "cluster_label", "explanation", F.coalesce("tier", F.lit("")).alias("tier"),
        F.coalesce("message", F.lit("")).alias("primary_recommendation"),
        F.coalesce(F.array_join("behavioral_products", "|"), F.lit("")).alias("behavioral_products"),
    )


@register("product_catalog", RECS_CTE + " SELECT DISTINCT unnest(cross_sell) AS product FROM recs")
def product_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4: every product recommended to some cluster (explode + distinct)."""

    recs = S.cluster_recommendations(labelled(spark, sf_dir))
    return recs.select(F.explode("cross_sell").alias("product")).distinct()


@register(
    "explanation_counts",
    LAB_CTE + """, own AS (SELECT * FROM lab WHERE cluster_label >= 0), low AS (SELECT min(cluster_label) AS l FROM own)
SELECT 'rule_based' AS explainer_used, 'as_requested' AS explainer_reason, CAST(1 AS BIGINT) AS n_queries, count(*) AS customer_count, count(DISTINCT cluster_label) AS segment_count FROM own
UNION ALL SELECT 'rule_based', 'one_segment', 1, count(*), 1 FROM own, low WHERE cluster_label = l
UNION ALL SELECT 'none', 'no_centers', 1, 0, 0""",
)
def explanation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A21 + L2 + H6: three explanations run (rules on all segments, a surrogate asked
    for one segment alone, rules without centers), each appended to a log with its
    real counts; the log is read back."""

    m = labelled_matrix(spark, sf_dir)
    lowest = m.where("cluster_label >= 0").agg(F.min("cluster_label")).first()[0]
    one = m.where(F.col("cluster_label") == lowest)
    runs = {
        "explain all segments": H.explain(m, MATRIX_COLS, "rule_based", S.explanation_centers(m, MATRIX_COLS)),
        "explain one segment": H.explain(one, MATRIX_COLS, "shap", S.explanation_centers(one, MATRIX_COLS)),
        "explain without centers": H.explain(m, MATRIX_COLS, "rule_based"),
    }
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/cohortlens-tables/explanation-log-{uuid.uuid4().hex}"
    remember(spark, path)
    for i, (text, explanation) in enumerate(runs.items()):
        failed = L.log_explanation(path, explanation, text, record_id=i)
        if failed:
            raise RuntimeError(failed)
    return L.explanation_counts(spark.read.parquet(path))


@register(
    "target_table_display",
    PERSONA_JOIN_CTE + f""" SELECT CUST_ID, format('{{:,.2f}}', {r4('BALANCE', 2)}) AS BALANCE,
  format('{{:,.2f}}', {r4('PURCHASES', 2)}) AS PURCHASES, format('{{:,.2f}}', {r4('CREDIT_LIMIT', 2)}) AS CREDIT_LIMIT,
  printf('%.3f', {r4('CREDIT_UTILIZATION', 3)}) AS CREDIT_UTILIZATION
FROM wp WHERE cluster = 0 ORDER BY wp.PURCHASES DESC, CUST_ID LIMIT 8""",
)
def target_table_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3 + P16: the persona target table formatted for display (thousands
    separators, 2 decimals; utilization 3 decimals)."""

    t = P.target_table(with_personas(spark, sf_dir), "The Transactors", 8)
    money = {c: F.format_number(round_half_up(F.col(c), 2), 2) for c in ["BALANCE", "PURCHASES", "CREDIT_LIMIT"]}
    return t.select("CUST_ID", *[money[c].alias(c) for c in money],
                    F.format_string("%.3f", round_half_up(F.col("CREDIT_UTILIZATION"), 3)).alias("CREDIT_UTILIZATION"))
