"""Explanation queries on the fitted k-means segments (H1-H8, A17, W3, W4). Rows-only:
the surrogate forest and the perturbations have no SQL twin; the tests check
SHAP additivity and the two-feature fixture instead."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators import explain as H
from cohortlens.operators import segments as S
from cohortlens.operators.features import to_matrix
from cohortlens.plans.common import FEATURE_NAMES, features, kmeans_labels, rounded
from cohortlens.plans.registry import register
from cohortlens.session import input_state, on_drop

COLS = ["TENURE", *FEATURE_NAMES]
_FORESTS: dict = {}
on_drop(_FORESTS.clear)


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_matrix(features(spark, sf_dir)).join(kmeans_labels(spark, sf_dir), "CUST_ID")


def _forest(spark: SparkSession, sf_dir: str):
    key = (spark.sparkContext.applicationId, sf_dir, input_state(spark, sf_dir))
    if key not in _FORESTS:
        _FORESTS[key] = H.fit_surrogate(_matrix(spark, sf_dir), COLS)[1]
    return _FORESTS[key]


def _contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's contributions, worked out where they are used: no copy of the
    SHAP vectors is written."""

    return H.shap_explanations(_matrix(spark, sf_dir), COLS, _forest(spark, sf_dir))


def _flat(con: DataFrame, value_name: str, *keep: str) -> DataFrame:
    top = F.transform("contributions", lambda c: F.concat_ws(":", c["feature"], c["direction"]))
    return con.select("CUST_ID", "cluster_label", F.array_join(top, "|").alias("top_features"),
                      F.transform("contributions", lambda c: c["value"]).alias(value_name), *keep)


@register("surrogate_forest")
def surrogate_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1: node table summary of the fitted surrogate (trees, nodes, leaves, depth-bounded)."""

    f = _forest(spark, sf_dir)
    rows = [(int(t), int((f["cover"][t] > 0).sum()), int(((f["left"][t] < 0) & (f["cover"][t] > 0)).sum()), float(f["cover"][t][0]))
            for t in range(f["feature"].shape[0])]
    return spark.createDataFrame(rows, "tree_id int, n_nodes int, n_leaves int, root_cover double")


@register("shap_top5")
def shap_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2 + W3: top-5 SHAP contributions of the own segment, every customer."""

    con = _contributions(spark, sf_dir)
    return rounded(_flat(con, "shap_values", "base_value", "prediction"), 6)


@register("shap_additivity", "SELECT count(*) AS customers, count(*) AS holds FROM customer")
def shap_additivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2: base value plus contributions equals the forest's probability, every customer."""

    con = _contributions(spark, sf_dir)
    total = F.aggregate("shap", F.col("base_value"), lambda a, x: a + x)
    return con.agg(F.count(F.lit(1)).alias("customers"), F.count_if(F.abs(total - F.col("prediction")) < 1e-6).alias("holds"))


@register("lime_top5")
def lime_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H3: top-5 local-surrogate weights, every customer."""

    m = _matrix(spark, sf_dir)
    con = H.lime_explanations(m, COLS, _forest(spark, sf_dir), H.quartile_bins(m, COLS))
    return _flat(con, "weights")


@register("segment_importance")
def segment_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17 + W4 + H8: mean |SHAP| per segment and feature, top 5, with summaries."""

    con = _contributions(spark, sf_dir)
    return H.segment_importance(con, cols=COLS)


@register("customer_explanations")
def customer_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H5-H7 + J4: explanation sentences with the borderline suffix (SHAP mode,
    rule-based fallback), every customer."""

    m = _matrix(spark, sf_dir)
    cen = S.explanation_centers(m, COLS)
    bnd = S.boundary_metrics(m, COLS, cen)
    out = H.explain(m, COLS, "shap", cen, bnd, forest=_forest(spark, sf_dir))
    return out.customers.select("customer_id", "cluster_label", "explanation", "nearest_alternate_cluster",
                                "boundary_distance_ratio").withColumn("explainer_used", F.lit(out.explainer))
