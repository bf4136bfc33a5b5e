"""Segment analytics over labelled customers.

Input: a feature table with ``CUST_ID`` and ``cluster_label``. Everything per
cluster is a k-row table (k = number of labels, checked against
``MAX_CLUSTERS``); it is the only thing ever broadcast. Per-customer outputs
are narrow projections or broadcast joins against those k rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens import catalog
from cohortlens.functions.expr import euclidean, feature_label, round_half_up
from cohortlens.functions.quantile import quantiles_wide
from cohortlens.operators.stats import tier_thresholds

MAX_CLUSTERS = 10_000
LABEL = "cluster_label"


def _check_k(k: int) -> None:
    if k > MAX_CLUSTERS:
        raise ValueError(f"{k} labels exceed the broadcast bound of {MAX_CLUSTERS}")


# ---------------------------------------------------------------- sizes
def cluster_sizes(labelled: DataFrame) -> DataFrame:
    """Customers per label, noise included."""

    return labelled.groupBy(LABEL).agg(F.count(F.lit(1)).alias("customer_count"))


def cluster_counts(labelled: DataFrame) -> DataFrame:
    """Distinct labels (evaluation's definition) and non-noise clusters."""

    return labelled.agg(
        F.count_distinct(F.col(LABEL)).alias("cluster_count_all"),
        F.count_distinct(F.when(F.col(LABEL) != -1, F.col(LABEL))).alias("cluster_count_non_noise"),
        F.count(F.lit(1)).alias("customer_count"),
    )


# ---------------------------------------------------------------- cluster profile
PROFILE_MEDIANS = {
    "monthly_spend": "monthly_spend_median",
    "transaction_frequency_per_month": "transaction_frequency_median",
    "full_payment_ratio": "full_payment_ratio_median",
    "credit_headroom": "credit_headroom_median",
    "credit_utilization_ratio": "credit_utilization_median",
    "cash_advance_ratio": "cash_advance_ratio_median",
    "oneoff_purchase_share": "oneoff_purchase_share_median",
}


def cluster_profile(labelled: DataFrame) -> DataFrame:
    """A10 + A11: count, medians and the lower frequency quantile of each label."""

    wanted = {v: (c, 0.5) for c, v in PROFILE_MEDIANS.items()} | {"frequency_q33": ("transaction_frequency_per_month", catalog.TIER_LOW_QUANTILE)}
    wide = quantiles_wide(labelled, wanted, by=[LABEL]).withColumnRenamed(LABEL, "label_")
    sizes = cluster_sizes(labelled)
    joined = sizes.join(wide, sizes[LABEL].eqNullSafe(wide["label_"]), "left")
    return joined.select(F.col(LABEL).cast("int").alias(LABEL), "customer_count", *PROFILE_MEDIANS.values(), "frequency_q33")


# ---------------------------------------------------------------- tiers, tags
def tier_expr() -> Column:
    """R1 as a ``when`` chain over the cluster medians and the threshold columns."""

    spend, freq = F.col("monthly_spend_median"), F.col("transaction_frequency_median")
    return (
        F.when((spend >= F.col("spend_q67")) & (freq >= F.col("dataset_frequency_q67")), F.lit("priority"))
        .when((spend <= F.col("spend_q33")) | (freq <= F.col("dataset_frequency_q33")), F.lit("dormant"))
        .otherwise(F.lit("regular"))
    )


def tags_expr(tier: Column) -> Column:
    """Behavioural product tags in rule order."""

    c = catalog
    util, full = F.col("credit_utilization_median"), F.col("full_payment_ratio_median")
    cash, oneoff = F.col("cash_advance_ratio_median"), F.col("oneoff_purchase_share_median")
    freq, q33 = F.col("transaction_frequency_median"), F.col("frequency_q33")
    cands = F.array(
        F.when((util >= c.UTIL_HIGH) & (full <= c.FULL_PAYMENT_LOW), F.lit(c.TAG_DEBT_CONSOLIDATION)),
        F.when(cash >= c.CASH_ADVANCE_HIGH, F.lit(c.TAG_CREDIT_LINE)),
        F.when((oneoff >= c.ONEOFF_HIGH) & (full >= c.FULL_PAYMENT_HIGH), F.lit(c.TAG_PREMIUM)),
        F.when((tier != "dormant") & (freq <= q33), F.lit(c.TAG_REACTIVATION)),
    )
    return F.filter(cands, lambda x: x.isNotNull())


def bundles(spark) -> DataFrame:
    """R2: the 3-row tier → action, message, cross-sell table."""

    return spark.createDataFrame(catalog.TIER_BUNDLES, "tier string, action string, message string, tier_cross_sell array<string>")


def cluster_recommendations(labelled: DataFrame, features_all: DataFrame | None = None, narratives: DataFrame | None = None) -> DataFrame:
    """Per cluster tier, action, message, merged cross-sell (U1), tags,
    count and narrative (J8: optional ``(cluster_label, narrative)`` table,
    falling back to the rule message). Thresholds (A9) come from the whole
    feature table (``features_all``, default ``labelled``)."""

    # one threshold row, joined to the per-cluster rows
    thr = tier_thresholds(features_all if features_all is not None else labelled)
    thr = thr.drop("credit_headroom_median").withColumnsRenamed({"frequency_q67": "dataset_frequency_q67", "frequency_q33": "dataset_frequency_q33"})
    with_tier = cluster_profile(labelled).crossJoin(F.broadcast(thr)).withColumn("tier", tier_expr())
    rec = with_tier.withColumn("behavioral_products", tags_expr(F.col("tier"))).join(
        F.broadcast(bundles(labelled.sparkSession)), "tier"
    )
    rec = rec.withColumn("cross_sell", F.array_distinct(F.concat("tier_cross_sell", "behavioral_products")))
    if narratives is not None:
        rec = rec.join(narratives, LABEL, "left").withColumn("narrative", F.coalesce("narrative", "message"))
    else:
        rec = rec.withColumn("narrative", F.col("message"))
    return rec.select(
        LABEL, "tier", "action", "message", "cross_sell", "behavioral_products", "customer_count", "narrative",
        *PROFILE_MEDIANS.values(), "frequency_q33",
    )


def customer_recommendations(labelled: DataFrame, cluster_recs: DataFrame) -> DataFrame:
    """Every customer joined to its cluster's recommendation (k-row broadcast)."""

    small = cluster_recs.select(LABEL, "tier", F.col("message").alias("primary_recommendation"), "behavioral_products")
    return labelled.select(F.col("CUST_ID").alias("customer_id"), LABEL).join(F.broadcast(small), LABEL, "inner")


def tier_counts(cluster_recs: DataFrame) -> DataFrame:
    """Number of clusters per tier."""

    return cluster_recs.groupBy("tier").agg(F.count(F.lit(1)).alias("cluster_count"))


# ---------------------------------------------------------------- centers and boundary
def explanation_centers(matrix: DataFrame, cols: Sequence[str], digits: int = 4) -> DataFrame:
    """Per label mean of every feature, rounded, noise label included."""

    agg = matrix.groupBy(LABEL).agg(*[F.avg(F.col(c)).alias(c) for c in cols])
    return agg.select(LABEL, F.array(*[round_half_up(F.col(c), digits) for c in cols]).alias("center"))


def centers_literal(centers: DataFrame) -> Column:
    """Collect ≤ MAX_CLUSTERS centers (bounded parameters) into a literal
    ``array<struct<label int, center array<double>>>`` sorted by label."""

    got = centers.limit(MAX_CLUSTERS + 1).collect()
    _check_k(len(got))
    rows = sorted((int(r[LABEL]), [float(v) for v in r["center"]]) for r in got if r[LABEL] is not None)
    _check_k(len(rows))
    return F.array(
        *[F.struct(F.lit(lbl).alias("label"), F.array(*[F.lit(v) for v in c]).alias("center")) for lbl, c in rows]
    ), rows


def boundary_metrics(matrix: DataFrame, cols: Sequence[str], centers: DataFrame, id_col: str = "CUST_ID") -> DataFrame:
    """Own distance, nearest alternate cluster (ties → lowest label) and
    own/alternate ratio (alternate distance 0 → 1.0) per customer.

    Centers of labels ≥ 0 only; fewer than two → empty. The k centers ride
    along as a literal array, so this is one narrow projection (no join, no
    shuffle); the array lambdas are evaluated inside the same stage.
    """

    real = centers.where(F.col(LABEL) >= 0)
    lit_centers, rows = centers_literal(real)
    if len(rows) < 2:
        return matrix.sparkSession.createDataFrame(
            [], "customer_id string, cluster_label int, nearest_alternate_cluster int, own_distance double, "
            "alternate_distance double, boundary_distance_ratio double"
        )
    labels = [r[0] for r in rows]
    vec = F.array(*[F.col(c).cast("double") for c in cols])
    dists = F.transform(lit_centers, lambda c: F.struct(euclidean(vec, c["center"]).alias("d"), c["label"].alias("label")))
    df = matrix.where(F.col(LABEL).isin(labels)).select(F.col(id_col).alias("customer_id"), F.col(LABEL), dists.alias("ds"))
    own = F.filter("ds", lambda s: s["label"] == F.col(LABEL))[0]["d"]
    alt = F.array_min(F.filter("ds", lambda s: s["label"] != F.col(LABEL)))
    df = df.select("customer_id", LABEL, own.alias("own_distance"), alt.alias("alt"))
    ratio = F.when(F.col("alt.d") > 0, F.try_divide(F.col("own_distance"), F.col("alt.d"))).otherwise(F.lit(1.0))
    return df.select(
        "customer_id", LABEL, F.col("alt.label").alias("nearest_alternate_cluster"), "own_distance",
        F.col("alt.d").alias("alternate_distance"), ratio.alias("boundary_distance_ratio"),
    )


def borderline_suffix(ratio: Column, own: Column, alt: Column, threshold: float = catalog.BOUNDARY_RATIO_THRESHOLD) -> Column:
    """Sentence appended when the (4-decimal) ratio exceeds the threshold."""

    return F.when(
        ratio > F.lit(threshold),
        F.format_string(" This customer is borderline between Segment %d and Segment %d.", own, alt),
    ).otherwise(F.lit(""))


def borderline_customers(boundary: DataFrame, threshold: float = catalog.BOUNDARY_RATIO_THRESHOLD) -> DataFrame:
    r = round_half_up(F.col("boundary_distance_ratio"), 4)
    return boundary.where(r > F.lit(threshold)).select(
        "customer_id", LABEL, "nearest_alternate_cluster", r.alias("boundary_distance_ratio"),
        F.format_string("borderline between Segment %d and Segment %d", F.col(LABEL), F.col("nearest_alternate_cluster")).alias("note"),
    )


# ---------------------------------------------------------------- rule explanations
def rule_explanations(matrix: DataFrame, cols: Sequence[str], centers: DataFrame, boundary: DataFrame | None = None,
                      id_col: str = "CUST_ID", top_k: int = 2, measure: bool = False) -> DataFrame:
    """H4: the ``top_k`` features farthest from the own center, high/low by the
    sign of (value − center), sentence, and the borderline suffix (J4: left
    join on the customer; absent → unchanged). Labels without a center are
    skipped. Ties on distance → lower feature index. With ``measure`` the boundary
    metrics are those of the same row and centers, and no join is needed."""

    lit_centers, rows = centers_literal(centers.where(F.col(LABEL) >= 0))
    labels = [r[0] for r in rows]
    names = F.array(*[F.lit(c) for c in cols])
    vec = F.array(*[F.col(c).cast("double") for c in cols])
    center = F.filter(lit_centers, lambda s: s["label"] == F.col(LABEL))[0]["center"]
    near = F.transform(lit_centers, lambda c: F.struct(euclidean(vec, c["center"]).alias("d"), c["label"].alias("label")))
    measure = measure and len(labels) > 1
    base = matrix.where(F.col(LABEL).isin(labels)).select(
        F.col(id_col).alias("customer_id"), LABEL, vec.alias("v"), center.alias("c"), *([near.alias("ds")] if measure else []))
    idx = F.sequence(F.lit(0), F.lit(len(cols) - 1))
    items = F.transform(
        idx,
        lambda i: F.struct(
            F.abs(F.element_at("v", i + 1) - F.element_at("c", i + 1)).alias("delta"),
            i.alias("fi"),
            F.when(F.element_at("v", i + 1) > F.element_at("c", i + 1), F.lit("high")).otherwise(F.lit("low")).alias("direction"),
        ),
    )
    ranked = F.array_sort(items, lambda a, b: F.when(a["delta"] > b["delta"], -1).when(a["delta"] < b["delta"], 1)
                          .when(a["fi"] < b["fi"], -1).when(a["fi"] > b["fi"], 1).otherwise(0))
    top = F.slice(ranked, 1, top_k)
    reasons = F.transform(top, lambda s: F.concat_ws(" ", s["direction"], feature_label(F.element_at(names, s["fi"] + 1), catalog.FEATURE_LABELS)))
    df = base.select("customer_id", LABEL, reasons.alias("reasons"), *(["ds"] if measure else []))
    sentence = F.concat(
        F.lit("Assigned to Segment "), F.col(LABEL).cast("string"), F.lit(" primarily due to "), F.element_at("reasons", 1),
        F.when(F.size("reasons") > 1, F.concat(F.lit(" and "), F.element_at("reasons", 2), F.lit("."))).otherwise(F.lit(".")),
    )
    df = df.withColumn("explanation", sentence)
    if not measure:
        return attach_boundary(df, boundary)
    own = F.filter("ds", lambda x: x["label"] == F.col(LABEL))[0]["d"]
    alt = F.array_min(F.filter("ds", lambda x: x["label"] != F.col(LABEL)))
    df = df.withColumns({"own_": own, "alt_": alt}).drop("ds")
    ratio = F.when(F.col("alt_.d") > 0, F.try_divide(F.col("own_"), F.col("alt_.d"))).otherwise(F.lit(1.0))
    df = df.withColumns({"nearest_alternate_cluster": F.col("alt_.label"), "boundary_distance_ratio": round_half_up(ratio, 4)}).drop("own_", "alt_")
    return df.withColumn("explanation", F.concat("explanation", _suffix()))


def attach_boundary(expl: DataFrame, boundary: DataFrame | None) -> DataFrame:
    """Explanations ⟕ boundary metrics on customer; ratio > threshold appends
    the borderline sentence."""

    if boundary is None:
        return expl.select("*", F.lit(None).cast("int").alias("nearest_alternate_cluster"),
                           F.lit(None).cast("double").alias("boundary_distance_ratio"))
    b = boundary.select("customer_id", "nearest_alternate_cluster", round_half_up(F.col("boundary_distance_ratio"), 4).alias("boundary_distance_ratio"))
    j = expl.join(b, "customer_id", "left")
    return j.withColumn("explanation", F.concat("explanation", _suffix()))


def _suffix() -> Column:
    """The borderline sentence of a row with a boundary ratio."""

    ratio = F.col("boundary_distance_ratio")
    return F.when(ratio.isNotNull(), borderline_suffix(ratio, F.col(LABEL), F.col("nearest_alternate_cluster"))).otherwise(F.lit(""))


def segment_summaries(expl: DataFrame, first_customers: int = 2) -> DataFrame:
    """Per segment the first reasons in customer-id order (first 3 named).

    ``row_number() … <= n`` is planned as a partial ``WindowGroupLimit`` before
    the shuffle, so a hot segment ships at most n rows per map task.
    """

    from pyspark.sql import Window

    w = Window.partitionBy(LABEL).orderBy("customer_id")
    first = expl.select(LABEL, "customer_id", "reasons").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= first_customers)
    per = first.groupBy(LABEL).agg(F.sort_array(F.collect_list(F.struct("rn", "reasons"))).alias("xs"))
    flat = F.flatten(F.transform("xs", lambda s: s["reasons"]))
    top3 = F.slice(flat, 1, 3)
    return per.select(
        LABEL,
        F.concat(F.lit("Segment "), F.col(LABEL).cast("string"), F.lit(" customers are often characterized by "),
                 F.array_join(top3, ", "), F.lit(".")).alias("summary"),
    )


# ---------------------------------------------------------------- chart payloads (V1)
def scatter_rows(labelled: DataFrame) -> DataFrame:
    """V1: x = credit headroom, y = monthly spend, label, id."""

    return labelled.select(
        F.col("credit_headroom").cast("double").alias("x"), F.col("monthly_spend").cast("double").alias("y"),
        F.col(LABEL).cast("int").alias(LABEL), F.col("CUST_ID").cast("string").alias("customer_id"),
    )
