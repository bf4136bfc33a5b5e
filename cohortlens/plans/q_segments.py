"""Segment queries over fixed labels.

Label-dependent oracles use a deterministic label on both sides: fixed cut points
on the feature values (segment path, some customers noise), or the customer
number modulo 4 (persona path). Every customer is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens import catalog
from cohortlens.operators import personas as P
from cohortlens.operators import segments as S
from cohortlens.operators.features import persona_features, to_matrix
from cohortlens.plans.common import BEHAVIOUR_LABEL, FEATURE_NAMES, FEATURES_CTE, behaviour_label, features, fixed_label, r4, rounded
from cohortlens.plans.q_features import PERSONA_CTE
from cohortlens.plans.common import profile
from cohortlens.plans.registry import register

MATRIX_COLS = ["TENURE", *FEATURE_NAMES]
LAB = "cluster_label"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).withColumn(LAB, behaviour_label())


def labelled_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir).withColumn(LAB, behaviour_label())
    matrix = to_matrix(f, cols=[*MATRIX_COLS, LAB])
    return matrix.withColumn(LAB, F.col(LAB).cast("int"))


LAB_CTE = FEATURES_CTE + f", lab AS (SELECT *, {BEHAVIOUR_LABEL} AS cluster_label FROM feat)"

# ---- SQL fragments --------------------------------------------------------------
_F = [f"CAST({c} AS DOUBLE)" for c in MATRIX_COLS]
_MAT = "mat AS (SELECT CUST_ID, cluster_label, " + ", ".join(f"coalesce({e}, 0.0) AS f{i}" for i, e in enumerate(_F)) + " FROM lab)"
_CEN = "cen AS (SELECT cluster_label AS cl, " + ", ".join(f"{r4(f'avg(f{i})')} AS c{i}" for i in range(len(_F))) + " FROM mat GROUP BY cluster_label)"
_DIST = "sqrt(0.0 + " + " + ".join(f"(m.f{i} - c.c{i}) * (m.f{i} - c.c{i})" for i in range(len(_F))) + ")"
BOUNDARY_CTE = (
    LAB_CTE + ", " + _MAT + ", " + _CEN + f""",
d AS (SELECT m.CUST_ID, m.cluster_label, c.cl, {_DIST} AS dist FROM mat m, cen c WHERE c.cl >= 0),
own AS (SELECT CUST_ID, cluster_label, dist AS own_d FROM d WHERE cl = cluster_label),
alt AS (SELECT CUST_ID, cl AS alt_label, dist AS alt_d,
               row_number() OVER (PARTITION BY CUST_ID ORDER BY dist, cl) AS rn FROM d WHERE cl <> cluster_label),
bnd AS (SELECT own.CUST_ID AS customer_id, own.cluster_label, alt_label AS nearest_alternate_cluster,
               own_d AS own_distance, alt_d AS alternate_distance,
               CASE WHEN alt_d > 0 THEN own_d / alt_d ELSE 1.0 END AS boundary_distance_ratio
        FROM own JOIN alt ON own.CUST_ID = alt.CUST_ID AND alt.rn = 1)"""
)

_PROF_SQL = (
    "prof AS (SELECT cluster_label, count(*) AS customer_count, "
    + ", ".join(f"median({src}) AS {dst}" for src, dst in S.PROFILE_MEDIANS.items())
    + ", quantile_cont(transaction_frequency_per_month, 0.33) AS frequency_q33 FROM lab GROUP BY cluster_label)"
)
_THR_SQL = (
    "thr AS (SELECT quantile_cont(monthly_spend, 0.67) AS s67, quantile_cont(monthly_spend, 0.33) AS s33, "
    "quantile_cont(transaction_frequency_per_month, 0.67) AS f67, quantile_cont(transaction_frequency_per_month, 0.33) AS f33 FROM feat)"
)
_TIER_SQL = (
    "tiered AS (SELECT prof.*, CASE WHEN monthly_spend_median >= s67 AND transaction_frequency_median >= f67 THEN 'priority' "
    "WHEN monthly_spend_median <= s33 OR transaction_frequency_median <= f33 THEN 'dormant' ELSE 'regular' END AS tier FROM prof, thr)"
)
c = catalog
_TAGS_SQL = (
    "tagged AS (SELECT *, list_filter(["
    f"CASE WHEN credit_utilization_median >= {c.UTIL_HIGH} AND full_payment_ratio_median <= {c.FULL_PAYMENT_LOW} THEN '{c.TAG_DEBT_CONSOLIDATION}' END, "
    f"CASE WHEN cash_advance_ratio_median >= {c.CASH_ADVANCE_HIGH} THEN '{c.TAG_CREDIT_LINE}' END, "
    f"CASE WHEN oneoff_purchase_share_median >= {c.ONEOFF_HIGH} AND full_payment_ratio_median >= {c.FULL_PAYMENT_HIGH} THEN '{c.TAG_PREMIUM}' END, "
    f"CASE WHEN tier <> 'dormant' AND transaction_frequency_median <= frequency_q33 THEN '{c.TAG_REACTIVATION}' END"
    "], lambda x: x IS NOT NULL) AS tags FROM tiered)"
)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_BUNDLES_SQL = "bundles AS (SELECT * FROM (VALUES " + ", ".join(
    f"({_q(t)}, {_q(a)}, {_q(m)}, [{', '.join(_q(x) for x in xs)}])" for t, a, m, xs in c.TIER_BUNDLES
) + ") AS b(tier, action, message, tcs))"
RECS_CTE = LAB_CTE + ", " + ", ".join([_PROF_SQL, _THR_SQL, _TIER_SQL, _TAGS_SQL, _BUNDLES_SQL]) + (
    ", recs AS (SELECT tagged.*, action, message, list_concat(tcs, tags) AS cross_sell FROM tagged JOIN bundles USING (tier))"
)


# ---- cluster_sizes / cluster_size_bar (A12, V2) ----------------------------------
@register("cluster_sizes", LAB_CTE + " SELECT cluster_label, count(*) AS customer_count FROM lab GROUP BY cluster_label")
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cluster_sizes(labelled(spark, sf_dir))


@register("cluster_size_bar", LAB_CTE + " SELECT cluster_label, count(*) AS customer_count FROM lab GROUP BY cluster_label")
def cluster_size_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cluster_sizes(labelled(spark, sf_dir))


@register(
    "cluster_count",
    LAB_CTE + " SELECT count(DISTINCT cluster_label) AS cluster_count_all, "
    "count(DISTINCT CASE WHEN cluster_label <> -1 THEN cluster_label END) AS cluster_count_non_noise, count(*) AS customer_count FROM lab",
)
def cluster_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cluster_counts(labelled(spark, sf_dir))


# ---- cluster_profile (A10, A11) ----------------------------------------------------
@register(
    "cluster_profile",
    LAB_CTE + ", " + _PROF_SQL + " SELECT cluster_label, customer_count, "
    + ", ".join(f"{r4(v)} AS {v}" for v in S.PROFILE_MEDIANS.values()) + f", {r4('frequency_q33')} AS frequency_q33 FROM prof",
)
def cluster_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.cluster_profile(labelled(spark, sf_dir)))


# ---- explanation_centers (A14) -------------------------------------------------------
@register(
    "explanation_centers",
    LAB_CTE + ", " + _MAT + ", " + _CEN + " "
    + " UNION ALL ".join(f"SELECT cl AS cluster_label, {i} AS position, '{c}' AS feature, c{i} AS center FROM cen" for i, c in enumerate(MATRIX_COLS)),
)
def explanation_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cen = S.explanation_centers(labelled_matrix(spark, sf_dir), MATRIX_COLS)
    names = F.array(*[F.lit(c) for c in MATRIX_COLS])
    out = cen.select(LAB, F.posexplode("center").alias("position", "center"))
    return rounded(out.select(LAB, "position", F.element_at(names, F.col("position") + 1).alias("feature"), "center"))


# ---- boundary_metrics, borderline_customers (M12, M13, W5) ------------------------------
@register(
    "boundary_metrics",
    BOUNDARY_CTE + " SELECT customer_id, cluster_label, nearest_alternate_cluster, "
    + f"{r4('own_distance')} AS own_distance, {r4('alternate_distance')} AS alternate_distance, "
    + f"{r4('boundary_distance_ratio')} AS boundary_distance_ratio FROM bnd",
)
def boundary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = labelled_matrix(spark, sf_dir)
    cen = S.explanation_centers(m, MATRIX_COLS)
    return rounded(S.boundary_metrics(m, MATRIX_COLS, cen))


@register(
    "borderline_customers",
    BOUNDARY_CTE + " SELECT customer_id, cluster_label, nearest_alternate_cluster, "
    + f"{r4('boundary_distance_ratio')} AS boundary_distance_ratio, "
    + "'borderline between Segment ' || cluster_label || ' and Segment ' || nearest_alternate_cluster AS note FROM bnd "
    + f"WHERE {r4('boundary_distance_ratio')} > {catalog.BOUNDARY_RATIO_THRESHOLD}",
)
def borderline_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = labelled_matrix(spark, sf_dir)
    cen = S.explanation_centers(m, MATRIX_COLS)
    return rounded(S.borderline_customers(S.boundary_metrics(m, MATRIX_COLS, cen)))


# ---- tiers, tags, recommendations (R1-R5, A16) ------------------------------------------
@register(
    "tier_assignment",
    RECS_CTE + f" SELECT cluster_label, tier, {r4('monthly_spend_median')} AS monthly_spend_median, "
    f"{r4('transaction_frequency_median')} AS transaction_frequency_median FROM recs",
)
def tier_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = labelled(spark, sf_dir)
    recs = S.cluster_recommendations(lab)
    return rounded(recs.select(LAB, "tier", "monthly_spend_median", "transaction_frequency_median"))


@register("behavioral_tags", RECS_CTE + " SELECT cluster_label, tier, array_to_string(tags, '|') AS behavioral_products FROM recs")
def behavioral_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = S.cluster_recommendations(labelled(spark, sf_dir))
    return recs.select(LAB, "tier", F.array_join("behavioral_products", "|").alias("behavioral_products"))


@register(
    "cluster_recommendations",
    RECS_CTE + " SELECT cluster_label, tier, action, message, array_to_string(cross_sell, '|') AS cross_sell, "
    "array_to_string(tags, '|') AS behavioral_products, customer_count, message AS narrative FROM recs",
)
def cluster_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = S.cluster_recommendations(labelled(spark, sf_dir))
    return recs.select(
        LAB, "tier", "action", "message", F.array_join("cross_sell", "|").alias("cross_sell"),
        F.array_join("behavioral_products", "|").alias("behavioral_products"), "customer_count", "narrative",
    )


@register(
    "customer_recommendations",
    RECS_CTE + " SELECT CUST_ID AS customer_id, lab.cluster_label, tier, message AS primary_recommendation, "
    "array_to_string(tags, '|') AS behavioral_products FROM lab JOIN recs ON lab.cluster_label = recs.cluster_label",
)
def customer_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = labelled(spark, sf_dir)
    recs = S.cluster_recommendations(lab)
    out = S.customer_recommendations(lab, recs)
    return out.select("customer_id", LAB, "tier", "primary_recommendation", F.array_join("behavioral_products", "|").alias("behavioral_products"))


@register("tier_counts", RECS_CTE + " SELECT tier, count(*) AS cluster_count FROM recs GROUP BY tier")
def tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.tier_counts(S.cluster_recommendations(labelled(spark, sf_dir)))


# ---- scatter_rows (V1) ---------------------------------------------------------------------
@register("scatter_rows", LAB_CTE + f" SELECT {r4('credit_headroom')} AS x, {r4('monthly_spend')} AS y, cluster_label, CUST_ID AS customer_id FROM lab")
def scatter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.scatter_rows(labelled(spark, sf_dir)))


# ---- rule_explanations, segment_summary (H4, H7, W3, W9, J4) -----------------------------------
def _rule_sql() -> str:
    parts = []
    for i, col in enumerate(MATRIX_COLS):
        lbl = catalog.FEATURE_LABELS.get(col, col.replace("_", " "))
        parts.append(f"SELECT m.CUST_ID, m.cluster_label, {i} AS fi, {_q(lbl)} AS lbl, m.f{i} AS v, c.c{i} AS c FROM mat m JOIN cen c ON c.cl = m.cluster_label")
    return (
        BOUNDARY_CTE
        + ", lng AS (" + " UNION ALL ".join(parts) + ")"
        + """, rk AS (SELECT *, row_number() OVER (PARTITION BY CUST_ID ORDER BY abs(v - c) DESC, fi) AS rn,
                   (CASE WHEN v > c THEN 'high' ELSE 'low' END) || ' ' || lbl AS reason FROM lng WHERE cluster_label >= 0),
two AS (SELECT CUST_ID, cluster_label, max(CASE WHEN rn = 1 THEN reason END) AS r1, max(CASE WHEN rn = 2 THEN reason END) AS r2
        FROM rk WHERE rn <= 2 GROUP BY CUST_ID, cluster_label),
expl AS (SELECT two.CUST_ID AS customer_id, two.cluster_label, r1, r2,
   'Assigned to Segment ' || two.cluster_label || ' primarily due to ' || r1 || CASE WHEN r2 IS NOT NULL THEN ' and ' || r2 || '.' ELSE '.' END
   || CASE WHEN """ + r4("b.boundary_distance_ratio") + f""" > {catalog.BOUNDARY_RATIO_THRESHOLD}
           THEN ' This customer is borderline between Segment ' || two.cluster_label || ' and Segment ' || b.nearest_alternate_cluster || '.'
           ELSE '' END AS explanation,
   b.nearest_alternate_cluster, """ + r4("b.boundary_distance_ratio") + """ AS boundary_distance_ratio
 FROM two LEFT JOIN bnd b ON b.customer_id = two.CUST_ID)"""
    )


RULE_CTE = _rule_sql()


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = labelled_matrix(spark, sf_dir)
    cen = S.explanation_centers(m, MATRIX_COLS)
    return S.rule_explanations(m, MATRIX_COLS, cen, measure=True)


@register("rule_explanations", RULE_CTE + " SELECT customer_id, cluster_label, explanation, nearest_alternate_cluster, boundary_distance_ratio FROM expl")
def rule_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_rules(spark, sf_dir).select("customer_id", LAB, "explanation", "nearest_alternate_cluster", "boundary_distance_ratio"))


@register(
    "segment_summary",
    RULE_CTE
    + """, fc AS (SELECT *, row_number() OVER (PARTITION BY cluster_label ORDER BY customer_id) AS k FROM expl),
agg AS (SELECT cluster_label, max(CASE WHEN k = 1 THEN r1 END) AS a, max(CASE WHEN k = 1 THEN r2 END) AS b,
               max(CASE WHEN k = 2 THEN r1 END) AS c2 FROM fc WHERE k <= 2 GROUP BY cluster_label)
SELECT cluster_label, 'Segment ' || cluster_label || ' customers are often characterized by ' || concat_ws(', ', a, b, c2) || '.' AS summary FROM agg""",
)
def segment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.segment_summaries(_rules(spark, sf_dir))


# ---- persona path with fixed labels (mod 4): A15, W2, P15, R6, D3 -----------------------------
PERSONA_LAB_CTE = PERSONA_CTE + ", pl AS (SELECT *, CAST(CAST(substr(CUST_ID, 2) AS BIGINT) % 4 AS INTEGER) AS cluster FROM pf)"
_CAT_SQL = "cat AS (SELECT * FROM (VALUES " + ", ".join(
    f"({cid}, {_q(n)}, {_q(prof)}, {_q(prod)}, {_q(key)}, {'true' if asc else 'false'})" for cid, n, prof, prod, key, asc in catalog.PERSONAS
) + ") AS t(cluster, persona, persona_profile, recommended_product, sort_key, sort_ascending))"
PERSONA_JOIN_CTE = PERSONA_LAB_CTE + ", " + _CAT_SQL + ", wp AS (SELECT pl.*, persona, persona_profile, recommended_product FROM pl LEFT JOIN cat USING (cluster))"


def with_personas(spark: SparkSession, sf_dir: str) -> DataFrame:
    pf = persona_features(profile(spark, sf_dir)).withColumn("cluster", fixed_label("CUST_ID", 4))
    return P.attach_personas(pf, "cluster")


@register("persona_filter", PERSONA_JOIN_CTE + " SELECT CUST_ID, cluster, persona FROM wp WHERE lower(persona) = 'cash-advance reliant'")
def persona_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M14 + P7: a spoken persona name resolved to its cluster, whose customers are kept."""

    from cohortlens.operators.lookup import filter_cluster_or_persona

    asked = spark.createDataFrame([(" Cash advance reliant ",)], "spoken string")
    cluster = P.resolve_persona_column(asked, "spoken").first()["cluster"]
    return filter_cluster_or_persona(with_personas(spark, sf_dir), cluster=cluster).select("CUST_ID", "cluster", "persona")


@register("persona_summary", PERSONA_JOIN_CTE + " SELECT cluster, persona, recommended_product, count(*) AS customer_count FROM wp GROUP BY ALL")
def persona_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.persona_summary(with_personas(spark, sf_dir))


_SV = "CASE cluster " + " ".join(
    f"WHEN {cid} THEN {'-' if asc else ''}CAST({key} AS DOUBLE)" for cid, _, _, _, key, asc in catalog.PERSONAS
) + " END"
_KV = "CASE cluster " + " ".join(f"WHEN {cid} THEN CAST({key} AS DOUBLE)" for cid, _, _, _, key, _ in catalog.PERSONAS) + " END"
_KN = "CASE cluster " + " ".join(f"WHEN {cid} THEN '{key}'" for cid, _, _, _, key, _ in catalog.PERSONAS) + " END"


@register(
    "persona_top_n",
    PERSONA_JOIN_CTE + f""", r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY {_SV} DESC, CUST_ID) AS rank FROM wp)
SELECT cluster, persona, CAST(rank AS INTEGER) AS rank, CUST_ID, recommended_product, {_KN} AS sort_key, {r4(_KV)} AS sort_value FROM r WHERE rank <= 10""",
)
def persona_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.persona_top_n(with_personas(spark, sf_dir), 10))


@register(
    "customer_insight",
    PERSONA_JOIN_CTE + " SELECT CUST_ID AS cust_id, cluster, persona, persona_profile, recommended_product, "
    + ", ".join(f"{r4(m)} AS {m}" for m in P.INSIGHT_METRICS) + " FROM wp WHERE CUST_ID = 'C10001'",
)
def customer_insight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.customer_insight(with_personas(spark, sf_dir), "C10001"))


def _playbook_sql() -> str:
    whens = " ".join(
        f"WHEN persona = {_q(n)} THEN replace(replace({_q(t)}, '{{persona}}', persona), '{{product}}', recommended_product)"
        for n, t in catalog.PERSONA_PLAYBOOKS.items()
    )
    fb = f"replace(replace({_q(catalog.PERSONA_PLAYBOOK_FALLBACK)}, '{{persona}}', persona), '{{product}}', recommended_product)"
    return (
        PERSONA_JOIN_CTE
        + f", s AS (SELECT cluster, persona, recommended_product, count(*) AS customer_count FROM wp GROUP BY ALL) "
        + f"SELECT cluster, persona, recommended_product, customer_count, CASE {whens} ELSE {fb} END AS playbook FROM s"
    )


@register("persona_playbook", _playbook_sql())
def persona_playbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = P.persona_summary(with_personas(spark, sf_dir))
    return s.withColumn("playbook", P.playbook_expr(F.col("persona"), F.col("recommended_product")))


@register(
    "target_table",
    PERSONA_JOIN_CTE + f" SELECT CUST_ID, {r4('BALANCE')} AS BALANCE, {r4('PURCHASES')} AS PURCHASES, "
    f"{r4('CREDIT_LIMIT')} AS CREDIT_LIMIT, {r4('CREDIT_UTILIZATION')} AS CREDIT_UTILIZATION FROM wp WHERE cluster = 0 "
    "ORDER BY PURCHASES DESC, CUST_ID LIMIT 8",
)
def target_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.target_table(with_personas(spark, sf_dir), "The Transactors", 8))


# ---- cluster_narratives (J8) ---------------------------------------------------------------
@register(
    "cluster_narratives",
    RECS_CTE + """, nar AS (SELECT CAST(conv_id AS INTEGER) AS cluster_label, min(text) AS narrative FROM conversations WHERE role = 'assistant' GROUP BY 1)
SELECT recs.cluster_label, tier, coalesce(narrative, message) AS narrative FROM recs LEFT JOIN nar USING (cluster_label)""",
)
def cluster_narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A narratives table (the first assistant text of a conversation, keyed by
    its id) joined to the clusters; labels without one keep the rule message."""

    from cohortlens.sources.tables import table

    talk = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    narratives = talk.groupBy(F.col("conv_id").cast("int").alias(LAB)).agg(F.min("text").alias("narrative"))
    return S.cluster_recommendations(labelled(spark, sf_dir), narratives=narratives).select(LAB, "tier", "narrative")
