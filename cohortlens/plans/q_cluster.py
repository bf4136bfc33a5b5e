"""Clustering queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators import cluster as C
from cohortlens.operators import personas as P
from cohortlens.operators.features import to_matrix
from cohortlens.plans.common import FEATURE_NAMES, features, kmeans_result, persona_frame, r4, rounded
from cohortlens.plans.q_segments import LAB_CTE, _MAT, labelled_matrix
from cohortlens.plans.registry import register

MATRIX_COLS = ["TENURE", *FEATURE_NAMES]
P_ = len(MATRIX_COLS)


# ---- kmeans_step: 3 explicit Lloyd iterations from the first 3 ids ------------------
def _lloyd_sql(k: int = 3, iters: int = 3) -> str:
    cen0 = (
        "c0 AS (SELECT row_number() OVER (ORDER BY CUST_ID) - 1 AS i, "
        + ", ".join(f"{r4(f'f{j}')} AS c{j}" for j in range(P_))
        + f" FROM (SELECT * FROM mat ORDER BY CUST_ID LIMIT {k}))"
    )
    ctes = [cen0]
    dist = "sqrt(0.0 + " + " + ".join(f"(m.f{j} - c.c{j}) * (m.f{j} - c.c{j})" for j in range(P_)) + ")"
    for t in range(1, iters + 1):
        ctes.append(
            f"a{t} AS (SELECT CUST_ID, i, " + ", ".join(f"f{j}" for j in range(P_)) + f" FROM (SELECT m.*, c.i, row_number() OVER "
            f"(PARTITION BY m.CUST_ID ORDER BY {dist}, c.i) AS rn FROM mat m, c{t-1} c) WHERE rn = 1)"
        )
        ctes.append(
            f"c{t} AS (SELECT p.i, " + ", ".join(f"coalesce(q.c{j}, p.c{j}) AS c{j}" for j in range(P_))
            + f" FROM c{t-1} p LEFT JOIN (SELECT i, " + ", ".join(f"{r4(f'avg(f{j})')} AS c{j}" for j in range(P_))
            + f" FROM a{t} GROUP BY i) q ON p.i = q.i)"
        )
    sel = " UNION ALL ".join(
        f"SELECT CAST(c.i AS INTEGER) AS cluster_label, {j} AS position, '{col}' AS feature, c.c{j} AS center, "
        f"(SELECT count(*) FROM a{iters} a WHERE a.i = c.i) AS customer_count FROM c{iters} c"
        for j, col in enumerate(MATRIX_COLS)
    )
    return LAB_CTE + ", " + _MAT + ", " + ", ".join(ctes) + " " + sel


@register("kmeans_step", _lloyd_sql())
def kmeans_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = to_matrix(features(spark, sf_dir))
    assigned, centers = C.lloyd(m, MATRIX_COLS, 3, iterations=3)
    counts = assigned.groupBy(C.LABEL).agg(F.count(F.lit(1)).alias("customer_count"))
    cen = C.centers_table(spark, centers, MATRIX_COLS)
    out = cen.join(counts, C.LABEL, "left").select(
        C.LABEL, "position", "feature", "center", F.coalesce("customer_count", F.lit(0)).cast("long").alias("customer_count")
    )
    return rounded(out)


# ---- silhouette (M11, squared Euclidean, exact) on fixed labels ------------------------
def _sil_sql() -> str:
    mu = "mu AS (SELECT " + ", ".join(f"avg(f{j}) AS m{j}" for j in range(P_)) + " FROM mat)"
    xc = "xc AS (SELECT cluster_label AS lbl, " + ", ".join(f"f{j} - m{j} AS x{j}" for j in range(P_)) + ", " + \
        " + ".join(f"(f{j} - m{j}) * (f{j} - m{j})" for j in range(P_)) + " AS q FROM mat, mu)"
    st = "st AS (SELECT lbl AS cl, CAST(count(*) AS DOUBLE) AS n, " + ", ".join(f"sum(x{j}) AS s{j}" for j in range(P_)) + ", sum(q) AS Q FROM xc GROUP BY lbl)"
    dot = " + ".join(f"x.x{j} * s.s{j}" for j in range(P_))
    d = f"d AS (SELECT x.lbl, x.q, s.cl, s.n, x.q * s.n - 2.0 * ({dot}) + s.Q AS tot, row_number() OVER () AS rid_dummy FROM xc x, st s)"
    return (
        LAB_CTE + ", " + _MAT + ", " + mu + ", " + xc + ", " + st
        + ", pts AS (SELECT *, row_number() OVER () AS rid FROM xc), "
        + f"dd AS (SELECT p.rid, p.lbl, s.cl, s.n, p.q * s.n - 2.0 * ({dot.replace('x.', 'p.')}) + s.Q AS tot FROM pts p, st s), "
        + """ab AS (SELECT rid, max(CASE WHEN cl = lbl THEN n END) AS own_n,
                  max(CASE WHEN cl = lbl THEN CASE WHEN n > 1 THEN tot / (n - 1.0) ELSE 0.0 END END) AS a,
                  min(CASE WHEN cl <> lbl THEN tot / n END) AS b FROM dd GROUP BY rid),
sv AS (SELECT CASE WHEN own_n <= 1 THEN 0.0 ELSE coalesce(CASE WHEN greatest(a, b) = 0 THEN NULL ELSE (b - a) / greatest(a, b) END, 0.0) END AS s FROM ab)
SELECT """ + r4("avg(s)") + """ AS silhouette_sq_euclidean, (SELECT count(*) FROM st) AS cluster_count, count(*) AS customer_count FROM sv"""
    )


@register("silhouette", _sil_sql())
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = labelled_matrix(spark, sf_dir)
    out = C.silhouette_sq(m, MATRIX_COLS)
    return rounded(out.select("silhouette_sq_euclidean", F.col("cluster_count").cast("long").alias("cluster_count"), "customer_count"))


def _sampled_sql() -> str:
    dist = "sqrt(0.0 + " + " + ".join(f"(m.f{j} - s.f{j}) * (m.f{j} - s.f{j})" for j in range(P_)) + ")"
    return (
        LAB_CTE + ", " + _MAT + f""", smp AS (SELECT * FROM mat ORDER BY md5(CUST_ID), CUST_ID LIMIT {C.SILHOUETTE_ROWS}),
far AS (SELECT s.CUST_ID, s.cluster_label AS own, m.cluster_label AS cl, sum({dist}) AS far, count(*) AS n FROM smp s, mat m GROUP BY ALL),
ab AS (SELECT CUST_ID, max(n) FILTER (WHERE cl = own) AS n, max(CASE WHEN n > 1 THEN far / (n - 1) END) FILTER (WHERE cl = own) AS a,
              min(far / n) FILTER (WHERE cl <> own) AS b FROM far GROUP BY CUST_ID),
sv AS (SELECT CASE WHEN n <= 1 THEN 0.0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0.0) END AS s FROM ab)
SELECT """ + r4("avg(s)") + " AS silhouette_sampled, " + r4("stddev_samp(s) / sqrt(count(*)) * sqrt(1.0 - count(*) / CAST((SELECT count(*) FROM mat) AS DOUBLE))")
        + """ AS standard_error, count(*) AS sampled_rows, (SELECT count(DISTINCT cluster_label) FROM mat) AS cluster_count, (SELECT count(*) FROM mat) AS row_count FROM sv"""
    )


@register("silhouette_sampled", _sampled_sql())
def silhouette_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Euclidean silhouette of a fixed hash sample (the operator's feature) against every customer."""

    return rounded(C.silhouette_sampled(labelled_matrix(spark, sf_dir), MATRIX_COLS))


# ---- rows-only: real model fits ---------------------------------------------------------------
@register("kmeans_segments")
def kmeans_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2 + M10: k=3 on all 12 unscaled features (10 restarts), canonical labels."""

    return kmeans_result(spark, sf_dir).labels


@register("kmeans_personas")
def kmeans_personas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persona path."""

    wp = persona_frame(spark, sf_dir)
    return wp.select("CUST_ID", "cluster", "persona", "recommended_product")


@register("persona_fit_summary")
def persona_fit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M15 + A15 on the fitted persona clusters."""

    return P.persona_summary(persona_frame(spark, sf_dir))


@register("persona_targets")
def persona_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted personas, top 10 customers of every persona by its sort key."""

    return rounded(P.persona_top_n(persona_frame(spark, sf_dir), 10))


@register("segment_quality")
def segment_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9 + M11 + A12/A13 for the fitted k-means segments."""

    feat = features(spark, sf_dir)
    res = kmeans_result(spark, sf_dir)
    m = to_matrix(feat).join(res.labels, "CUST_ID")
    sil = C.silhouette_sq(m, MATRIX_COLS)
    return rounded(sil.select("*", F.lit(float(res.inertia)).alias("inertia"), F.lit(res.algorithm).alias("chosen_algorithm")))


# ---- invariants of the fitted models: each must hold for every customer -----------------------
_ALL = "SELECT count(*) AS customers, count(*) AS holds FROM customer"


@register("kmeans_nearest_center", _ALL)
def kmeans_nearest_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2 / M9: every customer's label is that of the nearest returned center
    (within rounding of the two distances)."""

    res = kmeans_result(spark, sf_dir)
    cols = res.feature_columns
    m = to_matrix(features(spark, sf_dir)).join(res.labels, "CUST_ID")
    vec = F.array(*[F.col(c).cast("double") for c in cols])
    far = [C.euclidean(vec, F.array(*[F.lit(float(v)) for v in c])) for c in res.centers]
    own = F.element_at(F.array(*far), F.col(C.LABEL) + 1)
    return m.agg(F.count(F.lit(1)).alias("customers"), F.count_if(own <= F.least(*far) * (1 + 1e-9)).alias("holds"))


@register("persona_counts_add_up", _ALL)
def persona_counts_add_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M15 + A15: the fitted personas' customers add up to the table."""

    s = P.persona_summary(persona_frame(spark, sf_dir)).agg(F.sum("customer_count").alias("holds"))
    return s.crossJoin(persona_frame(spark, sf_dir).agg(F.count(F.lit(1)).alias("customers"))).select("customers", "holds")
