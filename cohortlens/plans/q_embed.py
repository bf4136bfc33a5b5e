"""Segment quality on the 64-dimensional ``embeddings`` table with its given
labels (A14, M11, M12 at a second dimensionality)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators import cluster as C
from cohortlens.operators import segments as S
from cohortlens.plans.common import r4, rounded
from cohortlens.plans.registry import register
from cohortlens.sources.tables import table

DIM = 64
COLS = [f"e{i}" for i in range(DIM)]


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("vec_id"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(COLS)],
                    F.col("label").cast("int").alias("cluster_label"))


_MAT = ("WITH mat AS (SELECT CAST(vec_id AS VARCHAR) AS vec_id, CAST(label AS INTEGER) AS cluster_label, "
        + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS f{i}" for i in range(DIM)) + " FROM embeddings)")
_CEN = "cen AS (SELECT cluster_label AS cl, " + ", ".join(f"{r4(f'avg(f{i})')} AS c{i}" for i in range(DIM)) + " FROM mat GROUP BY cluster_label)"
_DIST = "sqrt(0.0 + " + " + ".join(f"(m.f{i} - c.c{i}) * (m.f{i} - c.c{i})" for i in range(DIM)) + ")"


@register(
    "embedding_centers",
    _MAT + ", " + _CEN + ", lng AS (" + " UNION ALL ".join(f"SELECT cl AS cluster_label, {i} AS position, c{i} AS center FROM cen" for i in range(DIM)) + ") "
    "SELECT cluster_label, position, center FROM lng",
)
def embedding_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cen = S.explanation_centers(matrix(spark, sf_dir), COLS)
    return rounded(cen.select("cluster_label", F.posexplode("center").alias("position", "center")))


@register(
    "embedding_boundary",
    _MAT + ", " + _CEN + f""",
d AS (SELECT m.vec_id, m.cluster_label, c.cl, {_DIST} AS dist FROM mat m, cen c WHERE c.cl >= 0),
own AS (SELECT vec_id, cluster_label, dist AS own_d FROM d WHERE cl = cluster_label),
alt AS (SELECT vec_id, cl AS alt_label, dist AS alt_d, row_number() OVER (PARTITION BY vec_id ORDER BY dist, cl) AS rn FROM d WHERE cl <> cluster_label)
SELECT own.vec_id AS customer_id, own.cluster_label, alt_label AS nearest_alternate_cluster, {r4('own_d')} AS own_distance,
  {r4('alt_d')} AS alternate_distance, {r4('CASE WHEN alt_d > 0 THEN own_d / alt_d ELSE 1.0 END')} AS boundary_distance_ratio
FROM own JOIN alt ON own.vec_id = alt.vec_id AND alt.rn = 1""",
)
def embedding_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matrix(spark, sf_dir)
    return rounded(S.boundary_metrics(m, COLS, S.explanation_centers(m, COLS), id_col="vec_id"))


def _sil_sql() -> str:
    mu = "mu AS (SELECT " + ", ".join(f"avg(f{j}) AS m{j}" for j in range(DIM)) + " FROM mat)"
    xc = ("xc AS (SELECT cluster_label AS lbl, " + ", ".join(f"f{j} - m{j} AS x{j}" for j in range(DIM)) + ", "
          + " + ".join(f"(f{j} - m{j}) * (f{j} - m{j})" for j in range(DIM)) + " AS q FROM mat, mu)")
    st = "st AS (SELECT lbl AS cl, CAST(count(*) AS DOUBLE) AS n, " + ", ".join(f"sum(x{j}) AS s{j}" for j in range(DIM)) + ", sum(q) AS Q FROM xc GROUP BY lbl)"
    dot = " + ".join(f"p.x{j} * s.s{j}" for j in range(DIM))
    return (
        _MAT + ", " + mu + ", " + xc + ", " + st
        + ", pts AS (SELECT *, row_number() OVER () AS rid FROM xc), "
        + f"dd AS (SELECT p.rid, p.lbl, s.cl, s.n, p.q * s.n - 2.0 * ({dot}) + s.Q AS tot FROM pts p, st s), "
        + """ab AS (SELECT rid, max(CASE WHEN cl = lbl THEN n END) AS own_n,
                  max(CASE WHEN cl = lbl THEN CASE WHEN n > 1 THEN tot / (n - 1.0) ELSE 0.0 END END) AS a,
                  min(CASE WHEN cl <> lbl THEN tot / n END) AS b FROM dd GROUP BY rid),
sv AS (SELECT CASE WHEN own_n <= 1 THEN 0.0 ELSE coalesce(CASE WHEN greatest(a, b) = 0 THEN NULL ELSE (b - a) / greatest(a, b) END, 0.0) END AS s FROM ab)
SELECT """ + r4("avg(s)") + """ AS silhouette_sq_euclidean, (SELECT count(*) FROM st) AS cluster_count, count(*) AS customer_count FROM sv"""
    )


@register("embedding_silhouette", _sil_sql())
def embedding_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.silhouette_sq(matrix(spark, sf_dir), COLS)
    return rounded(out.select("silhouette_sq_euclidean", F.col("cluster_count").cast("long").alias("cluster_count"), "customer_count"))


@register("embedding_segments")
def embedding_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2 at 64 dimensions: k-means (k = number of given labels, 10 restarts)
    on every embedding; the given label is kept beside the fitted one."""

    m = matrix(spark, sf_dir)
    k = m.select("cluster_label").distinct().count()
    fit = C.kmeans_fit(m.select("vec_id", *COLS), COLS, max(k, 2), id_col="vec_id")
    return m.select("vec_id", F.col("cluster_label").alias("given_label")).join(fit.labels, "vec_id")
