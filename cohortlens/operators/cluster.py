"""Clustering (M2-M4, M8-M10, M15-M17) and segment quality.

* K-means runs Lloyd's iterations for all restarts together: one job per
  iteration reads the table once, every task assigns its rows to the centers of
  all restarts with numpy and sends one partial sum for each restart and cluster.
  Seeding is k-means|| over all rows (Bahmani et al., 2012): a few passes draw
  candidates by squared distance, a pass weighs them, weighted k-means++ reduces
  them. Draws hang on row hashes, not on the partitioning. The restart with the
  lowest cost wins; labels are numbered by the center of a ranking feature, descending.
* ``kmeans_step`` is one explicit Lloyd iteration (assignment by a literal
  k-center array, means by a k-group aggregate) used as the SQL-checkable
  core of the algorithm.
* ``silhouette_sq`` is the exact silhouette under squared Euclidean distance in
  O(n·k): the mean squared distance from x to a cluster C is
  ‖x‖² − 2·x·S_C/n_C + Q_C/n_C with per-cluster sums S_C, Q_C.
* The plain Euclidean silhouette needs every pair of points (O(n²)):
  ``silhouette_sampled`` measures a hash sample of rows against all rows and gives
  its standard error.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens import catalog
from cohortlens.functions.expr import euclidean, round_half_up
from cohortlens.operators.segments import MAX_CLUSTERS
from cohortlens.session import materialize

LABEL = "cluster_label"


@dataclass
class KMeansResult:
    labels: DataFrame            # id, cluster_label
    centers: list[list[float]]   # canonical order
    cost: float
    seed: int
    costs: dict[int, float]
    converged: bool = True       # False: a restart still moved after max_iter iterations


def plus_plus(points: np.ndarray, k: int, seed: int, weights: np.ndarray | None = None) -> np.ndarray:
    """k-means++ seeding of (weighted) points: each next center is drawn by weight
    times squared distance to the nearest one."""

    rng = np.random.default_rng(seed)
    weights = np.ones(len(points)) if weights is None else weights
    picked = [points[rng.choice(len(points), p=weights / weights.sum())]]
    near = ((points - picked[0]) ** 2).sum(axis=1)
    while len(picked) < k:
        pull = near * weights
        at = rng.choice(len(points), p=pull / pull.sum()) if pull.sum() > 0 else rng.integers(len(points))
        picked.append(points[at])
        near = np.minimum(near, ((points - picked[-1]) ** 2).sum(axis=1))
    return np.array(picked)


def centred(x: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``nearest`` needs of some rows, whatever the points: mean, rows about it, their squared lengths."""

    x0 = np.ascontiguousarray(x - mean)
    return mean, x0, np.einsum("ij,ij->i", x0, x0)


def nearest(x: np.ndarray, points: np.ndarray, about: tuple | None = None) -> np.ndarray:
    """The place of each row's nearest point (squared Euclidean, ties to the first): one
    matrix product, and distances summed feature by feature for the rows whose two
    nearest points it cannot tell apart."""

    if len(points) == 1 or not len(x):
        return np.zeros(len(x), dtype=np.int64)
    mean, x0, length = about or centred(x, points.mean(axis=0))
    p0 = points - mean
    sizes = (p0 ** 2).sum(axis=1)
    d = (-2 * p0) @ x0.T + sizes[:, None]  # (points, rows)
    own = d.argmin(axis=0)
    rows = np.arange(len(x))
    least = d[own, rows]
    d[own, rows] = np.inf
    unsure = np.flatnonzero(~(d.min(axis=0) - least > 1e-9 * (length + sizes.max())))
    if len(unsure):
        own[unsure] = np.argmin([((x[unsure] - c) ** 2).sum(axis=1) for c in points], axis=0)
    return own


def draw_far_rows(data: DataFrame, id_col: str, cols: list[str], near: dict[int, np.ndarray], take: int, turn: int) -> dict[int, np.ndarray]:
    """For each restart, ``take`` rows drawn without replacement, with chances by
    squared distance to the nearest of the points in ``near`` (evenly, if there are
    none): the rows with the least ``-log(u) / distance²``, u a hash of the row, the
    restart and the turn. Every task sends its ``take`` least for each restart."""

    names = {s: f"hash_{s}" for s in near}
    mean = np.mean([points.mean(axis=0) if len(points) else np.zeros(len(cols)) for points in near.values()], axis=0)

    def least(batches):
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            x = np.ascontiguousarray(pdf[cols].to_numpy(dtype=float))
            about = centred(x, mean)
            for s, points in near.items():
                u = ((pdf[names[s]].to_numpy(dtype=np.int64).view(np.uint64) >> np.uint64(11)) + 0.5) / 2.0**53
                far = np.ones(len(x)) if not len(points) else ((x - points[nearest(x, points, about)]) ** 2).sum(axis=1)
                on = far > 0
                key, rows = -np.log(u[on]) / far[on], x[on]
                if s in kept:
                    key, rows = np.concatenate([kept[s][0], key]), np.concatenate([kept[s][1], rows])
                best = np.argsort(key, kind="stable")[:take]
                kept[s] = key[best], rows[best]
        yield pd.DataFrame([(s, k, list(r)) for s, (key, rows) in kept.items() for k, r in zip(key, rows)], columns=["restart", "key", "point"])

    hashed = data.select(*cols, *[F.xxhash64(id_col, *cols, F.lit(s), F.lit(turn)).alias(n) for s, n in names.items()])
    order = Window.partitionBy("restart").orderBy("key", "point")
    drawn = hashed.mapInPandas(least, "restart int, key double, point array<double>").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= take)
    found: dict[int, list] = {s: [] for s in near}
    for r in sorted(drawn.collect(), key=lambda r: (r["restart"], r["rank"])):
        found[r["restart"]].append(r["point"])
    return {s: np.array(v, dtype=float).reshape(-1, len(cols)) for s, v in found.items()}


def seed_centers(data: DataFrame, id_col: str, cols: list[str], k: int, seeds: Sequence[int], rounds: int = 4) -> dict[int, np.ndarray]:
    """k-means|| for several restarts together. One even draw, then ``rounds`` passes
    that add 2k candidates each: the driver holds at most 2k·rounds + 1 points a
    restart, whatever the table's size. Every row is then counted for its nearest
    candidate, and weighted k-means++ with a few weighted Lloyd steps leaves k."""

    near = draw_far_rows(data, id_col, cols, {s: np.zeros((0, len(cols))) for s in seeds}, 1, 0)
    if not all(len(points) for points in near.values()):
        raise ValueError("no rows to cluster")
    for turn in range(1, rounds + 1):
        more = draw_far_rows(data, id_col, cols, near, 2 * k, turn)
        near = {s: np.concatenate([near[s], more[s]]) for s in near}
    counted = lloyd_pass(data, cols, near, costs=False)
    out = {}
    for s, points in near.items():
        weights = np.array([counted[s, i][0] if (s, i) in counted else 0 for i in range(len(points))], dtype=float)
        centers = plus_plus(points, k, s, weights)
        for _ in range(10):
            own = np.argmin([((points - c) ** 2).sum(axis=1) for c in centers], axis=0)
            held = [weights[own == i].sum() for i in range(k)]
            centers = np.array([np.average(points[own == i], axis=0, weights=weights[own == i]) if held[i] > 0 else centers[i] for i in range(k)])
        out[s] = centers
    return out


def lloyd_pass(data: DataFrame, cols: list[str], centers: dict[int, np.ndarray], costs: bool = True) -> dict[tuple[int, int], tuple[int, float, np.ndarray]]:
    """(rows, cost, sums) of each restart and cluster, from one pass over the data.

    The driver gets one row for each restart and cluster. Without ``costs`` they are 0."""

    names = [f"s{j}" for j in range(len(cols))]
    mean = np.mean([c.mean(axis=0) for c in centers.values()], axis=0)  # sums are taken about it, for precision

    def partial(batches):
        sums: dict[tuple[int, int], list] = {}
        for pdf in batches:
            x = np.ascontiguousarray(pdf[cols].to_numpy(dtype=float))
            about = centred(x, mean)
            for restart, c in centers.items():
                own = nearest(x, c, about)
                held = np.bincount(own, minlength=len(c))
                far = np.bincount(own, weights=((x - c[own]) ** 2).sum(axis=1), minlength=len(c)) if costs else np.zeros(len(c))
                total = (own[None, :] == np.arange(len(c))[:, None]).astype(float) @ about[1]
                for i in np.flatnonzero(held):
                    got = sums.setdefault((restart, int(i)), [0, 0.0, np.zeros(len(cols))])
                    got[0] += int(held[i])
                    got[1] += float(far[i])
                    got[2] += total[i]
        yield pd.DataFrame([(r, i, n, cost, *v) for (r, i), (n, cost, v) in sums.items()], columns=["restart", "cluster", "n", "cost", *names])

    schema = "restart int, cluster int, n bigint, cost double, " + ", ".join(f"{s} double" for s in names)
    total = data.mapInPandas(partial, schema).groupBy("restart", "cluster").agg(*[F.sum(c).alias(c) for c in ("n", "cost", *names)])
    return {(r["restart"], r["cluster"]): (r["n"], r["cost"], np.array([r[s] for s in names]) + r["n"] * mean) for r in total.collect()}


def kmeans_fit(
    matrix: DataFrame,
    cols: Sequence[str],
    k: int = 3,
    id_col: str = "CUST_ID",
    seed: int = catalog.SEED,
    n_init: int = catalog.KMEANS_RESTARTS,
    max_iter: int = 300,
    tol: float = 1e-4,
    rank_by: str | None = None,
) -> KMeansResult:
    """M2/M3: best of ``n_init`` restarts (seeds seed…seed+n_init−1), labels
    numbered by the ``rank_by`` center (default: first column) descending. A
    restart has converged when its centers move by less than ``tol`` × the mean
    feature variance (squared, all centers); ``converged`` says whether all did
    within ``max_iter`` iterations. Every row takes part in seeding and iterations;
    a table without rows is an error."""

    cols = list(cols)
    data = materialize(matrix.select(id_col, *[F.col(c).cast("double").alias(c) for c in cols]), "kmeans-input")
    var = data.agg(*[F.var_pop(c).alias(c) for c in cols]).first()
    bar = max(tol * sum(float(var[c] or 0.0) for c in cols) / max(len(cols), 1), 1e-24)
    centers = seed_centers(data, id_col, cols, k, range(seed, seed + n_init))
    moving, costs = dict(centers), {}
    for _ in range(max_iter):
        found = lloyd_pass(data, cols, moving, costs=False)
        for s in list(moving):
            new = np.array([found[s, i][2] / found[s, i][0] if (s, i) in found else moving[s][i] for i in range(k)])
            still = ((new - moving[s]) ** 2).sum() > bar
            centers[s] = moving[s] = new
            if not still:
                del moving[s]
        if not moving:
            break
    found = lloyd_pass(data, cols, centers)
    for s in centers:
        costs[s] = sum(v[1] for (r, _), v in found.items() if r == s)
    s = min(costs, key=lambda x: (costs[x], x))
    ri = cols.index(rank_by) if rank_by in cols else 0
    best = [list(map(float, c)) for c in sorted(centers[s].tolist(), key=lambda c: (-c[ri], c))]
    labels = assign_nearest(data, cols, best).select(id_col, LABEL)
    return KMeansResult(labels=labels, centers=best, cost=costs[s], seed=s, costs=costs, converged=not moving)


def assign_nearest(matrix: DataFrame, cols: Sequence[str], centers: list[list[float]], out: str = LABEL) -> DataFrame:
    """Nearest center per row (ties → lowest index), as one narrow projection."""

    if len(centers) > MAX_CLUSTERS:
        raise ValueError("too many centers to ship as literals")
    vec = F.array(*[F.col(c).cast("double") for c in cols])
    cs = F.array(*[F.struct(F.lit(i).alias("i"), F.array(*[F.lit(float(v)) for v in c]).alias("c")) for i, c in enumerate(centers)])
    best = F.array_min(F.transform(cs, lambda s: F.struct(euclidean(vec, s["c"]).alias("d"), s["i"].alias("i"))))
    return matrix.withColumn(out, best["i"].cast("int"))


def kmeans_step(matrix: DataFrame, cols: Sequence[str], centers: list[list[float]], digits: int = 4) -> tuple[DataFrame, list[list[float]]]:
    """One Lloyd iteration: assign, then per-cluster means (rounded to
    ``digits``); an empty cluster keeps its previous center."""

    assigned = assign_nearest(matrix, cols, centers)
    means = assigned.groupBy(LABEL).agg(F.count(F.lit(1)).alias("n"), *[round_half_up(F.avg(F.col(c).cast("double")), digits).alias(c) for c in cols])
    got = {r[LABEL]: [r[c] for c in cols] for r in means.collect()}
    new = [got.get(i, centers[i]) for i in range(len(centers))]
    return assigned, new


def initial_centers(matrix: DataFrame, cols: Sequence[str], k: int, id_col: str = "CUST_ID") -> list[list[float]]:
    """Deterministic seeding for ``kmeans_step``: the first k rows by id
    (``orderBy.limit`` → TakeOrderedAndProject)."""

    rows = matrix.select(id_col, *cols).orderBy(id_col).limit(k).collect()
    return [[float(r[c]) for c in cols] for r in rows]


def lloyd(matrix: DataFrame, cols: Sequence[str], k: int, iterations: int = 3, id_col: str = "CUST_ID") -> tuple[DataFrame, list[list[float]]]:
    centers = [[_r4(v) for v in c] for c in initial_centers(matrix, cols, k, id_col)]
    assigned = None
    for _ in range(iterations):
        assigned, centers = kmeans_step(matrix, cols, centers)
    return assigned, centers


def _r4(v: float) -> float:
    import math

    return math.floor(v * 10000.0 + 0.5) / 10000.0


def silhouette_sq(matrix: DataFrame, cols: Sequence[str], label_col: str = LABEL) -> DataFrame:
    """M11 under squared Euclidean distance, exact, O(n·k); NULL unless
    1 < labels < rows. Values are centred by the global mean first to keep the
    expansion ‖x‖² − 2x·S/n + Q/n numerically tame."""

    spark = matrix.sparkSession
    means = matrix.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols]).first()
    xs = [(F.col(c).cast("double") - F.lit(float(means[c] or 0.0))) for c in cols]
    vec = F.array(*xs)
    sq = F.aggregate(F.transform(vec, lambda v: v * v), F.lit(0.0), lambda a, b: a + b)
    base = matrix.select(F.col(label_col).alias("lbl"), vec.alias("x"), sq.alias("q"))
    stats = base.groupBy("lbl").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(len(cols))],
        F.sum("q").alias("Q"),
    )
    rows = stats.limit(MAX_CLUSTERS + 1).collect()
    if len(rows) > MAX_CLUSTERS:
        raise ValueError("too many clusters")
    n_total = sum(r["n"] for r in rows)
    if not (1 < len(rows) < n_total):
        return spark.createDataFrame([(None, len(rows), n_total)], "silhouette_sq_euclidean double, cluster_count int, customer_count long")
    cl = F.array(*[
        F.struct(F.lit(r["lbl"]).alias("lbl"), F.lit(r["n"]).cast("double").alias("n"),
                 F.array(*[F.lit(float(r[f"s{i}"])) for i in range(len(cols))]).alias("s"), F.lit(float(r["Q"])).alias("Q"))
        for r in rows
    ])

    def mean_sq(c):
        dot = F.aggregate(F.zip_with(F.col("x"), c["s"], lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        return F.col("q") * c["n"] - F.lit(2.0) * dot + c["Q"]

    per = base.select(
        "lbl",
        F.transform(cl, lambda c: F.struct(c["lbl"].alias("lbl"), c["n"].alias("n"), mean_sq(c).alias("tot"))).alias("d"),
    )
    own = F.filter("d", lambda s: s["lbl"] == F.col("lbl"))[0]
    a = F.when(own["n"] > 1, own["tot"] / (own["n"] - F.lit(1.0))).otherwise(F.lit(0.0))
    b = F.array_min(F.transform(F.filter("d", lambda s: s["lbl"] != F.col("lbl")), lambda s: s["tot"] / s["n"]))
    s = F.when(own["n"] <= 1, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0)))
    return per.agg(
        F.avg(s).alias("silhouette_sq_euclidean"), F.lit(len(rows)).alias("cluster_count"), F.count(F.lit(1)).alias("customer_count")
    )


SILHOUETTE_ROWS = 256


def silhouette_sampled(matrix: DataFrame, cols: Sequence[str], label_col: str = LABEL, id_col: str = "CUST_ID", sample_rows: int = SILHOUETTE_ROWS) -> DataFrame:
    """The mean Euclidean silhouette of a sample of rows, each measured against
    all rows, with its standard error (of a sample without replacement: 0 when the
    sample is the table). The sample, the ``sample_rows`` rows with the least md5 of the
    id, goes to the tasks: at most sample_rows × (columns + 1) numbers, whatever the
    table's size. A task sends one sum of distances for each sampled row and label.

    Null values count as 0; rows without a label take no part; NULL unless
    1 < labels < rows. More than MAX_CLUSTERS labels are an error."""

    cols = list(cols)
    spark = matrix.sparkSession
    data = matrix.where(F.col(label_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("id"), F.col(label_col).cast("long").alias("lbl"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{j}") for j, c in enumerate(cols)])
    xs = [f"x{j}" for j in range(len(cols))]
    sizes = {r["lbl"]: r["n"] for r in data.groupBy("lbl").agg(F.count(F.lit(1)).alias("n")).limit(MAX_CLUSTERS + 1).collect()}
    if len(sizes) > MAX_CLUSTERS:
        raise ValueError("too many clusters")
    total = sum(sizes.values())
    if not (1 < len(sizes) < total):
        return spark.createDataFrame([(None, None, 0, len(sizes), total)], "silhouette_sampled double, standard_error double, sampled_rows long, cluster_count long, row_count long")
    sample = data.orderBy(F.md5(F.col("id").cast("binary")), "id", "lbl", *xs).limit(sample_rows).collect()
    points = spark.sparkContext.broadcast(np.array([[r[c] for c in xs] for r in sample]))

    def sums(batches):
        s = points.value
        found: dict[int, np.ndarray] = {}
        for pdf in batches:
            x, lbl = pdf[xs].to_numpy(dtype=float), pdf["lbl"].to_numpy()
            for at in range(0, len(x), 2048):
                sq = np.zeros((len(x[at:at + 2048]), len(s)))
                for j in range(len(xs)):
                    sq += (x[at:at + 2048, j, None] - s[None, :, j]) ** 2
                d, part = np.sqrt(sq), lbl[at:at + 2048]
                for k in np.unique(part):
                    found[k] = found.get(k, 0.0) + d[part == k].sum(axis=0)
        yield pd.DataFrame([(i, k, v) for k, row in found.items() for i, v in enumerate(row)], columns=["i", "lbl", "far"])

    per = data.drop("id").mapInPandas(sums, "i long, lbl long, far double").groupBy("i", "lbl").agg(F.sum("far").alias("far"))
    known = spark.createDataFrame(list(sizes.items()), "lbl long, n long")
    own = spark.createDataFrame([(i, r["lbl"]) for i, r in enumerate(sample)], "i long, own long")
    per = per.join(F.broadcast(known), "lbl").join(F.broadcast(own), "i").groupBy("i").agg(
        F.max(F.when(F.col("lbl") == F.col("own"), F.col("n"))).alias("n"),
        F.max(F.when(F.col("lbl") == F.col("own"), F.try_divide("far", F.col("n") - 1))).alias("a"),
        F.min(F.when(F.col("lbl") != F.col("own"), F.col("far") / F.col("n"))).alias("b"),
    )
    score = F.when(F.col("n") <= 1, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    error = F.stddev_samp(score) / F.sqrt(F.count(F.lit(1))) * F.sqrt(F.lit(1.0) - F.count(F.lit(1)) / F.lit(float(total)))
    return per.agg(
        F.avg(score).alias("silhouette_sampled"), error.alias("standard_error"), F.count(F.lit(1)).alias("sampled_rows"),
        F.lit(len(sizes)).cast("long").alias("cluster_count"), F.lit(total).cast("long").alias("row_count"),
    )


def centers_table(spark, centers: list[list[float]], cols: Sequence[str]) -> DataFrame:
    """M9: centers as (cluster_label, feature, center) rows, 4 decimals."""

    rows = [(i, j, c, _r4(v)) for i, cen in enumerate(centers) for j, (c, v) in enumerate(zip(cols, cen))]
    return spark.createDataFrame(rows, "cluster_label int, position int, feature string, center double")
