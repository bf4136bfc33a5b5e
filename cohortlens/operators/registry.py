"""Clustering algorithms by name and the segmentation entry point.

An entry is a fit function, metadata and a table of parameter bounds; the bounds
are data, read against the profile of the table at hand (rows, widest feature range).
``segment`` clamps the request to them, runs the algorithm and reports one of the
``REASONS`` codes; a request that cannot be served is served by k-means.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens import catalog
from cohortlens.operators import cluster as C
from cohortlens.operators import density
from cohortlens.operators.features import feature_columns, to_matrix

#: Why a result was made the way it was.
REASONS = ("as_requested", "not_active", "too_few_segments", "fit_error")
DEFAULT = "kmeans"


@dataclass(frozen=True)
class Bound:
    """A parameter's default and the range it is clamped to, given the table's rows and
    its widest feature range. The default's type is the parameter's."""

    default: int | float
    least: int | float
    most: Callable[[int, float], int | float]

    def clamp(self, value: Any, rows: int, widest: float = 0.0) -> int | float:
        kind = type(self.default)
        try:
            number = kind(str(value))
        except ValueError:
            number = self.default
        if number != number:  # not a number
            number = self.default
        return max(self.least, min(number, kind(self.most(rows, widest))))


BOUNDS: dict[str, dict[str, Bound]] = {
    "kmeans": {
        "n_clusters": Bound(3, 2, lambda rows, widest: rows - 1),
        "n_init": Bound(catalog.KMEANS_RESTARTS, 1, lambda rows, widest: 100),
        "random_state": Bound(catalog.SEED, 0, lambda rows, widest: 2**31 - 1),
    },
    "bisecting_kmeans": {
        "n_clusters": Bound(3, 2, lambda rows, widest: rows - 1),
        "random_state": Bound(catalog.SEED, 0, lambda rows, widest: 2**31 - 1),
    },
    "dbscan": {
        "eps": Bound(0.5, 0.0001, lambda rows, widest: max(widest, 0.0001)),
        "min_samples": Bound(5, 2, lambda rows, widest: rows),
    },
    "hdbscan": {
        "min_cluster_size": Bound(5, 2, lambda rows, widest: rows),
        "min_samples": Bound(5, 2, lambda rows, widest: rows),
        "cut_distance": Bound(0.5, 0.0001, lambda rows, widest: max(widest, 0.0001)),
    },
}


@dataclass
class Entry:
    fit: Callable | None
    metadata: dict[str, Any]


@dataclass
class SegmentationResult:
    labels: DataFrame
    algorithm: str
    parameters: dict[str, Any]
    reason: str
    detail: str = ""
    centers: list[list[float]] | None = None
    inertia: float | None = None
    feature_columns: list[str] = field(default_factory=list)


_ENTRIES: dict[str, Entry] = {}


def register(name: str, fn: Callable | None, metadata: dict[str, Any]) -> None:
    """Add or replace an algorithm; one without a function is known but not active."""

    status = metadata.get("status", "active") if fn else "unavailable"
    _ENTRIES[name] = Entry(fn, {**metadata, "status": status})


def get(name: str) -> Callable | None:
    return _ENTRIES[name].fit if name in _ENTRIES else None


def list_available() -> list[dict[str, Any]]:
    return [{"name": n, "metadata": dict(_ENTRIES[n].metadata)} for n in sorted(_ENTRIES)]


def active_clustering() -> list[str]:
    return [n for n in sorted(_ENTRIES) if (_ENTRIES[n].metadata.get("type"), _ENTRIES[n].metadata["status"]) == ("clustering", "active")]


def bounded(algorithm: str, params: dict[str, Any], rows: int, widest: float = 0.0) -> dict[str, int | float]:
    """M4 / M7: every parameter of the algorithm, inside its bounds; others are dropped."""

    if rows < 2:
        raise ValueError("segmentation needs two rows or more")
    table = BOUNDS.get(algorithm, BOUNDS[DEFAULT])
    return {name: bound.clamp(params.get(name), rows, widest) for name, bound in table.items()}


def _kmeans(matrix: DataFrame, cols: list[str], params: dict[str, Any]):
    res = C.kmeans_fit(matrix, cols, params["n_clusters"], seed=params["random_state"], n_init=params["n_init"], rank_by="monthly_spend")
    return res.labels, res.centers, res.cost


def _bisecting(matrix: DataFrame, cols: list[str], params: dict[str, Any]):
    id_col = next(c for c in matrix.columns if c not in cols)
    data = VectorAssembler(inputCols=cols, outputCol="v").transform(matrix)
    model = BisectingKMeans(k=params["n_clusters"], seed=params["random_state"], featuresCol="v", predictionCol=C.LABEL).fit(data)
    labels = model.transform(data).select(id_col, C.LABEL)
    return labels, [list(map(float, c)) for c in model.clusterCenters()], float(model.summary.trainingCost)


def _dbscan(matrix: DataFrame, cols: list[str], params: dict[str, Any]):
    id_col = next(c for c in matrix.columns if c not in cols)
    return density.dbscan(matrix, cols, params["eps"], params["min_samples"], id_col), None, None


def _density_cut(matrix: DataFrame, cols: list[str], params: dict[str, Any]):
    id_col = next(c for c in matrix.columns if c not in cols)
    tree = density.hierarchy(matrix, cols, params["min_samples"], params["cut_distance"], id_col)
    return density.cut(tree, params["cut_distance"], params["min_cluster_size"], id_col), None, None


register("kmeans", _kmeans, {"type": "clustering", "algorithm": "KMeans"})
register("bisecting_kmeans", _bisecting, {"type": "clustering", "algorithm": "BisectingKMeans"})
register("dbscan", _dbscan, {"type": "clustering", "algorithm": "DBSCAN"})
register("hdbscan", _density_cut, {"type": "clustering", "algorithm": "density hierarchy, cut at a distance"})


def segment(features: DataFrame, algorithm: str = DEFAULT, params: dict[str, Any] | None = None,
            id_col: str = "CUST_ID", requested_clusters: int = 3) -> SegmentationResult:
    """Cluster every feature (P2, P3) with ``algorithm`` (M8: else with k-means)."""

    wanted = {"n_clusters": requested_clusters, **(params or {})}
    cols = feature_columns(features, id_col)
    matrix = to_matrix(features, id_col, cols)
    ranges = matrix.agg(F.count(F.lit(1)).alias("rows"), F.greatest(F.lit(0.0), *[F.max(c) - F.min(c) for c in cols]).alias("widest")).first()
    rows, widest = ranges["rows"], ranges["widest"] or 0.0
    reason, detail = "as_requested", ""
    for name in dict.fromkeys((algorithm, DEFAULT)):
        if name not in active_clustering():
            reason, detail = "not_active", name
            continue
        chosen = bounded(name, wanted, rows, widest)
        try:
            labels, centers, cost = get(name)(matrix, cols, chosen)
            segments = labels.where(F.col(C.LABEL) >= 0).select(C.LABEL).distinct().limit(2).count()
        except Exception as err:  # noqa: BLE001 - the next algorithm is tried, the cause is kept
            if name == DEFAULT:
                raise
            reason, detail = "fit_error", f"{name}: {type(err).__name__}"
            continue
        if segments < 2 and name != DEFAULT:
            reason, detail = "too_few_segments", name
            continue
        return SegmentationResult(labels, name, chosen, reason, detail, centers, cost, cols)
    raise ValueError(f"no active clustering algorithm ({detail})")
