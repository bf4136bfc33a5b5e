"""Fitted models as versioned tables (G1, M17): what scoring needs, without refitting.

A version is one row in a folder of its own: the columns, the centers, the frozen
imputation values, the parameters they were fitted with and, if there is one, the
surrogate forest's node arrays. Which version is current is told by the newest of a
row of empty marker files, so a swap is one file created, never a file rewritten, and
a reader sees either the old or the new version. All sizes are those of a model
(centers x features, trees x nodes), not of the data.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import SparkSession

SCHEMA = (
    "algorithm string, columns array<string>, centers array<array<double>>, frozen map<string,double>, parameters string, "
    "forest struct<shape:array<int>,feature:array<int>,threshold:array<double>,left:array<int>,right:array<int>,cover:array<double>,value:array<double>>"
)


@dataclass
class Model:
    algorithm: str
    columns: list[str]
    centers: list[list[float]]
    frozen: dict[str, float | None] = field(default_factory=dict)
    parameters: dict[str, Any] = field(default_factory=dict)
    forest: dict | None = None
    version: int = 0


class ModelStore:
    """The versions of named models under a shared folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, *parts: str) -> list[str]:
        fs, p = self._path(*parts)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def versions(self, name: str) -> list[int]:
        """Versions that are written in full."""

        return [int(v[1:]) for v in self._names(name, "versions") if v.startswith("v") and "_SUCCESS" in self._names(name, "versions", v)]

    def save(self, name: str, model: Model, promote: bool = True) -> int:
        """Write the next version; with ``promote`` it becomes the current one."""

        taken = [int(v[1:]) for v in self._names(name, "versions") if v.startswith("v")]
        version = max(taken, default=0) + 1
        f = model.forest
        packed = None if f is None else (
            list(map(int, f["value"].shape)), *[np.asarray(f[k]).ravel().tolist() for k in ("feature", "threshold", "left", "right", "cover", "value")])
        row = (model.algorithm, list(model.columns), [list(map(float, c)) for c in model.centers], model.frozen, json.dumps(model.parameters), packed)
        # Mode "error": of two writers of one version the second fails.
        self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("error").parquet(f"{self.root}/{name}/versions/v{version:08d}")
        if promote:
            self.promote(name, version)
        return version

    def promote(self, name: str, version: int) -> None:
        """Make a written version current."""

        if version not in self.versions(name):
            raise KeyError(f"model '{name}' has no version {version}")
        marks = self._names(name, "current")
        turn = max((int(m.split("-")[0]) for m in marks), default=0) + 1
        fs, p = self._path(name, "current", f"{turn:012d}-{version}-{uuid.uuid4().hex[:8]}")
        fs.create(p, False).close()

    def current(self, name: str) -> int:
        """The current version; KeyError where none is."""

        marks = self._names(name, "current")
        if not marks:
            raise KeyError(f"model '{name}' has no current version")
        return int(marks[-1].split("-")[1])

    def load(self, name: str, version: int | None = None) -> Model:
        """A version's model, the current one by default."""

        version = self.current(name) if version is None else version
        row = self.spark.read.schema(SCHEMA).parquet(f"{self.root}/{name}/versions/v{version:08d}").first()
        forest = None
        if row["forest"] is not None:
            t, n, c = row["forest"]["shape"]
            forest = {k: np.array(row["forest"][k]).reshape(t, n) for k in ("feature", "threshold", "left", "right", "cover")}
            forest |= {"value": np.array(row["forest"]["value"]).reshape(t, n, c), "classes": c}
        return Model(row["algorithm"], list(row["columns"]), [list(c) for c in row["centers"]], dict(row["frozen"]), json.loads(row["parameters"]), forest, version)
