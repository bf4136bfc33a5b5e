"""Spark session helpers.

Library functions never create sessions; they take DataFrames. These helpers
exist for tests, the benchmark and command-line use.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "cohortlens") -> SparkSession:
    """A local session configured like the cluster profile (AQE on, UI off)."""

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("COHORTLENS_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    The setting names a folder that driver and executors share and is used as is.
    Where it is unset, only a ``local[...]`` master (one process, as in tests) gets
    a scratch folder; anything else is an error, as executors would write to their
    own disks.
    """

    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="cohortlens-ckpt-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


_MATERIALIZED: dict[tuple, object] = {}
_WRITTEN: dict[str, list[str]] = {}
_ON_DROP: list = []


def remember(spark: SparkSession, path: str) -> None:
    """``drop_materialized`` deletes ``path`` too."""

    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)


def on_drop(forget) -> None:
    """Call ``forget`` when the session's tables are dropped: for what is kept in memory about them."""

    _ON_DROP.append(forget)


def input_state(spark: SparkSession, folder: str) -> str:
    """What the files under ``folder`` are now (names, sizes, times): derived
    tables are only reused while this stays the same."""

    import hashlib

    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    seen, queue = [], [path]
    while queue:
        for st in fs.listStatus(queue.pop()):
            if st.isDirectory():
                queue.append(st.getPath())
            else:
                seen.append(f"{st.getPath()}:{st.getLen()}:{st.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()


def materialize(df, name: str, key: tuple | None = None):
    """Write ``df`` as a parquet table under the shared checkpoint folder and
    read it back: cuts lineage, survives executor loss, and keeps column
    pruning and predicate pushdown (unlike an RDD checkpoint). With ``key``
    (its first entry the input folder), the table is reused for the rest of the
    session while the input files stay the same."""

    import uuid

    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    memo_key = (app, name, key, input_state(spark, key[0])) if key is not None else None
    if memo_key is not None and memo_key in _MATERIALIZED:
        return _MATERIALIZED[memo_key]
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/cohortlens-tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    remember(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    if memo_key is not None:
        _MATERIALIZED[memo_key] = out
    return out


def reuse(spark: SparkSession, name: str, key: tuple):
    """The table that ``materialize`` keeps under ``key``, if the input is still the same."""

    return _MATERIALIZED.get((spark.sparkContext.applicationId, name, key, input_state(spark, key[0])))


def drop_materialized(spark: SparkSession) -> int:
    """Delete the tables this session wrote; call it before the session ends."""

    app = spark.sparkContext.applicationId
    jvm = spark.sparkContext._jvm
    paths = _WRITTEN.pop(app, [])
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    for k in [k for k in _MATERIALIZED if k[0] == app]:
        del _MATERIALIZED[k]
    for forget in _ON_DROP:
        forget()
    return len(paths)
