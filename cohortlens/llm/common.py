"""Shared helpers of the training-data operators.

Intermediate tables go to the folder that ``spark.checkpoint.dir`` names, which
driver and executors share. Only a ``local[...]`` master, where everything runs
in one process, falls back to a scratch folder when the setting is missing.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: A key holding at least 1/HOT_SHARE of all rows counts as hot, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 256
#: A table counted to have at most this many narrow rows may be broadcast.
SMALL_ROWS = 100_000
#: A Python worker turns texts into strings and words up to about so many bytes at a time.
TOGETHER = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; an error where a cluster names none."""

    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="llm-shared-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps restart
    from the files when an executor is lost, and nothing is computed twice."""

    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, whatever extra columns it carries."""

    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")



def join_skewed(left: DataFrame, right: DataFrame, key: str, n_col: str, *, how: str = "inner") -> DataFrame:
    """Join ``left`` to ``right`` (one row per ``key``; ``n_col`` = how many rows
    of ``left`` carry the key) without sending a hot key to one task.

    Keys with at least 1/HOT_SHARE of the counted rows are at most HOT_SHARE
    many, whatever the size of the data: these few rows are broadcast and their
    ``left`` rows stay where they are. All others meet by a shuffle. ``left`` is
    read twice, so pass a saved or cheaply rescanned frame. Null keys match
    nothing."""

    total = right.agg(F.sum(n_col)).first()[0] or 0
    bar = max(1, -(-total // HOT_SHARE))
    hot = right.filter(F.col(n_col) >= bar)
    cold = right.filter(F.col(n_col) < bar)
    near = left.join(F.broadcast(hot), key, "inner")
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold.hint("shuffle_merge"), key, how)
    return near.select(*rest.columns).unionByName(rest)


def join_small(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Join a saved table with one row per ``key``: broadcast if it is counted to
    have at most SMALL_ROWS rows, else by a shuffle whose hot partitions the
    adaptive skew join splits."""

    few = right.count() <= SMALL_ROWS
    return left.join(F.broadcast(right) if few else right.hint("shuffle_merge"), key)


def ranked_in_groups(df: DataFrame, groups: list[str], order: list[str], weight: str | None, *, rows: int, into: int = 4096) -> DataFrame:
    """Add ``rank`` (gapless from 0 in each group) and, with ``weight``, ``before``
    (the weights of the earlier rows), without one task holding a whole group.

    ``order[0]`` must be a non-negative long spread evenly (a hash): its range
    [0, 2^32) is cut into slices of about ``into`` rows of a group that would hold
    every row. Slice totals (few rows) give each slice its start, and only a slice
    is sorted at a time. ``rows`` is the row count of ``df``."""

    slices = max(1, -(-rows // into))
    sliced = df.withColumn("slice_", F.floor(F.col(order[0]) * F.lit(slices) / F.lit(2**32)).cast("long"))
    w = F.col(weight) if weight else F.lit(0)
    sizes = sliced.groupBy(*groups, "slice_").agg(F.count(F.lit(1)).alias("n_"), F.sum(w).alias("w_"))
    from pyspark.sql import Window

    past = Window.partitionBy(*groups).orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *[F.col(g).alias(f"{g}_k") for g in groups], F.col("slice_").alias("slice_k"),
        F.coalesce(F.sum("n_").over(past), F.lit(0)).alias("n0_"), F.coalesce(F.sum("w_").over(past), F.lit(0)).alias("w0_"),
    )
    inside = Window.partitionBy(*groups, "slice_").orderBy(*order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = sliced.withColumn("r_", F.row_number().over(inside) - 1)
    if weight:
        local = local.withColumn("b_", F.coalesce(F.sum(w).over(earlier), F.lit(0)))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"{g}_k")) for g in groups] + [F.col("slice_") == F.col("slice_k")])
    out = local.join(starts, same, "inner").withColumn("rank", (F.col("r_") + F.col("n0_")).cast("long"))
    if weight:
        out = out.withColumn("before", (F.col("b_") + F.col("w0_")).cast("long"))
    return out.drop("slice_", "slice_k", "n0_", "w0_", "r_", "b_", *[f"{g}_k" for g in groups])


def hash32(*cols: Column) -> Column:
    """An even hash in [0, 2^32), the same in every run."""

    return F.xxhash64(*cols).bitwiseAND(F.lit(2**32 - 1))


def fold(doc_id: Column, folds: int) -> Column:
    """CRC-32 of the id as text, modulo ``folds``; null for a null id."""

    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, *, folds: int, rows: int) -> DataFrame:
    """(id_, text, y): at most ``rows`` labelled documents outside fold 0, those with the
    smallest id hash, so the choice does not depend on partitioning. Null labels
    and null ids take no part; an id labelled twice takes its larger label, and of
    an id's rows the text with the smallest hash stands for all, so an id that many
    rows share adds one row. The sample is drawn on ids alone; its ids (at most
    ``rows``) are then broadcast."""

    ids = docs.select(F.col("doc_id").cast("long").alias("id_")).filter(fold(F.col("id_"), folds) != 0).distinct()
    marks = (
        labels.select(F.col("doc_id").cast("long").alias("id_"), F.col(label).cast("int").alias("y"))
        .filter("id_ IS NOT NULL AND y IS NOT NULL").groupBy("id_").agg(F.max("y").alias("y"))
    )
    chosen = marks.join(ids, "id_", "left_semi").orderBy(hash32(F.col("id_"), F.lit(11)), "id_").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("id_"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "id_", "inner")
    one = found.groupBy("id_", "y").agg(F.min(F.struct(hash32(F.col("text")).alias("h"), "text")).alias("t"))
    return one.select("id_", "t.text", "y")


def text_groups(texts: pa.Array) -> Iterator[list[str]]:
    """Whole texts of an Arrow column in their order, null as empty: lists of about
    TOGETHER bytes, or of one longer text, so that a worker never holds the strings
    of a whole batch."""

    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // TOGETHER, prepend=-1)).tolist()
    for i, j in zip(starts, [*starts[1:], len(texts)]):
        yield ["" if t is None else t for t in texts.slice(i, j - i).to_pylist()]


class Remembered(dict):
    """A bounded memory of a function's results; it starts anew when full."""

    def __init__(self, function, most: int = 300_000):
        super().__init__()
        self.function, self.most = function, most

    def __missing__(self, key):
        value = self[key] = self.function(key)
        return value

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()
