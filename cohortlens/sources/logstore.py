"""The query log as a bucketed table (S8, S9), so that lookups by text move no log rows.

The table is partitioned by day or month and bucketed by (``digest``, ``slice``): the digest
names the row's text and dataset, the slice is the minute it was stored in. A lookup
that groups or joins by these two reads each bucket where it lies; a popular text is
spread over the buckets by its minutes. The number of buckets is fixed when the table
is made, like the length of a partition: an append writes one file for each bucket of each
day or month it touches, and a task reads one bucket of those asked for, so take days
for a log of many GB a day, and one bucket for every few hundred MB read together.

A batch is appended once, whatever is retried: a marker file says that (run, batch) was
begun, another that it is complete. A batch that was begun and not completed is
resumed: only rows whose id the table does not hold under this run and batch are added.

Defined cases: null texts, datasets and times are values of their own (null texts
share a digest); ids must not be null; an empty batch is complete and adds nothing;
columns that the log does not have are left out.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PERIODS = {"day": 10, "month": 7}  # leading characters of the ISO time
COLUMNS = ("id", "query_text", "query_text_normalized", "dataset_id", "execution_graph_summary", "chosen_algorithm",
           "node_outputs_summary", "explanation_summary", "response_json", "created_at")


def lookup_digest(key: str = "query_text_normalized") -> Column:
    """A 16-byte name of (text, dataset); nulls are left out of the JSON, so no value equals null."""

    return F.md5(F.to_json(F.struct(F.col(key).cast("string").alias("t"), F.col("dataset_id").cast("string").alias("d"))).cast("binary"))


def minute() -> Column:
    return F.coalesce(F.substring("created_at", 1, 16), F.lit(""))


class LogStore:
    """A bucketed log table under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = 64, period: str = "day"):
        """Make the table or, where the folder holds one already, open it (with the
        buckets and the period that it was made with)."""

        self.spark, self.name, self.path, self.buckets, self.width = spark, name, path.rstrip("/"), buckets, PERIODS[period]
        layout = f"{buckets}-{period}"
        made = self._made_with()
        if made is None:
            self._touch("layout", layout)  # an empty file; its name is the layout
        elif made != layout:
            raise ValueError(f"the log under {path} was made as {made}, not {layout}")
        fields = ", ".join(f"{c} string" for c in (*COLUMNS, "digest", "slice", "run", "batch", "period"))
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({fields}) USING parquet PARTITIONED BY (period) "
                  f"CLUSTERED BY (digest, slice) SORTED BY (digest, slice, created_at, id) INTO {buckets} BUCKETS LOCATION '{self.path}/rows'")
        fs, p = self._file("..", "rows")
        fs.mkdirs(p)
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")

    def _file(self, *parts: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.path, "marks", *parts]))
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _touch(self, *parts: str) -> None:
        fs, p = self._file(*parts)
        fs.create(p, True).close()

    def _marked(self, *parts: str) -> bool:
        fs, p = self._file(*parts)
        return fs.exists(p)

    def _made_with(self) -> str | None:
        fs, p = self._file("layout")
        return fs.listStatus(p)[0].getPath().getName() if fs.exists(p) else None

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, log: DataFrame, run: str, batch: str) -> bool:
        """Add a batch of log rows; False if it is complete already. One writer a batch."""

        mark = hashlib.sha256(f"{len(run)}:{run}{batch}".encode()).hexdigest()
        if self._marked("complete", mark):
            return False
        rows = log.select(*[F.col(c).cast("string").alias(c) for c in COLUMNS], lookup_digest().alias("digest"), minute().alias("slice"),
                          F.lit(run).alias("run"), F.lit(batch).alias("batch"), F.substring("created_at", 1, self.width).alias("period"))
        if self._marked("begun", mark):
            self.spark.catalog.refreshTable(self.name)
            there = self.rows().where((F.col("run") == run) & (F.col("batch") == batch)).select("id")
            rows = rows.join(there, "id", "left_anti").select(*rows.columns)
        self._touch("begun", mark)
        # the table's own bucketing, so that a task writes one bucket and a bucket of a period is one file a batch
        rows.repartition(self.buckets, "digest", "slice").write.insertInto(self.name)
        self._touch("complete", mark)
        return True
