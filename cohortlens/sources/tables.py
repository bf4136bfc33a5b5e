"""Table readers and writers.

Parquet is the default format: column pruning and predicate pushdown reach the
scan. CSV reads take an explicit schema on the production path; ``infer=True``
is kept for ad-hoc uploads only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens import catalog

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

PROFILE_SCHEMA = T.StructType(
    [T.StructField("CUST_ID", T.StringType())]
    + [
        T.StructField(c, T.LongType() if c in ("CASH_ADVANCE_TRX", "PURCHASES_TRX", "TENURE") else T.DoubleType())
        for c in catalog.REQUIRED_COLUMNS[1:]
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table (``{sf_dir}/{name}.parquet``)."""

    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | None = None, infer: bool = False) -> DataFrame:
    """Header CSV; explicit schema unless ``infer``. Float NaN → NULL."""

    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if schema is not None:
        df = reader.schema(schema).csv(path)
    else:
        df = reader.option("inferSchema", bool(infer)).csv(path)
    return nan_to_null(df)


def nan_to_null(df: DataFrame) -> DataFrame:
    """pandas treats NaN as missing; Spark keeps NaN apart from NULL."""

    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def schema_probe(df: DataFrame) -> list[str]:
    """Column names without running a job."""

    return list(df.schema.names)


def probe_path(spark: SparkSession, path: str) -> list[str]:
    """The column names of a delimited file with a header, read from its head
    alone; a path that cannot be read has no columns."""

    try:
        return list(spark.read.option("header", True).csv(path).columns)
    except Exception:  # noqa: BLE001 - missing, unreadable or not a file: no columns
        return []


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: Sequence[str] = ()) -> str:
    """S3: persist a table (overwrite by default)."""

    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)
    return path


def preview(df: DataFrame, n: int = 5, key: str | Column = "CUST_ID") -> DataFrame:
    """First ``n`` rows under an explicit order (Spark has no file order)."""

    return df.orderBy(key).limit(n)


def parse_json_text(c: str | Column, schema: T.DataType | str, default: str = "{}") -> Column:
    """``from_json`` with a default for NULL text."""

    x = F.col(c) if isinstance(c, str) else c
    return F.from_json(F.coalesce(x, F.lit(default)), schema)
