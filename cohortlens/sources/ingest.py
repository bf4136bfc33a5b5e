"""Validated ingest (S4) and the seeded synthetic profile generator.

The source is scanned once, as text columns, into a staging table; the same pass counts
what each column holds, which decides its type. A column is numeric if the profile
contract says so or nearly all its values are numbers. A row with the wrong number of
fields, without an id, or without a number in a numeric column is malformed: it goes to
the dataset's quarantine table with its record and reasons, all others go on. The
dataset is visible from the moment that its manifest, one small file, exists; a run
that fails leaves nothing.
"""

from __future__ import annotations

import datetime as _dt
import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens import catalog
from cohortlens.operators.features import build_customer_features
from cohortlens.sources.tables import PROFILE_SCHEMA, probe_path

# FIXED VALUES: texts that stand for a missing value.
MISSING = ["", "NA", "N/A", "NaN", "nan", "null", "NULL", "None"]
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
WHOLE = r"^\s*[+-]?\d{1,18}\s*$"
MANIFEST = "manifest.json"
#: A larger share of malformed rows rejects the file.
TOLERATED = 0.1
CONTRACT = {f.name: f.dataType for f in PROFILE_SCHEMA.fields if f.name != "CUST_ID"}


@dataclass
class IngestResult:
    ok: bool
    status: int               # 200 accepted, 400 rejected input, 422 feature failure
    message: str
    dataset_id: str | None = None
    row_count: int = 0
    column_count: int = 0
    columns: list[str] = field(default_factory=list)
    path: str | None = None
    preview: DataFrame | None = None
    quarantined_count: int = 0
    reasons: dict[str, int] = field(default_factory=dict)
    flagged: bool = False     # accepted, but rows are in quarantine


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def _present(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.trim(F.col(c)).isin(MISSING)


def _types(cols: list[str], seen: dict, tolerated: float) -> dict[str, str]:
    """bigint, double or string for each column, from the counts of the scan."""

    out = {}
    for i, c in enumerate(cols):
        present, wrong, broken = seen[f"p{i}"] or 0, seen[f"w{i}"] or 0, seen[f"b{i}"] or 0
        if c in CONTRACT:
            out[c] = CONTRACT[c].simpleString()
        elif c == "CUST_ID" or not present or wrong > tolerated * present:
            out[c] = "string"
        else:
            out[c] = "bigint" if broken == wrong else "double"
        if out[c] == "bigint" and broken > wrong:  # numbers, but not whole ones
            out[c] = "double"
    return out


def _write_manifest(spark: SparkSession, folder: str, content: dict) -> None:
    fs, p, _ = _fs(spark, f"{folder}/{MANIFEST}")
    out = fs.create(p, False)
    out.write(bytearray(json.dumps(content, indent=1).encode()))
    out.close()


def read_manifest(spark: SparkSession, folder: str) -> dict:
    return json.loads("\n".join(r["value"] for r in spark.read.text(f"{folder}/{MANIFEST}", wholetext=True).collect()))


def ingest(spark: SparkSession, src: str, root: str, filename: str | None = None, tolerated: float = TOLERATED) -> IngestResult:
    """Reject unparsable, empty or non-numeric input and input with more than
    ``tolerated`` malformed rows; else write the raw table, the quarantined rows and
    the feature table under ``root`` and publish them by the manifest."""

    stamp = _dt.datetime.now(_dt.timezone.utc).strftime("%Y%m%d_%H%M%S")
    dataset_id = f"upload_{stamp}_{uuid.uuid4().hex[:6]}"  # suffix: ids do not collide within a second
    cols = probe_path(spark, src)
    if not cols:
        return IngestResult(False, 400, f"could not parse {filename or src}")
    staging, final = (f"{root.rstrip('/')}/{part}{dataset_id}" for part in ("_staging/", ""))
    done = False
    try:
        places = [f"c{i}" for i in range(len(cols))]  # any header text is a valid name there
        fields = T.StructType([T.StructField(c, T.StringType()) for c in [*places, "corrupt"]])
        reader = spark.read.schema(fields).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt")
        scan, whole = Observation(), F.col("corrupt").isNull()
        counts = [F.count(F.lit(1)).alias("rows")]
        for i, c in enumerate(places):
            there = whole & _present(c)
            counts += [F.count_if(there).alias(f"p{i}"), F.count_if(there & ~F.col(c).rlike(NUMBER)).alias(f"w{i}"), F.count_if(there & ~F.col(c).rlike(WHOLE)).alias(f"b{i}")]
        rows = reader.csv(src).withColumn("row_", F.monotonically_increasing_id())
        try:
            rows.observe(scan, *counts).write.parquet(f"{staging}/text")
        except Exception as err:  # noqa: BLE001 - whatever the parser trips over
            return IngestResult(False, 400, f"could not parse {filename or src}: {type(err).__name__}")
        seen = scan.get
        if not seen["rows"]:
            return IngestResult(False, 400, "uploaded dataset is empty")
        types = _types(cols, seen, tolerated)
        numeric = [c for c in cols if types[c] != "string"]
        if not numeric:
            return IngestResult(False, 400, "uploaded dataset has no numeric columns")
        of = dict(zip(cols, places))
        reasons = [F.when(~whole, F.lit("field_count"))]
        if "CUST_ID" in of:
            reasons.append(F.when(whole & ~_present(of["CUST_ID"]), F.lit("missing_id")))
        reasons += [F.when(whole & _present(of[c]) & ~F.col(of[c]).rlike(NUMBER), F.lit(f"not_a_number:{c}")) for c in numeric]
        text = spark.read.schema(rows.schema).parquet(f"{staging}/text").withColumn("reasons", F.array_compact(F.array(*reasons)))
        good, bad = text.filter(F.size("reasons") == 0), text.filter(F.size("reasons") > 0)
        kinds = {r["reason"]: r["n"] for r in bad.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n")).collect()}
        malformed = bad.count() if kinds else 0
        facts = {"row_count": seen["rows"] - malformed, "column_count": len(cols), "columns": cols, "quarantined_count": malformed, "reasons": kinds}
        if malformed > tolerated * seen["rows"]:
            return IngestResult(False, 400, f"{malformed} of {seen['rows']} rows are malformed", **facts)

        def typed(c: str) -> Column:
            value = F.when(_present(of[c]), F.trim(F.col(of[c])))
            # A contract's whole numbers may be written as 12.0.
            return (value if types[c] == "string" else value.cast("double").cast(types[c]) if types[c] == "bigint" and c in CONTRACT else value.cast(types[c])).alias(c)

        good.select(*[typed(c) for c in cols]).write.parquet(f"{final}/raw")
        bad.select(F.coalesce("corrupt", F.to_csv(F.struct(*places))).alias("record"), "reasons").write.parquet(f"{final}/quarantine")
        try:
            build_customer_features(spark.read.parquet(f"{final}/raw")).write.parquet(f"{final}/features")
        except Exception as err:  # noqa: BLE001 - feature failure: nothing is published
            return IngestResult(False, 422, f"feature engineering failed: {type(err).__name__}", dataset_id)
        preview = spark.createDataFrame(good.orderBy("row_").limit(5).select(*[typed(c) for c in cols]).collect(), T.StructType.fromDDL(", ".join(f"`{c}` {types[c]}" for c in cols)))
        _write_manifest(spark, final, {"dataset_id": dataset_id, "rows_read": seen["rows"], **facts, "types": types})
        done = True
        message = f"ingested, {malformed} malformed rows quarantined" if malformed else "ingested"
        return IngestResult(True, 200, message, dataset_id, path=final, preview=preview, flagged=malformed > 0, **facts)
    finally:
        for folder in [staging, *([] if done else [final])]:
            fs, p, _ = _fs(spark, folder)
            fs.delete(p, True)


def synthetic_profile(spark: SparkSession, rows: int = 120, seed: int = catalog.SEED) -> DataFrame:
    """The 18-column profile with per-column uniform values from a hash
    of (row id, column, seed) — independent of partitioning, unlike ``rand``."""

    base = spark.range(rows)
    out = [F.concat(F.lit("C"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("CUST_ID")]
    for col, lo, hi, integer in catalog.SYNTHETIC_RANGES:
        u = F.xxhash64(F.col("id"), F.lit(col), F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1)).cast("double") / F.lit(float(1 << 53))
        if integer:
            out.append((F.lit(lo) + F.floor(u * F.lit(hi - lo + 1))).cast("bigint").alias(col))
        else:
            out.append((F.lit(float(lo)) + u * F.lit(float(hi - lo))).alias(col))
    return base.select(*out)


def resolve_dataset(spark: SparkSession, root: str, dataset_id: str | None) -> str:
    """Dataset id → published folder; unknown or unpublished id → KeyError (a 400 upstream)."""

    if not dataset_id:
        raise KeyError("dataset id required")
    path = f"{root.rstrip('/')}/{dataset_id}"
    fs, p, _ = _fs(spark, f"{path}/{MANIFEST}")
    if not fs.exists(p):
        raise KeyError(f"no dataset is published as '{dataset_id}'")
    return path
