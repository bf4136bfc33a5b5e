"""Lookup projections and filters.

All are narrow projections/filters; filters on scan columns reach the parquet
reader as pushed predicates. Top-N uses ``orderBy().limit()``, which Spark
plans as ``TakeOrderedAndProject`` (per-partition top-N, then a merge of N
rows per partition) — no full sort, no full shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lookup_projection(df: DataFrame, requested: Sequence[str] | None) -> tuple[list[str], list[str]]:
    """P5: (valid fields, unsupported fields); none valid → all columns."""

    requested = list(requested or [])
    valid = [f for f in requested if f in df.columns]
    unsupported = [f for f in requested if f not in df.columns]
    return (valid or list(df.columns)), unsupported


def lookup(df: DataFrame, requested: Sequence[str] | None = None, top_n: int | None = None, tiebreak: str | None = None) -> DataFrame:
    """P5 + W1: project valid fields; with ``top_n`` sort by the first numeric
    projected field descending (ties by ``tiebreak``) and keep ``top_n`` rows."""

    fields, _ = lookup_projection(df, requested)
    out = df.select(*fields)
    if top_n is None:
        return out
    types = {f.name: f.dataType for f in out.schema.fields}
    numeric = [f for f in fields if isinstance(types[f], T.NumericType)]
    # without a numeric field the first projected one orders the rows, so reruns agree
    order = [F.desc_nulls_last(numeric[0])] if numeric else [F.asc(fields[0])]
    if tiebreak and tiebreak in df.columns:
        if tiebreak not in fields:
            out = df.select(*fields, tiebreak)
        order.append(F.asc(tiebreak))
    return out.orderBy(*order).limit(int(top_n)).select(*fields)


def filter_cluster_or_persona(df: DataFrame, cluster: int | None = None, persona: str | None = None) -> DataFrame:
    """By cluster id when present, else case-insensitive persona name."""

    if cluster is not None and "cluster" in df.columns:
        return df.where(F.col("cluster") == F.lit(int(cluster)))
    return df.where(F.lower(F.col("persona")) == F.lit((persona or "").lower()))
