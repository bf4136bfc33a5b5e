"""Exact, interpolated quantiles (pandas / ``percentile`` / ``quantile_cont`` semantics).

Spark's exact ``percentile`` keeps every distinct value of a group in one task, so
a global median over a 100 TB column would land in one task. Here, at every size:

1. one pass builds a quantile sketch for each (group, column) and from it a bracket
   of two values around each wanted rank (``percentile_approx`` errs by at most
   n / ACCURACY ranks; the brackets reach twice as far);
2. a second pass counts the values below each bracket and, per distinct value, the
   values inside it. Both are partial aggregates, so ties and hot groups shrink on
   the map side; a running count over the few values inside finds the exact ranks.

A rank that falls outside its bracket (a broken sketch) is looked up again with
the bracket of the group's whole range. Null and NaN values are skipped, infinite
ones take part, a null group key is a group, and a group without values has null
quantiles. The result is a DataFrame; nothing per group reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.session import materialize

ACCURACY = 10_000
BROADCAST_ROWS = 100_000


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]):
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def _inside(long: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """(target, value at its rank, whether the bracket held the rank)."""

    # One row per group, column and rank: small enough to broadcast only if counted so.
    small = F.broadcast(targets) if targets.count() <= BROADCAST_ROWS else targets
    hits = long.join(small, _same(long, targets, keys)).select(*[targets[c] for c in targets.columns], "value").where(F.col("value") <= F.col("high"))
    low = F.col("value") < F.col("low")
    counted = hits.groupBy(*targets.columns, F.when(~low, F.col("value")).alias("value")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*targets.columns).orderBy(F.asc_nulls_first("value"))
    upto = counted.withColumn("upto", F.sum("c").over(w))
    at = F.min(F.when(F.col("value").isNotNull() & (F.col("upto") > F.col("rank")), F.struct("upto", "value")))
    below = F.coalesce(F.max(F.when(F.col("value").isNull(), F.col("c"))), F.lit(0))
    return upto.groupBy(*targets.columns).agg(at["value"].alias("at"), (at.isNotNull() & (below <= F.col("rank"))).alias("held"))


def quantile_table(df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """One row per group, ``column_name`` and ``p`` with the exact ``quantile``."""

    by, probs = list(by), sorted({float(p) for p in probs})
    keys = [*[f"g{i}_" for i in range(len(by))], "column_name"]
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias("value")) for c in columns])).alias("kv")
    long = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], stacked).select(*keys[:-1], "kv.column_name", "kv.value")
    # Adding 0.0 makes -0.0 and 0.0 one value.
    long = long.withColumn("value", F.col("value") + F.lit(0.0))
    reach = 2.0 / ACCURACY
    marks = sorted({min(1.0, max(0.0, q)) for p in probs for q in (p - reach, p + reach)})
    stats = long.groupBy(*keys).agg(
        F.count("value").alias("n"), F.min("value").alias("lowest"), F.max("value").alias("highest"),
        F.percentile_approx("value", F.array(*map(F.lit, marks)), ACCURACY).alias("marks"),
    )
    ends = []
    for p in probs:
        low, high = min(1.0, max(0.0, p - reach)), min(1.0, max(0.0, p + reach))
        pos = (F.col("n") - 1) * F.lit(p)
        for side, rank in (("floor", F.floor(pos)), ("ceil", F.ceil(pos))):
            ends.append(F.struct(
                F.lit(p).alias("p"), F.lit(side).alias("side"), rank.cast("long").alias("rank"),
                F.when(F.lit(low) <= 0.0, F.col("lowest")).otherwise(F.element_at("marks", marks.index(low) + 1)).alias("low"),
                F.when(F.lit(high) >= 1.0, F.col("highest")).otherwise(F.element_at("marks", marks.index(high) + 1)).alias("high"),
            ))
    stats = materialize(stats, "quantile-stats")
    targets = stats.where("n > 0").select(*keys, "n", "lowest", "highest", F.explode(F.array(*ends)).alias("t")).select(*keys, "n", "lowest", "highest", "t.*")
    # The ends of a bracket never leave out the extreme ranks, where the sketch may round inwards.
    targets = targets.withColumns({"low": F.when(F.col("rank") <= 1, F.col("lowest")).otherwise(F.col("low")), "high": F.when(F.col("rank") >= F.col("n") - 2, F.col("highest")).otherwise(F.col("high"))})
    found = materialize(_inside(long, targets, keys), "quantile-ranks")
    missed = found.where(~F.col("held"))
    if missed.head(1):
        again = _inside(long, missed.select(*targets.columns).withColumns({"low": F.col("lowest"), "high": F.col("highest")}), keys)
        found = found.where("held").unionByName(again)
    ends = found.groupBy(*keys, "p", "n").agg(F.max(F.when(F.col("side") == "floor", F.col("at"))).alias("x"), F.max(F.when(F.col("side") == "ceil", F.col("at"))).alias("y"))
    pos = (F.col("n") - 1) * F.col("p")
    value = F.when(F.col("x") == F.col("y"), F.col("x")).otherwise((F.ceil(pos) - pos) * F.col("x") + (pos - F.floor(pos)) * F.col("y"))
    exact = ends.select(*keys, "p", value.alias("quantile"))
    empty = stats.where("n = 0").select(*keys, F.explode(F.array(*map(F.lit, probs))).alias("p"), F.lit(None).cast("double").alias("quantile"))
    out = exact.unionByName(empty)
    return out.select(*[F.col(k).alias(b) for b, k in zip(by, keys)], "column_name", "p", "quantile")


def quantiles_wide(df: DataFrame, wanted: dict[str, tuple[str, float]], by: Sequence[str] = ()) -> DataFrame:
    """One row per group with a column for each ``alias: (column, p)``."""

    table = quantile_table(df, sorted({c for c, _ in wanted.values()}), [p for _, p in wanted.values()], by)
    return table.groupBy(*by).agg(*[F.max(F.when((F.col("column_name") == c) & (F.col("p") == float(p)), F.col("quantile"))).alias(a) for a, (c, p) in wanted.items()])


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[tuple[str, float], float | None]:
    """The quantiles of whole columns as parameters: one number per column and probability."""

    out: dict[tuple[str, float], float | None] = {(c, float(p)): None for c in columns for p in probs}
    if columns:
        for r in quantile_table(df, columns, probs).collect():
            v = r["quantile"]
            out[r["column_name"], r["p"]] = v if v is None or not math.isnan(v) else None
    return out


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Medians of whole columns (nulls and NaN skipped)."""

    return {c: v for (c, _), v in exact_quantiles(df, columns, [0.5]).items()}
