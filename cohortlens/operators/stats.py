"""Profiling aggregates.

Every statistic is a global or per-column aggregation with map-side partial
aggregation; results are bounded by the number of columns (or column pairs),
never by the number of rows. Quantiles go through ``exact_quantiles`` (no
single-task value buffers beyond a checked size).
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens import catalog
from cohortlens.functions.quantile import quantile_table, quantiles_wide
from cohortlens.operators.features import non_numeric_columns, numeric_columns


def _is_float(df: DataFrame, c: str) -> bool:
    return isinstance(dict((f.name, f.dataType) for f in df.schema.fields)[c], (T.DoubleType, T.FloatType))


def _missing(df: DataFrame, c: str) -> Column:
    x = F.col(c)
    return (x.isNull() | F.isnan(x)) if _is_float(df, c) else x.isNull()


def shape(df: DataFrame) -> DataFrame:
    """A1: row and column count."""

    return df.agg(F.count(F.lit(1)).alias("row_count")).select("row_count", F.lit(len(df.columns)).alias("column_count"))


def missing_profile(df: DataFrame) -> DataFrame:
    """A2 + A3: per column missing count and percent (4 decimals upstream)."""

    cols = df.columns
    row = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(_missing(df, c)).alias(f"m{i}") for i, c in enumerate(cols)])
    entries = [
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"), F.col(f"m{i}").alias("missing_count"))
        for i, c in enumerate(cols)
    ]
    long = row.select("__n", F.inline(F.array(*entries)))
    pct = F.when(F.col("__n") > 0, F.col("missing_count") * F.lit(100.0) / F.col("__n")).otherwise(F.lit(0.0))
    return long.select("position", "column_name", "missing_count", pct.alias("missing_percent"))


def top_missing(df: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` columns with the most missing values (ties: column order)."""

    return missing_profile(df).orderBy(F.desc("missing_count"), F.asc("position")).limit(n)


def numeric_describe(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A4: count, mean, std (n-1), min, 25/50/75 %, max per numeric column."""

    cols = list(cols) if cols is not None else numeric_columns(df)
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        x = F.nanvl(x, F.lit(None).cast("double"))
        aggs += [
            F.count(x).alias(f"n{i}"),
            F.avg(x).alias(f"a{i}"),
            F.stddev_samp(x).alias(f"s{i}"),
            F.min(x).alias(f"lo{i}"),
            F.max(x).alias(f"hi{i}"),
        ]
    entries = [
        F.struct(F.lit(c).alias("column_name"), *[F.col(f"{a}{i}").alias(n) for a, n in (("n", "count"), ("a", "mean"), ("s", "std"), ("lo", "min"), ("hi", "max"))])
        for i, c in enumerate(cols)
    ]
    moments = df.agg(*aggs).select(F.inline(F.array(*entries)))
    quarters = quantile_table(df, cols, [0.25, 0.5, 0.75]).groupBy("column_name").agg(
        *[F.max(F.when(F.col("p") == p, F.col("quantile"))).alias(n) for n, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))])
    return moments.join(quarters, "column_name", "left").select("column_name", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_name, value, cnt) over the given columns, NULL counted as a value."""

    stacked = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in cols])
    )
    return df.select(stacked.alias("kv")).select("kv.column_name", "kv.value").groupBy("column_name", "value").agg(
        F.count(F.lit(1)).alias("cnt")
    )


def categorical_summary(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A5: distinct values incl. NULL, most frequent value, its frequency.

    Ties on frequency → smallest value, NULL last. Two aggregations, both
    map-side combined; the per-column step keeps one buffer per column.
    """

    cols = list(cols) if cols is not None else non_numeric_columns(df)
    vc = value_counts(df, cols)
    best = F.min(F.struct((-F.col("cnt")).alias("neg"), F.col("value").isNull().alias("isnull"), F.col("value").alias("value")))
    return vc.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_unique"), best.alias("b")).select(
        "column_name", "n_unique", F.col("b.value").alias("top"), (-F.col("b.neg")).alias("frequency")
    )


def uniqueness(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """Distinct values (NULL counted) ÷ rows, per column.

    ``approx=True`` uses one HyperLogLog++ pass (``approx_count_distinct``),
    enough for the 0.9 identifier threshold on very wide/large tables."""

    cols = list(cols) if cols is not None else df.columns
    if approx:
        row = df.agg(F.count(F.lit(1)).alias("__n"), *[
            (F.approx_count_distinct(F.col(c), rsd) + F.max(F.col(c).isNull().cast("int"))).alias(f"d{i}") for i, c in enumerate(cols)
        ])
        entries = [F.struct(F.lit(c).alias("column_name"), F.col(f"d{i}").cast("long").alias("n_distinct")) for i, c in enumerate(cols)]
        return row.select("__n", F.inline(F.array(*entries))).select(
            "column_name", "n_distinct", (F.col("n_distinct") / F.greatest(F.col("__n"), F.lit(1))).alias("uniqueness_ratio"))
    vc = value_counts(df, cols)
    n = df.agg(F.count(F.lit(1)).alias("n_rows"))
    per = vc.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"))
    return per.crossJoin(F.broadcast(n)).select(
        "column_name",
        "n_distinct",
        (F.col("n_distinct") / F.greatest(F.col("n_rows"), F.lit(1))).alias("uniqueness_ratio"),
    )


def _normalized_name(c: str) -> str:
    return "".join(ch for ch in c.lower() if ch.isalnum())


def identifier_candidates(df: DataFrame) -> DataFrame:
    """D1 per column: normalised name (X3), uniqueness and the two name rules.

    Uniqueness is computed only for columns whose name ends in ``id`` (the
    only rule that needs it).
    """

    names = df.columns
    need = [c for c in names if _normalized_name(c).endswith("id")]
    uq = {r["column_name"]: (r["n_distinct"], r["uniqueness_ratio"]) for r in uniqueness(df, need).collect()} if need else {}
    rows = []
    for pos, c in enumerate(names):
        nn = _normalized_name(c)
        nd, ratio = uq.get(c, (None, None))
        cust = "custid" in nn or ("customer" in nn and "id" in nn) or (nn.endswith("id") and ratio is not None and ratio > 0.9)
        txn = "transactionid" in nn or ("trans" in nn and "id" in nn) or ("txn" in nn and "id" in nn)
        rows.append((pos, c, nn, nd, ratio, bool(cust), bool(txn)))
    return df.sparkSession.createDataFrame(
        rows,
        "position int, column_name string, normalized_name string, n_distinct long, uniqueness_ratio double, "
        "customer_rule boolean, transaction_rule boolean",
    )


def identify_identifiers(df: DataFrame) -> tuple[str | None, str | None]:
    """First customer-id column, then first transaction-id column among the rest."""

    cust = txn = None
    for r in identifier_candidates(df).orderBy("position").collect():
        if cust is None and r["customer_rule"]:
            cust = r["column_name"]
            continue
        if txn is None and r["transaction_rule"]:
            txn = r["column_name"]
    return cust, txn


def _pair_moments(cols: list[str], shift: list[float]):
    """Per Arrow batch: pairwise-complete sums on mean-shifted values (numpy)."""

    import numpy as np
    import pandas as pd

    p = len(cols)
    mu = np.asarray(shift, dtype="float64")
    ii, jj = np.meshgrid(np.arange(p), np.arange(p), indexing="ij")

    def run(batches):
        for pdf in batches:
            x = pdf[cols].to_numpy(dtype="float64", na_value=np.nan)
            m = ~np.isnan(x)
            x0 = np.where(m, x - mu, 0.0)
            mf = m.astype("float64")
            n = mf.T @ mf
            sx = x0.T @ mf          # sx[i, j] = sum of x_i over rows where i and j are present
            sxx = (x0 * x0).T @ mf
            sxy = x0.T @ x0
            yield pd.DataFrame({
                "i": ii.ravel().astype("int32"), "j": jj.ravel().astype("int32"),
                "n": n.ravel(), "sx": sx.ravel(), "sy": sx.T.ravel(),
                "sxx": sxx.ravel(), "syy": sxx.T.ravel(), "sxy": sxy.ravel(),
            })

    return run


def correlation_long(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Pairwise-complete Pearson correlation, undefined → 0, long form.

    Two passes, both bounded in plan size and output: (1) global column means;
    (2) per Arrow batch, numpy computes pairwise-complete sums of the
    mean-shifted values for all p² pairs, and ``groupBy(i, j).sum`` combines
    them (map-side partial aggregation, p² groups). Shifting by the mean keeps
    the one-pass moment formulas numerically stable. ``corr()`` is avoided: it
    raises under ANSI for constant columns.
    """

    cols = list(cols) if cols is not None else numeric_columns(df)
    xs = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in cols]
    base = df.select(*xs)
    means = base.agg(*[F.avg(c).alias(c) for c in cols]).first()
    shift = [float(means[c]) if means[c] is not None else 0.0 for c in cols]
    schema = "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double"
    sums = base.mapInPandas(_pair_moments(cols, shift), schema).groupBy("i", "j").agg(
        *[F.sum(c).alias(c) for c in ["n", "sx", "sy", "sxx", "syy", "sxy"]]
    )
    n = F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / n
    vy = F.col("syy") - F.col("sy") * F.col("sy") / n
    den = F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0)))
    r = F.when((n < 2) | (den <= 0), F.lit(0.0)).otherwise(F.try_divide(cov, den))
    names = F.array(*[F.lit(c) for c in cols])
    return sums.select(
        F.element_at(names, F.col("i") + 1).alias("col_x"),
        F.element_at(names, F.col("j") + 1).alias("col_y"),
        F.coalesce(r, F.lit(0.0)).alias("corr"),
    )


def feature_summary(features: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean, std (n-1), min, max per feature; feature count."""

    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"a{i}"), F.stddev_samp(x).alias(f"s{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    wide = features.agg(*aggs)
    entries = [
        F.struct(
            F.lit(c).alias("feature"), F.col(f"a{i}").alias("mean"), F.col(f"s{i}").alias("std"),
            F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"),
        )
        for i, c in enumerate(cols)
    ]
    return wide.select(F.inline(F.array(*entries))).withColumn("feature_count", F.lit(len(cols)))


def matrix_profile(matrix: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Min, max, sample variance per feature + row and feature count."""

    aggs = [F.count(F.lit(1)).alias("row_count")]
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.var_samp(x).alias(f"v{i}")]
    wide = matrix.agg(*aggs)
    entries = [
        F.struct(F.lit(c).alias("feature"), F.col(f"lo{i}").alias("minimum"), F.col(f"hi{i}").alias("maximum"), F.col(f"v{i}").alias("variance"))
        for i, c in enumerate(cols)
    ]
    return wide.select("row_count", F.lit(len(cols)).alias("feature_count"), F.inline(F.array(*entries)))


def tier_thresholds(features: DataFrame, high: float = catalog.TIER_HIGH_QUANTILE, low: float = catalog.TIER_LOW_QUANTILE) -> DataFrame:
    """One row with the dataset-wide upper and lower thresholds of spend and
    frequency and the median headroom, from one quantile job."""

    return quantiles_wide(features, {
        "spend_q67": ("monthly_spend", high),
        "spend_q33": ("monthly_spend", low),
        "frequency_q67": ("transaction_frequency_per_month", high),
        "frequency_q33": ("transaction_frequency_per_month", low),
        "credit_headroom_median": ("credit_headroom", 0.5),
    })


def dataset_report(df: DataFrame) -> DataFrame:
    """One tidy table ``(section, column_name, metric, value, text)``
    composed from A1-A5 and D1."""

    spark = df.sparkSession
    sh = shape(df)
    kv = F.inline(F.array(
        F.struct(F.lit("row_count").alias("metric"), F.col("row_count").cast("double").alias("value")),
        F.struct(F.lit("column_count").alias("metric"), F.col("column_count").cast("double").alias("value")),
    ))
    parts = [sh.select(F.lit("shape").alias("section"), F.lit(None).cast("string").alias("column_name"), kv, F.lit(None).cast("string").alias("text"))]
    mp = missing_profile(df)
    kv = F.inline(F.array(
        F.struct(F.lit("missing_count").alias("metric"), F.col("missing_count").cast("double").alias("value")),
        F.struct(F.lit("missing_percent").alias("metric"), F.col("missing_percent").cast("double").alias("value")),
    ))
    parts.append(mp.select(F.lit("missing"), "column_name", kv, F.lit(None).cast("string")))
    if numeric_columns(df):
        nd = numeric_describe(df)
        metrics = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]
        kv = F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
        parts.append(
            nd.select("column_name", kv).where(F.col("value").isNotNull())
            .select(F.lit("numeric"), "column_name", "metric", "value", F.lit(None).cast("string"))
        )
    if non_numeric_columns(df):
        cs = categorical_summary(df)
        kv = F.inline(F.array(
            F.struct(F.lit("unique").alias("metric"), F.col("n_unique").cast("double").alias("value"), F.lit(None).cast("string").alias("text")),
            F.struct(F.lit("top").alias("metric"), F.lit(None).cast("double").alias("value"), F.col("top").alias("text")),
            F.struct(F.lit("frequency").alias("metric"), F.col("frequency").cast("double").alias("value"),
                     F.lit(None).cast("string").alias("text")),
        ))
        parts.append(cs.select(F.lit("categorical"), "column_name", kv))
    cust, txn = identify_identifiers(df)
    note = (
        "A transaction-style identifier was detected alongside the customer data."
        if txn is not None
        else "Dataset is customer-level, so no transaction identifier was detected."
    )
    parts.append(spark.createDataFrame(
        [("identifiers", None, "customer_identifier", None, cust), ("identifiers", None, "transaction_identifier", None, txn),
         ("notes", None, "note", None, note)],
        "section string, column_name string, metric string, value double, text string",
    ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p.toDF(*out.columns))
    return out
