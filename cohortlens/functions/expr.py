"""Column expressions (all JVM-side built-ins, ANSI-safe).

Spark 4 runs with ANSI on: a bare ``/`` by zero raises. Every ratio here
goes through ``try_divide``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite_or_null(x: Column) -> Column:
    """±inf and NaN → NULL."""

    return F.when(F.isnan(x) | (F.abs(x) == F.lit(INF)), F.lit(None).cast("double")).otherwise(x)


def safe_divide(num: str | Column, den: str | Column, default: float = 0.0) -> Column:
    """num / den; zero, null or non-finite results → ``default``."""

    n = col(num).cast("double")
    d = col(den).cast("double")
    q = F.try_divide(n, F.nullif(d, F.lit(0.0)))
    return F.coalesce(finite_or_null(q), F.lit(float(default)))


def eps_ratio(num: str | Column, den: str | Column, eps: float = 1e-5) -> Column:
    """num / (den + eps)."""

    return F.try_divide(col(num).cast("double"), col(den).cast("double") + F.lit(eps))


def clip_upper(x: str | Column, upper: float = 1.0) -> Column:
    """Upper clip that keeps NULL as NULL (P10)."""

    c = col(x)
    return F.when(c > F.lit(upper), F.lit(upper)).otherwise(c)


def coerce_number(x: str | Column) -> Column:
    """Coerce to double; unparsable, NULL or NaN → 0.0."""

    v = col(x).cast("string").try_cast("double")
    return F.coalesce(F.nanvl(v, F.lit(None).cast("double")), F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    """Euclidean distance between two equal-length ``array<double>`` (X11)."""

    sq = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda acc, v: acc + v))


def feature_label(name: Column, labels: dict[str, str]) -> Column:
    """Readable feature label with ``_``→space fallback."""

    pairs = []
    for k, v in labels.items():
        pairs += [F.lit(k), F.lit(v)]
    m = F.create_map(*pairs)
    return F.coalesce(F.element_at(m, name), F.regexp_replace(name, "_", " "))


def round_half_up(x: Column, digits: int = 4) -> Column:
    """``floor(x·10^d + 0.5) / 10^d`` in IEEE doubles.

    Spark's ``round`` rounds the shortest decimal string of a double, DuckDB
    rounds the binary value, so ties differ. This formula is evaluated the same
    way on both sides (see ``r4``), so outputs are bit-identical.
    """

    x = x.cast("double")
    scale = float(10**digits)
    bad = F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(bad, x).otherwise(F.floor(x * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale))
