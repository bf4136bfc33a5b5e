"""Derive the 18-column customer profile from customer / orders / lineitem.

Plan shape (what we want at scale):

* ``lineitem`` is pre-aggregated per ``l_orderkey`` (partial + final hash
  aggregate; only 3 columns are read from parquet);
* orders ⟕ that per-order aggregate on ``o_orderkey`` (sort-merge join; the
  aggregate side is already hash-partitioned on the key, so only ``orders``
  shuffles);
* one aggregation per ``o_custkey`` computes every order- and line-level
  measure in a single pass, map-side combined, so a hot customer collapses to
  one row per map task before the shuffle;
* ``customer`` joins the per-customer aggregate (1:1 on the key); a customer
  without orders stays, with zeros.

Money is summed as ``decimal(18,2)`` and cast to double only at the end, which
makes the sums exact and order independent (identical in DuckDB).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.sources.tables import table

MONEY = "decimal(18,2)"


def _share(cnt, n):
    """A share of a customer's orders; 0 for a customer without any."""

    return F.coalesce(F.try_divide(cnt.cast("double"), n.cast("double")), F.lit(0.0))


def customer_profile(customer: DataFrame, orders: DataFrame, lineitem: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The F1 profile; ``keep`` carries extra ``customer`` columns through."""

    x = F.col("l_extendedprice").cast(MONEY)
    per_order = lineitem.groupBy("l_orderkey").agg(
        F.sum(F.when(F.col("l_linestatus") == "F", x).otherwise(F.lit(0).cast(MONEY))).alias("paid"),
        F.sum(F.when(F.col("l_returnflag") == "N", x).otherwise(F.lit(0).cast(MONEY))).alias("minpay"),
    )
    o = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.col("o_totalprice").cast(MONEY).alias("p"))
    joined = o.join(per_order, o.o_orderkey == per_order.l_orderkey, "left")
    prio = F.col("o_orderpriority")
    zero = F.lit(0).cast(MONEY)
    is_cash = prio == "1-URGENT"
    is_purchase = prio != "1-URGENT"
    is_oneoff = prio.isin("2-HIGH", "3-MEDIUM")
    is_inst = prio.isin("4-NOT SPECIFIED", "5-LOW")
    agg = joined.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("o_orderstatus") != "P").alias("n_not_p"),
        F.count_if(F.col("o_orderstatus") == "F").alias("n_f"),
        F.sum(F.when(is_purchase, F.col("p")).otherwise(zero)).alias("purchases"),
        F.sum(F.when(is_oneoff, F.col("p")).otherwise(zero)).alias("oneoff"),
        F.sum(F.when(is_inst, F.col("p")).otherwise(zero)).alias("inst"),
        F.sum(F.when(is_cash, F.col("p")).otherwise(zero)).alias("cash"),
        F.count_if(is_purchase).alias("n_purchase"),
        F.count_if(is_oneoff).alias("n_oneoff"),
        F.count_if(is_inst).alias("n_inst"),
        F.count_if(is_cash).alias("n_cash"),
        F.sum(F.coalesce(F.col("paid"), zero)).alias("paid"),
        F.sum(F.coalesce(F.col("minpay"), zero)).alias("minpay"),
    )
    c = customer.select("c_custkey", "c_nationkey", "c_acctbal", *keep)
    j = c.join(agg, c.c_custkey == agg.o_custkey, "left")
    none = F.lit(0)
    n = F.col("n")
    key = F.col("c_custkey")
    return j.select(
        F.concat(F.lit("C"), (F.lit(10000) + key).cast("string")).alias("CUST_ID"),
        F.col("c_acctbal").cast("double").alias("BALANCE"),
        _share(F.col("n_not_p"), n).alias("BALANCE_FREQUENCY"),
        F.coalesce(F.col("purchases"), none).cast("double").alias("PURCHASES"),
        F.coalesce(F.col("oneoff"), none).cast("double").alias("ONEOFF_PURCHASES"),
        F.coalesce(F.col("inst"), none).cast("double").alias("INSTALLMENTS_PURCHASES"),
        F.coalesce(F.col("cash"), none).cast("double").alias("CASH_ADVANCE"),
        _share(F.col("n_purchase"), n).alias("PURCHASES_FREQUENCY"),
        _share(F.col("n_oneoff"), n).alias("ONEOFF_PURCHASES_FREQUENCY"),
        _share(F.col("n_inst"), n).alias("PURCHASES_INSTALLMENTS_FREQUENCY"),
        _share(F.col("n_cash"), n).alias("CASH_ADVANCE_FREQUENCY"),
        F.coalesce("n_cash", none).cast("bigint").alias("CASH_ADVANCE_TRX"),
        F.coalesce("n_purchase", none).cast("bigint").alias("PURCHASES_TRX"),
        F.when(key % 97 == 0, F.lit(None).cast("double"))
        .otherwise((F.lit(2000) + F.lit(500) * F.col("c_nationkey")).cast("double"))
        .alias("CREDIT_LIMIT"),
        F.coalesce(F.col("paid"), none).cast("double").alias("PAYMENTS"),
        F.when(key % 29 == 0, F.lit(None).cast("double"))
        .otherwise(F.coalesce(F.col("minpay"), none).cast("double") / F.lit(20.0))
        .alias("MINIMUM_PAYMENTS"),
        _share(F.col("n_f"), n).alias("PRC_FULL_PAYMENT"),
        (F.lit(6) + key % 7).cast("bigint").alias("TENURE"),
        *[F.col(k) for k in keep],
    )


def load_profile(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return customer_profile(
        table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), keep
    )


# The same derivation as SQL, used by the DuckDB oracle and by tests.
PROFILE_SQL = """
per_order AS (
  SELECT l_orderkey,
         sum(CASE WHEN l_linestatus = 'F' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS paid,
         sum(CASE WHEN l_returnflag = 'N' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS minpay
  FROM lineitem GROUP BY l_orderkey
),
per_cust AS (
  SELECT o_custkey, count(*) AS n,
         count(*) FILTER (WHERE o_orderstatus <> 'P') AS n_not_p,
         count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f,
         sum(CASE WHEN o_orderpriority <> '1-URGENT' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS purchases,
         sum(CASE WHEN o_orderpriority IN ('2-HIGH','3-MEDIUM') THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS oneoff,
         sum(CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED','5-LOW') THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS inst,
         sum(CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS cash,
         count(*) FILTER (WHERE o_orderpriority <> '1-URGENT') AS n_purchase,
         count(*) FILTER (WHERE o_orderpriority IN ('2-HIGH','3-MEDIUM')) AS n_oneoff,
         count(*) FILTER (WHERE o_orderpriority IN ('4-NOT SPECIFIED','5-LOW')) AS n_inst,
         count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_cash,
         sum(coalesce(po.paid, 0)) AS paid,
         sum(coalesce(po.minpay, 0)) AS minpay
  FROM orders o LEFT JOIN per_order po ON o.o_orderkey = po.l_orderkey
  GROUP BY o_custkey
),
profile AS (
  SELECT 'C' || CAST(10000 + c_custkey AS VARCHAR) AS CUST_ID,
         CAST(c_acctbal AS DOUBLE) AS BALANCE,
         coalesce(n_not_p::DOUBLE / n, 0.0) AS BALANCE_FREQUENCY,
         CAST(coalesce(purchases, 0) AS DOUBLE) AS PURCHASES,
         CAST(coalesce(oneoff, 0) AS DOUBLE) AS ONEOFF_PURCHASES,
         CAST(coalesce(inst, 0) AS DOUBLE) AS INSTALLMENTS_PURCHASES,
         CAST(coalesce(cash, 0) AS DOUBLE) AS CASH_ADVANCE,
         coalesce(n_purchase::DOUBLE / n, 0.0) AS PURCHASES_FREQUENCY,
         coalesce(n_oneoff::DOUBLE / n, 0.0) AS ONEOFF_PURCHASES_FREQUENCY,
         coalesce(n_inst::DOUBLE / n, 0.0) AS PURCHASES_INSTALLMENTS_FREQUENCY,
         coalesce(n_cash::DOUBLE / n, 0.0) AS CASH_ADVANCE_FREQUENCY,
         CAST(coalesce(n_cash, 0) AS BIGINT) AS CASH_ADVANCE_TRX,
         CAST(coalesce(n_purchase, 0) AS BIGINT) AS PURCHASES_TRX,
         CASE WHEN c_custkey % 97 = 0 THEN NULL ELSE CAST(2000 + 500 * c_nationkey AS DOUBLE) END AS CREDIT_LIMIT,
         CAST(coalesce(paid, 0) AS DOUBLE) AS PAYMENTS,
         CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE CAST(coalesce(minpay, 0) AS DOUBLE) / 20.0 END AS MINIMUM_PAYMENTS,
         coalesce(n_f::DOUBLE / n, 0.0) AS PRC_FULL_PAYMENT,
         CAST(6 + c_custkey % 7 AS BIGINT) AS TENURE
  FROM customer LEFT JOIN per_cust ON c_custkey = o_custkey
)
"""
