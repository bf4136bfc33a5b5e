"""Query-log analytics.

All operators read the log table; JSON columns are parsed with ``from_json``
(malformed → NULL → skipped). Latest-per-key uses ``max_by`` aggregation
(partial aggregation, so a hot key costs one buffer per map task), never a
window over all rows of a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens import catalog
from cohortlens.sources.logstore import lookup_digest, minute
from cohortlens.sources.querylog import EXPL_SCHEMA, GRAPH_SCHEMA, NODE_SUMMARY_SCHEMA, RESPONSE_SCHEMA
from cohortlens.sources.tables import parse_json_text


def node_stats(log: DataFrame, known_nodes=tuple(catalog.KNOWN_NODES)) -> DataFrame:
    """Calls, successes, failures, mean ms (2 decimals); known nodes
    pre-seeded with zeros; missing status = success, missing ms = 0."""

    parsed = log.where(F.col("node_outputs_summary").isNotNull()).select(
        F.from_json("node_outputs_summary", NODE_SUMMARY_SCHEMA).alias("m")
    )
    ex = parsed.select(F.explode("m").alias("node_name", "info"))
    status = F.coalesce(F.col("info.status"), F.lit("success"))
    agg = ex.groupBy("node_name").agg(
        F.count(F.lit(1)).alias("call_count"),
        F.count_if(status == "success").alias("success_count"),
        F.count_if(status != "success").alias("failure_count"),
        F.sum(F.coalesce(F.col("info.duration_ms"), F.lit(0))).alias("total_ms"),
    )
    seed = log.sparkSession.createDataFrame([(n,) for n in known_nodes], "node_name string")
    full = agg.join(F.broadcast(seed), "node_name", "full")
    from cohortlens.functions.expr import round_half_up

    return full.select(
        "node_name",
        F.coalesce("call_count", F.lit(0)).cast("long").alias("call_count"),
        F.coalesce("success_count", F.lit(0)).cast("long").alias("success_count"),
        F.coalesce("failure_count", F.lit(0)).cast("long").alias("failure_count"),
        F.when(F.col("call_count") > 0, round_half_up(F.col("total_ms") / F.col("call_count"), 2)).otherwise(F.lit(0.0)).alias("avg_duration_ms"),
    )


def graph_view(log: DataFrame) -> DataFrame:
    """Every query's graph nodes ⟕ its node results by name (a map
    lookup inside the row); absent → skipped, 0 ms."""

    g = log.select("id", F.from_json(F.coalesce("execution_graph_summary", F.lit("[]")), GRAPH_SCHEMA).alias("g"),
                   F.from_json(F.coalesce("node_outputs_summary", F.lit("{}")), NODE_SUMMARY_SCHEMA).alias("m"))
    ex = g.select("id", "m", F.posexplode("g").alias("position", "node"))
    info = F.element_at(F.col("m"), F.col("node.node_name"))
    return ex.select(
        "id", "position", F.col("node.node_name").alias("node_name"),
        F.when(info.isNotNull(), F.coalesce(info["status"], F.lit("success"))).otherwise(F.lit("skipped")).alias("status"),
        F.when(info.isNotNull(), F.coalesce(info["duration_ms"], F.lit(0))).otherwise(F.lit(0)).cast("long").alias("duration_ms"),
        F.coalesce(F.col("node.dependencies"), F.array().cast("array<string>")).alias("dependencies"),
    )


def recent_queries(log: DataFrame, limit: int = 50) -> DataFrame:
    """Most recent ``limit`` rows (created_at desc, id desc) with the six fields."""

    top = log.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
    expl = parse_json_text("explanation_summary", EXPL_SCHEMA)
    resp = parse_json_text("response_json", RESPONSE_SCHEMA)
    return top.select(
        F.col("id").cast("string").alias("id"), "query_text", "chosen_algorithm",
        F.coalesce(resp["cache_hit"], F.lit(False)).alias("cache_hit"),
        expl["explainer_used"].alias("explainer_used"), "created_at",
    )


def latest_per_key(log: DataFrame) -> DataFrame:
    """Latest row per (normalised key, dataset) by (created_at, id)."""

    last = F.max_by(F.struct("id", "created_at", "response_json"), F.struct("created_at", "id"))
    return log.groupBy("query_text_normalized", "dataset_id").agg(last.alias("l"), F.count(F.lit(1)).alias("n_rows")).select(
        "query_text_normalized", "dataset_id", F.col("l.id").alias("latest_id"), F.col("l.created_at").alias("latest_created_at"),
        F.col("l.response_json").alias("response_json"), "n_rows",
    )


def log_reuse(log: DataFrame, key: str = "query_text_normalized") -> DataFrame:
    """L1: every row looks up the log as it stood before the row was stored, by
    exact key (normalised text, dataset; null is a value like any other): the latest
    earlier row by (created_at, id), else a miss.

    Rows of a key are ordered minute by minute. A minute's first row looks at the last
    row of the key's previous minute of that day or, in the day's first minute, of its
    previous day: one small row per key and minute. So a popular text is a group per
    minute, and 1,440 small rows a day. A stored log (``sources/logstore.py``) is bucketed
    by the digest and the minute: its rows are not moved."""

    stored = {"digest", "slice"} <= set(log.columns) and key == "query_text_normalized"
    digest, slice_ = (F.col("digest"), F.col("slice")) if stored else (lookup_digest(key), minute())
    rows = log.select("id", key, "created_at", digest.alias("digest"), slice_.alias("slice"))
    place = F.struct("created_at", "id")
    inside = Window.partitionBy("digest", "slice").orderBy("created_at", "id")
    minutes = rows.groupBy("digest", "slice").agg(F.max(place).alias("last")).withColumn("day", F.substring("slice", 1, 10))
    minutes = minutes.withColumn("in_day", F.lag("last").over(Window.partitionBy("digest", "day").orderBy("slice")))
    days = minutes.groupBy("digest", "day").agg(F.max("last").alias("last"))
    days = days.select("digest", "day", F.lag("last").over(Window.partitionBy("digest").orderBy("day")).alias("before_day"))
    before = minutes.join(days, ["digest", "day"]).select("digest", "slice", F.coalesce("in_day", "before_day").alias("before"))
    found = rows.withColumn("earlier", F.lag(place).over(inside)).join(before, ["digest", "slice"])
    hit = F.coalesce("earlier", "before")
    return found.select(
        F.col("id").alias("request_id"), key, hit.isNotNull().alias("cache_hit"), hit["id"].alias("cached_id"), hit["created_at"].alias("cached_created_at"),
    )


def append_log(rows: DataFrame, path: str, partition_by: str = "created_date") -> str | None:
    """Append log rows to a date-partitioned table (created on first write).

    Fire-and-forget like the reference: a failed write never fails the caller;
    the error is returned as a string (None on success)."""

    try:
        out = rows.withColumn(partition_by, F.substring("created_at", 1, 10))
        out.write.mode("append").partitionBy(partition_by).parquet(path)
        return None
    except Exception as err:  # noqa: BLE001
        return f"{type(err).__name__}: {err}"


def log_explanation(path: str, explanation, query_text: str, dataset_id: str = "customers", record_id: int | None = None) -> str | None:
    """Append the record of an explanation that ran: its explainer and reason
    code, and how many customers and segments its frames explain."""

    customers = explanation.customers
    summary = {
        "explainer_used": explanation.explainer, "explainer_reason": explanation.reason,
        "customer_count": customers.count(), "segment_count": explanation.segments.count(),
    }
    row = log_record(customers.sparkSession, query_text, {"cache_hit": False}, explanation_summary=summary, dataset_id=dataset_id, record_id=record_id)
    return append_log(row, path)


def explanation_counts(log: DataFrame) -> DataFrame:
    """What the log says about its explanations, per explainer and reason."""

    e = log.select(F.from_json("explanation_summary", EXPL_SCHEMA).alias("e")).where(F.col("e").isNotNull())
    return e.groupBy(F.col("e.explainer_used").alias("explainer_used"), F.col("e.explainer_reason").alias("explainer_reason")).agg(
        F.count(F.lit(1)).alias("n_queries"), F.sum("e.customer_count").alias("customer_count"), F.sum("e.segment_count").alias("segment_count"))


def live_node_state(events: DataFrame) -> DataFrame:
    """K2 (batch replay): latest status per (query, node) by (ts, event id)."""

    return events.groupBy("query_id", "node_name").agg(
        F.max_by(F.col("status"), F.struct("ts", "event_id")).alias("status"),
        F.max_by(F.col("duration_ms"), F.struct("ts", "event_id")).alias("duration_ms"),
        F.count(F.lit(1)).alias("n_events"),
    )


def log_record(spark, query_text: str, response: dict, graph: list | None = None, algorithm: str | None = None,
               node_summary: dict | None = None, explanation_summary: dict | None = None, dataset_id: str = "customers",
               record_id: int | None = None) -> DataFrame:
    """L2: one log row (JSON text columns, ISO-8601 UTC time), ready for
    ``append_log``. Failed runs are logged the same way with an error response."""

    import datetime as _dt
    import json

    from cohortlens.operators.text import normalize_log_key

    now = _dt.datetime.now(_dt.timezone.utc).isoformat()
    rid = record_id if record_id is not None else int(_dt.datetime.now(_dt.timezone.utc).timestamp() * 1e6)
    row = [(rid, query_text, dataset_id, json.dumps(graph) if graph else None, algorithm,
            json.dumps(node_summary) if node_summary else None, json.dumps(explanation_summary) if explanation_summary else None,
            json.dumps(response, default=str), now)]
    df = spark.createDataFrame(row, "id long, query_text string, dataset_id string, execution_graph_summary string, chosen_algorithm string, "
                                    "node_outputs_summary string, explanation_summary string, response_json string, created_at string")
    return df.select("id", "query_text", normalize_log_key(F.col("query_text")).alias("query_text_normalized"), "dataset_id",
                     "execution_graph_summary", "chosen_algorithm", "node_outputs_summary", "explanation_summary",
                     "response_json", "created_at")
