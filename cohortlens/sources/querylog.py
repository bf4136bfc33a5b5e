"""Requests, the query log and the execution-event stream, derived from the
driver tables (F6, F7 at volume).

* requests: every user turn of ``conversations`` (whole texts), one request for
  every ``customer`` row and one for every ``events`` row. Their sentences are
  built from the row's own values: the customer id from ``c_custkey``, a cluster
  count from the key, the market segment, the phrase from the key or event type;
* node outcomes: ``events`` rows, one node execution each — the event type names
  the node (view → eda, click → analytics, signup → feature_engineering,
  purchase → segmentation, error → recommendation, status failed), ``value`` is
  the duration in ms;
* query log (S8 schema): one row per request. An event's request carries that
  execution as its node summary (L2). A purchase ran segmentation and has an
  explanation record, which a fixed rule derives from the run's duration (no
  explainer ran; ``log_explanation`` records real ones); ``cache_hit`` marks a
  normalised text seen before.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.sources.tables import table

# FIXED VALUES: event type → node of the execution graph.
EVENT_NODE = {
    "view": "eda",
    "click": "analytics",
    "signup": "feature_engineering",
    "purchase": "segmentation",
    "error": "recommendation",
}
# FIXED VALUES: request sentences; {id}, {k} and {seg} are filled from the row.
CUSTOMER_TEXTS = [
    "Why was customer {id} placed in this segment?",
    "Segment customers into {k} clusters!",
    "Show descriptive  statistics for the dataset",
    "Find customers suitable for investment products in {seg}",
    "Who are the best customers?",
    "female customers aged {k}",
    "customers in Chennai city",
    "list high value customers",
    "hello there",
    "Target dormant customers with a win back campaign",
    "plot the balance transfer debt by tenure months as a chart",
    "Recommend a loan offer for {seg} customers",
    "How do you interpret this cluster membership, {id}?",
    "Which people rely on cash advances and overdraft",
    "profile the dataset with EDA: {seg}",
    "users in segment {k} paid often",
]
EVENT_TEXTS = {
    "view": "Summarize the dataset overview",
    "click": "explore missing values in the dataset for user {k}",
    "signup": "convert inactive customers with win back offers",
    "purchase": "segment customers into {k} clusters",
    "error": "explain why this customer was flagged, {id}",
}
DATASET_ID = "customers"
EPOCH = "2024-01-01 00:00:00"
ISO = "yyyy-MM-dd'T'HH:mm:ss'+00:00'"

GRAPH_SCHEMA = "array<struct<node_name:string,purpose:string,dependencies:array<string>>>"
NODE_SUMMARY_SCHEMA = "map<string,struct<type:string,duration_ms:bigint,status:string>>"
EXPL_SCHEMA = "struct<explainer_used:string,explainer_reason:string,customer_count:bigint,segment_count:bigint>"
RESPONSE_SCHEMA = "struct<cache_hit:boolean,workflow:string>"


def _node_map() -> F.Column:
    return F.create_map(*[x for k, v in EVENT_NODE.items() for x in (F.lit(k), F.lit(v))])


def _parts(template: str) -> list[str]:
    return [x for x in re.split(r"(\{\w+\})", template) if x]


def _sentence(template: str, values: dict[str, F.Column]) -> F.Column:
    return F.concat(*[values[x[1:-1]] if x.startswith("{") else F.lit(x) for x in _parts(template)])


def sentence_sql(template: str, values: dict[str, str]) -> str:
    """The same sentence as a SQL expression."""

    return " || ".join(values[x[1:-1]] if x.startswith("{") else "'" + x.replace("'", "''") + "'" for x in _parts(template))


def _one_of(key: F.Column, cases: list[tuple[object, F.Column]]) -> F.Column:
    out = F
    for value, column in cases:
        out = out.when(key == F.lit(value), column)
    return out


def requests(conversations: DataFrame, customer: DataFrame, events: DataFrame) -> DataFrame:
    """All requests: ``request_id``, ``query_text``, ``created_at`` and, for an
    event's request, the node it ran (``node_name``, ``status``, ``duration_ms``)
    and the asked number of clusters ``k``. Ids are unique: a letter for the
    table, then the row's key."""

    none = [F.lit(None).cast("string").alias("node_name"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("bigint").alias("duration_ms"), F.lit(None).cast("bigint").alias("k")]
    start = F.lit(EPOCH).cast("timestamp_ntz")
    turn = F.make_dt_interval(F.lit(0), F.col("conv_id").cast("int"), F.col("turn").cast("int"), F.lit(0))
    turns = conversations.where(F.col("role") == "user").select(
        F.concat(F.lit("t"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string")).alias("request_id"),
        F.col("text").alias("query_text"), F.date_format(start + turn, ISO).alias("created_at"), *none,
    )
    key = F.col("c_custkey")
    own = {"id": F.concat(F.lit("C"), (key + 10000).cast("string")), "k": (key % 7 + 2).cast("string"), "seg": F.lower("c_mktsegment")}
    minute = F.make_dt_interval(F.lit(0), F.lit(0), key.cast("int"), F.lit(0))
    people = customer.select(
        F.concat(F.lit("c"), key.cast("string")).alias("request_id"),
        _one_of(key % len(CUSTOMER_TEXTS), [(i, _sentence(t, own)) for i, t in enumerate(CUSTOMER_TEXTS)]).alias("query_text"),
        F.date_format(start + minute, ISO).alias("created_at"), *none,
    )
    user = F.col("user_id")
    own = {"id": F.concat(F.lit("C"), (user + 10000).cast("string")), "k": (user % 7 + 2).cast("string")}
    stamp = F.date_format(F.col("ts"), ISO)  # a naive time prints as it stands
    ran = node_outcomes(events.withColumn("created_at", stamp).withColumn("k", (user % 7 + 2).cast("bigint")).withColumn(
        "query_text", _one_of(F.col("event_type"), [(e, _sentence(t, own)) for e, t in EVENT_TEXTS.items()])), "k", "query_text", "created_at")
    runs = ran.select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("request_id"), "query_text",
        "created_at", "node_name", "status", "duration_ms", "k",
    )
    return turns.unionByName(people).unionByName(runs)


def wall_clock_utc(c: F.Column, dtype: str) -> F.Column:
    """A naive (NTZ) event time as the instant whose UTC wall clock equals it,
    so day windows align with the naive dates whatever the session zone
    (zone-free: microseconds since the naive epoch → instant)."""

    if dtype != "timestamp_ntz":
        return c.cast("timestamp")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, c))


def node_outcomes(events: DataFrame, *keep: str) -> DataFrame:
    """One node execution per event (K1 at volume); ``keep`` carries further columns."""

    node = F.element_at(_node_map(), F.col("event_type"))
    return events.select(
        "event_id",
        F.col("user_id").alias("query_id"),
        node.alias("node_name"),
        F.when(F.col("event_type") == "error", F.lit("failed")).otherwise(F.lit("success")).alias("status"),
        F.floor(F.col("value").cast("decimal(18,2)")).cast("bigint").alias("duration_ms"),
        wall_clock_utc(F.col("ts"), dict(events.dtypes)["ts"]).alias("ts"),
        *keep,
    )


def query_log(req: DataFrame) -> DataFrame:
    """The log table (F6 schema + dataset_id) of all requests, JSON columns as text.

    Whether a text was seen before is told by the first request of its digest:
    one aggregate row per distinct text, joined on the 16-byte digest (a popular
    text's partition is split by the adaptive skew join)."""

    from cohortlens.operators.text import normalize_log_key

    seg = F.coalesce(F.col("node_name") == "segmentation", F.lit(False))
    dep = lambda *d: F.array(*[F.lit(x) for x in d]).cast("array<string>")
    graph = F.when(
        seg,
        F.array(
            F.struct(F.lit("feature_engineering").alias("node_name"), F.lit("Load and prepare customer-level features").alias("purpose"), dep().alias("dependencies")),
            F.struct(F.lit("segmentation").alias("node_name"), F.lit("Cluster customers into behavioural groups").alias("purpose"), dep("feature_engineering").alias("dependencies")),
            F.struct(F.lit("recommendation").alias("node_name"), F.lit("Attach tier-based retention and cross-sell guidance").alias("purpose"), dep("segmentation").alias("dependencies")),
        ),
    ).otherwise(
        F.array(F.struct(F.coalesce("node_name", F.lit("eda")).alias("node_name"), F.lit("Provide exploratory summaries, distributions, and null checks").alias("purpose"), dep().alias("dependencies")))
    )
    slow = F.col("duration_ms") % 4 == 0  # FIXED RULE: every fourth duration stands for a surrogate that failed
    expl = F.when(seg, F.struct(
        F.when(slow, F.lit("rule_based_fallback")).otherwise(F.lit("shap")).alias("explainer_used"),
        F.when(slow, F.lit("surrogate_failed")).otherwise(F.lit("surrogate_explained")).alias("explainer_reason"),
        F.col("duration_ms").alias("customer_count"),
        F.col("k").alias("segment_count"),
    ))
    nodes = F.when(F.col("node_name").isNotNull(), F.to_json(F.create_map(F.coalesce("node_name", F.lit("")), F.struct(
        F.lit("dict").alias("type"), F.col("duration_ms"), F.col("status")))))
    base = req.select(
        F.col("request_id").alias("id"),
        "query_text",
        normalize_log_key(F.col("query_text")).alias("query_text_normalized"),
        F.lit(DATASET_ID).alias("dataset_id"),
        F.to_json(graph).alias("execution_graph_summary"),
        F.when(seg, F.lit("kmeans")).alias("chosen_algorithm"),
        nodes.alias("node_outputs_summary"),
        F.to_json(expl).alias("explanation_summary"),
        F.when(seg, F.lit("full_workflow")).otherwise(F.lit("eda_only")).alias("workflow"),
        "created_at",
    ).withColumn("text_digest", F.md5(F.col("query_text_normalized").cast("binary")))
    first = base.groupBy("text_digest", "dataset_id").agg(F.min(F.struct("created_at", "id")).alias("first"))
    out = base.join(first, ["text_digest", "dataset_id"])
    hit = F.struct("created_at", "id") > F.col("first")
    return out.select(
        "id", "query_text", "query_text_normalized", "dataset_id", "execution_graph_summary", "chosen_algorithm",
        "node_outputs_summary", "explanation_summary",
        F.to_json(F.struct(hit.alias("cache_hit"), F.col("workflow"))).alias("response_json"),
        "created_at",
    )


def load_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(table(spark, sf_dir, "conversations"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "events"))


def load_query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_log(load_requests(spark, sf_dir))


def requests_sql() -> str:
    """``requests`` as SQL: id, query_text, created_at, node_name, status, duration_ms, k."""

    own = {"id": "'C' || (10000 + c_custkey)", "k": "(c_custkey % 7 + 2)", "seg": "lower(c_mktsegment)"}
    people = " ".join(f"WHEN {i} THEN {sentence_sql(t, own)}" for i, t in enumerate(CUSTOMER_TEXTS))
    own = {"id": "'C' || (10000 + user_id)", "k": "(user_id % 7 + 2)"}
    runs = " ".join(f"WHEN '{e}' THEN {sentence_sql(t, own)}" for e, t in EVENT_TEXTS.items())
    node = "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in EVENT_NODE.items()) + " END"
    iso = "'%Y-%m-%dT%H:%M:%S+00:00'"
    return f"""SELECT 't' || conv_id || '.' || turn AS id, text AS query_text,
    strftime(TIMESTAMP '{EPOCH}' + to_hours(CAST(conv_id AS BIGINT)) + to_minutes(CAST(turn AS BIGINT)), {iso}) AS created_at,
    CAST(NULL AS VARCHAR) AS node_name, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS BIGINT) AS duration_ms, CAST(NULL AS BIGINT) AS k
  FROM conversations WHERE role = 'user'
  UNION ALL SELECT 'c' || c_custkey, CASE c_custkey % {len(CUSTOMER_TEXTS)} {people} END,
    strftime(TIMESTAMP '{EPOCH}' + to_minutes(CAST(c_custkey AS BIGINT)), {iso}), NULL, NULL, NULL, NULL FROM customer
  UNION ALL SELECT 'e' || event_id, CASE event_type {runs} END, strftime(ts, {iso}), {node},
    CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END, CAST(floor(CAST(value AS DECIMAL(18,2))) AS BIGINT), CAST(user_id % 7 + 2 AS BIGINT) FROM events"""
