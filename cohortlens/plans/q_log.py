"""Query-log and event queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens import catalog
from cohortlens.operators import querylog as L
from cohortlens.plans.common import r4
from cohortlens.plans.registry import register
from cohortlens.session import ensure_checkpoint_dir, remember
from cohortlens.sources.logstore import LogStore
from cohortlens.sources.querylog import EVENT_NODE, load_query_log, node_outcomes, requests_sql
from cohortlens.sources.tables import table


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


LOG_CTE = f"""WITH req AS ({requests_sql()}),
no AS (SELECT event_id, user_id AS query_id, CASE event_type {" ".join(f"WHEN {_q(e)} THEN {_q(n)}" for e, n in EVENT_NODE.items())} END AS node_name,
              CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
              CAST(floor(CAST(value AS DECIMAL(18,2))) AS BIGINT) AS duration_ms, ts FROM events),
log0 AS (SELECT *, trim(regexp_replace(lower(query_text), '\\s+', ' ', 'g')) AS query_text_normalized, 'customers' AS dataset_id,
                coalesce(node_name = 'segmentation', false) AS seg FROM req),
log AS (SELECT *, row_number() OVER (PARTITION BY query_text_normalized, dataset_id ORDER BY created_at, id) > 1 AS cache_hit,
               CASE WHEN seg THEN 'kmeans' END AS chosen_algorithm, CAST(NULL AS VARCHAR) AS explainer_used FROM log0)"""

_SEED = " UNION ALL ".join(f"SELECT {_q(n)} AS node_name" for n in catalog.KNOWN_NODES)


@register(
    "node_stats",
    LOG_CTE + f""", calls AS (SELECT node_name, count(*) AS call_count, count(*) FILTER (WHERE status = 'success') AS success_count,
       count(*) FILTER (WHERE status <> 'success') AS failure_count, sum(duration_ms) AS total_ms
  FROM log WHERE node_name IS NOT NULL GROUP BY node_name),
seed AS ({_SEED})
SELECT coalesce(c.node_name, s.node_name) AS node_name, coalesce(call_count, 0) AS call_count, coalesce(success_count, 0) AS success_count,
  coalesce(failure_count, 0) AS failure_count,
  CASE WHEN call_count > 0 THEN {r4('CAST(total_ms AS DOUBLE) / call_count', 2)} ELSE 0.0 END AS avg_duration_ms
FROM calls c FULL JOIN seed s ON c.node_name = s.node_name""",
)
def node_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.node_stats(load_query_log(spark, sf_dir))


@register(
    "graph_view",
    LOG_CTE + """, g AS (
  SELECT id, 0 AS position, 'feature_engineering' AS node_name, '' AS dependencies, * EXCLUDE (id, node_name), node_name AS ran FROM log WHERE seg
  UNION ALL SELECT id, 1, 'segmentation', 'feature_engineering', * EXCLUDE (id, node_name), node_name FROM log WHERE seg
  UNION ALL SELECT id, 2, 'recommendation', 'segmentation', * EXCLUDE (id, node_name), node_name FROM log WHERE seg
  UNION ALL SELECT id, 0, coalesce(node_name, 'eda'), '', * EXCLUDE (id, node_name), node_name FROM log WHERE NOT seg)
SELECT id, position, node_name, CASE WHEN ran = node_name THEN status ELSE 'skipped' END AS status,
  CAST(CASE WHEN ran = node_name THEN duration_ms ELSE 0 END AS BIGINT) AS duration_ms, dependencies FROM g""",
)
def graph_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = L.graph_view(load_query_log(spark, sf_dir))
    return g.select("id", "position", "node_name", "status", "duration_ms", F.array_join("dependencies", "|").alias("dependencies"))


@register(
    "recent_queries",
    LOG_CTE + """ SELECT id, query_text, chosen_algorithm, cache_hit,
  CASE WHEN seg THEN CASE WHEN duration_ms % 4 = 0 THEN 'rule_based_fallback' ELSE 'shap' END END AS explainer_used, created_at
FROM log ORDER BY created_at DESC, log.id DESC LIMIT 50""",
)
def recent_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.recent_queries(load_query_log(spark, sf_dir), 50)


@register(
    "latest_per_key",
    LOG_CTE + """ SELECT query_text_normalized, dataset_id, arg_max(id, created_at || id) AS latest_id,
  max(created_at) AS latest_created_at, count(*) AS n_rows FROM log GROUP BY ALL""",
)
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.latest_per_key(load_query_log(spark, sf_dir)).drop("response_json")


_REUSE = LOG_CTE + """ SELECT id AS request_id, query_text_normalized, lag(id) OVER w IS NOT NULL AS cache_hit, lag(id) OVER w AS cached_id,
  lag(created_at) OVER w AS cached_created_at FROM log WINDOW w AS (PARTITION BY query_text_normalized, dataset_id ORDER BY created_at, id)"""


@register("log_reuse", _REUSE)
def log_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.log_reuse(load_query_log(spark, sf_dir))


@register("log_reuse_stored", _REUSE)
def log_reuse_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8 + S9 + L1: the log is appended to a bucketed table in two batches, the second
    one twice, and every row looks up the stored log."""

    log = load_query_log(spark, sf_dir)
    run = uuid.uuid4().hex
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/cohortlens-tables/log-{run}"
    remember(spark, path)
    store = LogStore(spark, f"query_log_{run}", path, buckets=int(spark.conf.get("spark.sql.shuffle.partitions")), period="month")
    ran = F.col("node_outputs_summary").isNotNull()
    store.append(log.where(~ran), run, "asked")
    for _ in range(2):
        store.append(log.where(ran), run, "ran")
    return L.log_reuse(store.rows())


@register(
    "live_node_state",
    LOG_CTE + """, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, node_name ORDER BY ts DESC, event_id DESC) AS rn,
                 count(*) OVER (PARTITION BY query_id, node_name) AS n_events FROM no)
SELECT query_id, node_name, status, duration_ms, n_events FROM r WHERE rn = 1""",
)
def live_node_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.live_node_state(node_outcomes(table(spark, sf_dir, "events")))
