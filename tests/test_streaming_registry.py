"""Streaming replay equals batch (K2, K3); log append (S8); registry fallback."""

import os
import tempfile

from pyspark.sql import functions as F

from cohortlens.operators import querylog as L
from cohortlens.operators import registry as R
from cohortlens.sources.querylog import load_query_log, node_outcomes
from cohortlens.sources.tables import table
from cohortlens.streaming import events as S

SF = "/root/testdata/sf0.001"


def test_stream_node_stats_equals_batch(spark):
    src = S.event_stream(spark, f"{SF}/events.parquet")
    got = {r.node_name: tuple(r)[1:] for r in S.finish_node_stats(S.run_available(S.node_stats_stream(src), "t_stats", "complete")).collect()}
    o = node_outcomes(table(spark, SF, "events"))
    batch = o.groupBy("node_name").agg(
        F.count(F.lit(1)).alias("call_count"), F.count_if(F.col("status") == "success").alias("success_count"),
        F.count_if(F.col("status") != "success").alias("failure_count"), F.sum("duration_ms").alias("total_ms"))
    want = {r.node_name: tuple(r)[1:] for r in S.finish_node_stats(batch).collect()}
    assert got == want


def test_stream_live_state_equals_batch_latest(spark):
    src = S.event_stream(spark, f"{SF}/events.parquet", max_files_per_trigger=1)
    got = S.run_available(S.live_state_stream(src), "t_live", "update", keys=["day", "query_id", "node_name"])
    batch = L.live_node_state(node_outcomes(table(spark, SF, "events")).withColumn("day", F.date_format("ts", "yyyy-MM-dd")))
    assert got.count() > 0
    assert got.select("query_id", "node_name").distinct().count() == batch.select("query_id", "node_name").distinct().count()


def test_append_log_partitioned(spark):
    log = load_query_log(spark, SF)
    path = os.path.join(tempfile.mkdtemp(prefix="cohortlens-log-"), "log")
    L.append_log(log, path)
    L.append_log(log, path)
    back = spark.read.parquet(path)
    assert back.count() == 2 * log.count() and "created_date" in back.columns


def test_registry_and_fallback(spark):
    names = {e["name"]: e["metadata"]["status"] for e in R.list_available()}
    assert names["kmeans"] == names["bisecting_kmeans"] == names["dbscan"] == names["hdbscan"] == "active"
    assert R.bounded("kmeans", {"n_clusters": 500, "n_init": "x"}, 10) == {"n_clusters": 9, "n_init": 10, "random_state": 42}
    assert R.bounded("bisecting_kmeans", {"n_clusters": -3, "eps": 1}, 100)["n_clusters"] == 2
    assert R.bounded("dbscan", {"eps": "1e9", "min_samples": 1}, 10, 7.5) == {"eps": 7.5, "min_samples": 2}
    assert R.bounded("hdbscan", {"cut_distance": "nan", "min_samples": 99, "min_cluster_size": "x"}, 10, 7.5) == {"min_cluster_size": 5, "min_samples": 10, "cut_distance": 0.5}
    assert R.bounded("dbscan", {"eps": 0}, 10, 0.0)["eps"] == 0.0001
    rows = [(f"C{i:03d}", float(i % 5), float((i * 7) % 11)) for i in range(60)]
    df = spark.createDataFrame(rows, "CUST_ID string, a double, b double")
    res = R.segment(df, algorithm="dbscan", params={"n_clusters": 2})
    assert (res.algorithm, res.reason, res.detail) == ("kmeans", "too_few_segments", "dbscan")  # eps 0.5: noise only
    assert res.labels.select("cluster_label").distinct().count() == 2
    two = df.unionByName(df.selectExpr("concat('D', CUST_ID) AS CUST_ID", "a + 100 AS a", "b"))
    for name, params in (("dbscan", {"eps": 1.5}), ("hdbscan", {"cut_distance": 1.5})):
        res = R.segment(two, algorithm=name, params=params)
        assert (res.algorithm, res.reason, res.centers, res.inertia) == (name, "as_requested", None, None)
        found = {(r[0][0], r[1]) for r in res.labels.select("CUST_ID", "cluster_label").collect()}
        assert {("C", 0), ("D", 1)} <= found <= {("C", 0), ("D", 1), ("C", -1), ("D", -1)}
    R.register("off", None, {"type": "clustering"})
    assert R.segment(df, algorithm="off", params={"n_clusters": 2}).reason == "not_active"
    res = R.segment(df, algorithm="bisecting_kmeans", params={"n_clusters": 2})
    assert (res.algorithm, res.reason) == ("bisecting_kmeans", "as_requested")

    def broken(matrix, cols, params):
        raise RuntimeError("no")

    def single(matrix, cols, params):
        from pyspark.sql import functions as F

        return matrix.select("CUST_ID", F.lit(0).alias("cluster_label")), [], 0.0

    for fn, reason in ((broken, "fit_error"), (single, "too_few_segments")):
        R.register("own", fn, {"type": "clustering"})
        res = R.segment(df, algorithm="own", params={"n_clusters": 3})
        assert (res.algorithm, res.reason) == ("kmeans", reason)
    R.register("own", None, {"type": "clustering"})


def test_live_state_loses_no_event_over_files(spark, tmp_path):
    events = table(spark, SF, "events")
    events.repartition(4, "event_id").write.parquet(str(tmp_path / "events"))
    src = S.event_stream(spark, str(tmp_path / "events"), max_files_per_trigger=1)
    got = S.run_available(S.live_state_stream(src), "t_files", "update", keys=["day", "query_id", "node_name"])
    assert sum(r["n_events"] for r in got.collect()) == events.count()


def test_stream_run_resumes_under_its_id(spark, tmp_path):
    import uuid

    run = uuid.uuid4().hex
    events = table(spark, SF, "events")
    half = events.where("event_id % 2 = 0")
    half.write.parquet(str(tmp_path / "e"))
    stats = lambda: S.node_stats_stream(S.event_stream(spark, str(tmp_path / "e")))
    total = lambda df: sum(r["call_count"] for r in df.collect())
    assert total(S.run_available(stats(), "t_resume", "complete", run_id=run)) == half.count()
    events.where("event_id % 2 = 1").write.mode("append").parquet(str(tmp_path / "e"))
    assert total(S.run_available(stats(), "t_resume", "complete", run_id=run)) == events.count()


def test_rows_of_sources_are_kept(spark):
    from cohortlens.sources.profile import load_profile
    from cohortlens.sources.querylog import load_requests

    for sf in ("0.001", "0.01", "0.1"):
        folder = f"/root/testdata/sf{sf}"
        assert load_profile(spark, folder).count() == table(spark, folder, "customer").count()
        want = table(spark, folder, "customer").count() + table(spark, folder, "events").count() + table(spark, folder, "conversations").where("role = 'user'").count()
        assert load_requests(spark, folder).select("request_id").distinct().count() == want
