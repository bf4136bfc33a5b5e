"""Routing texts and the query log (X*, T*, A18, J6, L*) on the reference's fixture cases."""

import json

from pyspark.sql import functions as F

from cohortlens import catalog
from cohortlens.operators import querylog as L
from cohortlens.operators import text as X

COLUMNS = catalog.REQUIRED_COLUMNS


def _ctx(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "rid long, q string")
    return {r.rid: r for r in X.build_context(df, "rid", "q", COLUMNS).collect()}


def test_routing_fixture_sentences(spark):
    texts = [
        "segment customers into 3 clusters",
        "  Segment! Customers??  ",
        "show descriptive statistics for the dataset",
        "Find customers suitable for investment products",
        "explain why this customer is in this segment",
        "Why was customer C10002 placed in this segment?",
        "list customers in Chennai",
        "users in Chennai between age 20 and 24 with less than 100 in their account",
        "high value customers",
        "who are the best customers",
    ]
    c = _ctx(spark, texts)
    assert c[0].intent == "segmentation" and c[0].n_clusters == 3 and c[0].workflow == "full_workflow"
    assert c[1].normalized_query == "segment customers"
    assert c[2].intent == "descriptive" and c[2].steps == ["eda"]
    assert c[3].intent == "segmentation" and c[3].steps == catalog.STEPS_SEGMENTATION
    assert c[4].keyword_intent == "explanation_only"
    assert c[5].intent == "explanation" and c[5].customer_id == "C10002" and c[5].tools == ["Single_Customer_Lookup"]
    assert c[6].clarification == "unsupported_filters_only" and c[6].unsupported_filters == ["city/location"]
    assert c[7].unsupported_filters == ["age", "city/location"]
    assert c[8].clarification == "threshold_ambiguity"
    assert c[9].target_persona == "The Transactors"


def test_subjective_assumption(spark):
    df = spark.createDataFrame([("who are the best customers",), ("top 5 customers",)], "q string")
    out = [r[0] for r in df.select(X.subjective_assumption(F.col("q"))).collect()]
    assert out[0].startswith("Assumed 'best customers' refers to 'The Transactors'") and out[1] is None


def test_log_key_normalisation(spark):
    df = spark.createDataFrame([("  Segment  Customers   into 3 Clusters  ",)], "q string")
    assert df.select(X.normalize_log_key(F.col("q"))).first()[0] == "segment customers into 3 clusters"


def _log(spark, rows):
    return spark.createDataFrame(rows, "id long, query_text string, query_text_normalized string, dataset_id string, "
                                       "execution_graph_summary string, chosen_algorithm string, node_outputs_summary string, "
                                       "explanation_summary string, response_json string, created_at string")


def test_node_stats_exact_numbers(spark):
    s1 = json.dumps({"analytics": {"duration_ms": 100, "status": "success"}, "eda": {"duration_ms": 200, "status": "success"}})
    s2 = json.dumps({"analytics": {"duration_ms": 150, "status": "success"}, "eda": {"duration_ms": 50, "status": "failed"}})
    log = _log(spark, [(1, "a", "a", "d", None, None, s1, None, None, "2024-01-01T00:00:00+00:00"),
                       (2, "b", "b", "d", None, None, s2, None, None, "2024-01-01T00:01:00+00:00"),
                       (3, "c", "c", "d", None, None, "not json", None, None, "2024-01-01T00:02:00+00:00")])
    st = {r.node_name: r for r in L.node_stats(log).collect()}
    assert (st["analytics"].call_count, st["analytics"].success_count, st["analytics"].failure_count, st["analytics"].avg_duration_ms) == (2, 2, 0, 125.0)
    assert (st["eda"].call_count, st["eda"].success_count, st["eda"].failure_count, st["eda"].avg_duration_ms) == (2, 1, 1, 125.0)
    assert st["segmentation"].call_count == 0 and len(st) == 7


def test_graph_view_statuses(spark):
    graph = json.dumps([{"node_name": "analytics", "dependencies": []}, {"node_name": "eda", "dependencies": ["analytics"]},
                        {"node_name": "skipped_node", "dependencies": ["eda"]}])
    summ = json.dumps({"analytics": {"duration_ms": 100, "status": "success"}, "eda": {"duration_ms": 5, "status": "failed"}})
    log = _log(spark, [(1, "q", "q", "d", graph, None, summ, None, None, "2024-01-01T00:00:00+00:00")])
    g = [(r.node_name, r.status, r.duration_ms) for r in L.graph_view(log).orderBy("position").collect()]
    assert g == [("analytics", "success", 100), ("eda", "failed", 5), ("skipped_node", "skipped", 0)]


def test_recent_and_reuse(spark):
    rows = [
        (1, "Q one", "q one", "d", None, "kmeans", None, json.dumps({"explainer_used": "shap"}), json.dumps({"cache_hit": False}), "2024-01-01T00:00:00+00:00"),
        (2, "q  ONE", "q one", "d", None, "dbscan", None, json.dumps({"explainer_used": "lime"}), json.dumps({"cache_hit": True}), "2024-01-01T00:01:00+00:00"),
        (3, "other", "other", "d", None, None, None, None, None, "2024-01-01T00:02:00+00:00"),
    ]
    log = _log(spark, rows)
    rec = L.recent_queries(log, 20).collect()
    assert [r.id for r in rec] == ["3", "2", "1"] and rec[1].cache_hit is True and rec[1].explainer_used == "lime"
    out = {r.request_id: r for r in L.log_reuse(log).collect()}
    assert not out[1].cache_hit and not out[3].cache_hit
    assert out[2].cache_hit and (out[2].cached_id, out[2].cached_created_at) == (1, "2024-01-01T00:00:00+00:00")


def test_reuse_reaches_over_days(spark):
    base = ("T", "t", "d", None, None, None, None, None)
    log = _log(spark, [(i, *base, f"2024-01-{day:02d}T0{i}:00:00+00:00") for i, day in [(1, 1), (2, 1), (3, 4), (4, 9), (5, 9)]])
    assert {r.request_id: r.cached_id for r in L.log_reuse(log).collect()} == {1: None, 2: 1, 3: 2, 4: 3, 5: 4}


def test_log_record_roundtrip(spark):
    rec = L.log_record(spark, "Segment  Customers", {"cache_hit": False}, graph=[{"node_name": "eda", "dependencies": []}],
                       node_summary={"eda": {"type": "dict", "duration_ms": 7, "status": "success"}}, record_id=5)
    assert rec.first().query_text_normalized == "segment customers"
    g = L.graph_view(rec).first()
    assert (g.node_name, g.status, g.duration_ms) == ("eda", "success", 7)


#: Decision columns of the text queries: each must show at least two values.
DECISIONS = {
    "normalize_text": ["token_count", "has_digit"], "extract_ids": ["customer_id", "customer_id_normalized"], "extract_cluster_count": ["n_clusters"],
    "unsupported_filters": ["requested", "unsupported"], "keyword_intent": ["keyword_intent", "entities", "output_format"],
    "infer_persona": ["target_persona", "operational_assumption"], "centroid_intent": ["category", "similarity_score", "matched_example", "intent"],
    "ambiguity": ["clarification"], "request_context": ["intent", "workflow", "steps", "tools", "n_clusters", "customer_id", "clarification", "target_persona", "unsupported_filters"],
    "log_reuse": ["cache_hit", "cached_id"], "latest_per_key": ["n_rows"], "recent_queries": ["query_text", "created_at"], "explanation_counts": ["explainer_used"],
    "tfidf_vectors": ["term", "weight"], "graph_view": ["status"], "cluster_recommendations": ["tier", "tags"], "tiers": ["tier"], "unique_tags": ["tag"],
}


def test_decisions_vary(spark):
    import duckdb

    from cohortlens.plans import registry
    from cohortlens.sources.tables import TABLES

    registry.load_all()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    for name, columns in DECISIONS.items():
        if name not in registry.ORACLES:
            continue
        rows = con.execute(registry.ORACLES[name])
        at = [d[0] for d in rows.description]
        rows = rows.fetchall()
        for c in columns:
            if c in at:
                assert len({str(r[at.index(c)]) for r in rows}) >= 2, (name, c)
    rows = con.execute(registry.ORACLES["request_context"]).fetchall()
    assert any("C10" in str(r) for r in rows)
    assert {"query_too_vague", "unsupported_filters_only", "threshold_ambiguity", None} <= {r[0] for r in con.execute("SELECT DISTINCT clarification FROM (" + registry.ORACLES["ambiguity"] + ")").fetchall()}


def test_context_sql_reads_customer_id():
    import duckdb

    from cohortlens.plans.q_text import _context_sql

    con = duckdb.connect()
    con.execute("CREATE TABLE conversations AS SELECT 1 AS conv_id, 1 AS turn, 'user' AS role, 'Why was customer C10002 placed in this segment?' AS text")
    con.execute("CREATE TABLE customer (c_custkey BIGINT, c_mktsegment VARCHAR)")
    con.execute("CREATE TABLE events (event_id BIGINT, user_id BIGINT, event_type VARCHAR, ts TIMESTAMP, value DOUBLE)")
    got = con.execute("SELECT customer_id, tools FROM (" + _context_sql() + ")").fetchall()
    assert got == [("C10002", "Single_Customer_Lookup")]


def test_router_equals_dictionary_arithmetic(spark):
    """The coded vectors against term-by-term sums in plain Python: odd texts, ties, none known."""

    import math

    params = X.model_params(spark)
    phrases = [e["example"] for _, e in params["examples"]]
    texts = ["", None, "zzz qqq", "segment", "segment segment customers", *phrases, " ".join(phrases), "explain summary segment " * 400]
    df = spark.createDataFrame(list(enumerate(texts)), "rid long, q string").withColumn("nq", X.normalize_query(F.col("q")))
    found = {r.rid: r.t or [] for r in df.select("rid", X.terms(F.col("nq")).alias("t")).collect()}
    got = {r.rid: r for r in X.classify_semantic(df, "rid", "nq", keep=("q",)).collect()}
    vectors = {}
    for r in X.tfidf_vectors(df, "rid", "nq").collect():
        vectors.setdefault(r.rid, {})[r.term] = r.w
    assert len(got) == len(texts)
    for rid, terms in found.items():
        tf = {t: terms.count(t) * params["idf"][t] for t in terms if t in params["idf"]}
        norm = math.sqrt(sum(v * v for v in tf.values()))
        unit = {t: v / norm for t, v in tf.items()}
        assert vectors.get(rid, {}).keys() == unit.keys() and all(abs(vectors[rid][t] - w) < 1e-12 for t, w in unit.items())
        scores = [(sum(w * c["terms"].get(t, 0.0) for t, w in unit.items()) / c["cn"], cat) for cat, c in params["categories"]]
        top = max(s for s, _ in scores)
        row = got[rid]
        if top <= 0:
            assert (row.category, row.similarity_score, row.matched_example) == ("descriptive", 0.0, "")
            continue
        assert abs(row.similarity_score - top) <= 0.5001e-4 and dict((c, s) for s, c in scores)[row.category] >= top - 1e-12
        own = {e["example"]: sum(w * e["terms"].get(t, 0.0) for t, w in unit.items()) for (cat, _), e in params["examples"] if cat == row.category}
        assert own[row.matched_example] >= max(own.values()) - 1e-12
    assert got[0].category == got[1].category == got[2].category == "descriptive"


def test_router_on_an_empty_table(spark):
    df = spark.createDataFrame([], "rid long, nq string")
    assert X.classify_semantic(df, "rid", "nq").count() == 0 and X.tfidf_vectors(df, "rid", "nq").count() == 0


def test_texts_are_normalised_once(spark):
    """The plan holds one normalisation a text, not one for each use of its tokens."""

    texts = ["Show male customers aged 30 in Delhi!", "segment  customers", "recommend a chart: best customers", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "q string")
    r = X.with_normalized(df, "q", "nq")
    n, t = F.col("nq"), F.col("tokens_")
    out = r.select(X.requested_filters(n, t).alias("f"), X.keyword_intent(n, t).alias("k"), X.entities(n).alias("e"), X.output_format(n).alias("o"))
    assert out._jdf.queryExecution().executedPlan().toString().count("regexp_replace(") <= 4
    got = [tuple(x) for x in out.collect()]
    n = X.normalize_query(F.col("q"))
    old = df.select(X.requested_filters(n), X.keyword_intent(n), X.entities(n), X.output_format(n)).collect()
    assert got == [tuple(x) for x in old]
    assert got[0][0] == ["age", "city/location", "gender"] and got[2][2:] == (["recommendations", "visualization"], "chart")
    assert got[3] == ([], "full_workflow", [], "table")


def test_recent_queries_name_the_recorded_explainer(spark):
    from cohortlens.sources.querylog import query_log

    rows = [(f"e{i}", "t", f"2024-01-01T00:00:0{i}+00:00", node, "success", ms, 3) for i, (node, ms) in enumerate([("segmentation", 8), ("segmentation", 9), ("eda", 8), (None, None)])]
    req = spark.createDataFrame(rows, "request_id string, query_text string, created_at string, node_name string, status string, duration_ms long, k long")
    assert [r.explainer_used for r in L.recent_queries(query_log(req)).collect()] == [None, None, "shap", "rule_based_fallback"]
