"""Physical-plan properties the design relies on (pruning, no needless shuffles, partial top-N)."""

from pyspark.sql import functions as F

from cohortlens.operators import personas as P
from cohortlens.operators import segments as S
from cohortlens.operators import text as X
from cohortlens.sources.profile import load_profile
from cohortlens.sources.querylog import load_requests

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_profile_scans_are_pruned(spark):
    plan = _plan(load_profile(spark, SF))
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_returnflag:string,l_linestatus:string>" in plan
    assert "l_shipdate" not in plan and "l_comment" not in plan


def test_text_scoring_has_no_shuffle(spark):
    r = load_requests(spark, SF).select("request_id", X.normalize_query(F.col("query_text")).alias("nq"))
    plan = _plan(X.classify_semantic(r, "request_id", "nq"))
    assert "Exchange" not in plan and "Join" not in plan


def test_boundary_metrics_is_a_projection(spark):
    rows = [(f"C{i}", float(i % 7), float(i % 5), i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "CUST_ID string, a double, b double, cluster_label int")
    cen = S.explanation_centers(df, ["a", "b"])
    plan = _plan(S.boundary_metrics(df, ["a", "b"], cen))
    assert "Join" not in plan and "Exchange" not in plan


def test_top_n_per_persona_limits_before_shuffle(spark):
    rows = [(f"C{i}", i % 4, float(i), float(100 - i), float(i % 5), float(i) / 100) for i in range(200)]
    df = P.attach_personas(spark.createDataFrame(rows, "CUST_ID string, cluster int, PURCHASES double, BALANCE double, CASH_ADVANCE double, BALANCE_FREQUENCY double"))
    plan = _plan(P.persona_top_n(df, 5))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_explanations_run_once(spark):
    from cohortlens.plans import registry

    registry.load_all()
    for name in ("shap_top5", "lime_top5", "segment_importance"):
        assert _plan(registry.QUERIES[name](spark, SF)).count("MapInPandas") == 1, name
    for name in ("centroid_intent", "ambiguity", "request_context"):
        plan = _plan(registry.QUERIES[name](spark, SF))
        assert "Exchange" not in plan and "Join" not in plan, name


def test_shared_folder_is_required_on_a_cluster():
    import pytest

    from cohortlens.session import ensure_checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())
