"""Live execution state (K1, K2), the model store (G1) and scoring over it (K4), explanation records."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import querylog as L
from cohortlens.operators.explain import Explanation
from cohortlens.operators.models import Model, ModelStore
from cohortlens.sources.execution import EVENT_COLUMNS, execution_events
from cohortlens.sources.tables import table
from cohortlens.streaming import events as S
from cohortlens.streaming import live

SF = "/root/testdata/sf0.001"
SCHEMA = "event_id long, type string, query_id string, ts timestamp, workflow_name string, nodes array<string>, node_name string, status string, duration_ms long, error string"


def run(states, progress=None):
    return S.run_available(states, "t_live", "update", live.KEYS, settings=live.STATE_STORE, progress=progress)


def plain_states(rows):
    """The newest state of every node, event by event."""

    out = {}
    for q in {r["query_id"] for r in rows}:
        own = [r for r in rows if r["query_id"] == q]
        planned = next((r["nodes"] for r in own if r["type"] == "query_started"), [])
        status = next((r["status"] for r in own if r["type"] == "query_completed"), "running")
        seen = {}
        for r in own:
            if r["type"].startswith("node_"):
                key = (r["ts"], r["type"] == "node_completed", r["event_id"])
                if r["node_name"] not in seen or key > seen[r["node_name"]][0]:
                    seen[r["node_name"]] = (key, "running" if r["type"] == "node_started" else r["status"], r["duration_ms"])
        for n in [*planned, *(seen.keys() - set(planned))]:
            out[q, n] = (*seen.get(n, (None, "pending", None))[1:], status)
    return out


def states(df):
    return {(r["query_id"], r["node_name"]): (r["status"], r["duration_ms"], r["query_status"]) for r in df.collect()}


def test_out_of_order_files_end_in_the_same_states(spark):
    events = execution_events(table(spark, SF, "events"))
    assert events.columns == EVENT_COLUMNS
    path = live.write_events(events, files=3)  # dealt by id: each file holds all days
    got = states(run(live.live_execution(live.read_events(spark, path, 1), late="60 days")))
    assert got == plain_states(events.collect())
    assert {s for s, _, _ in got.values()} == {"pending", "running", "success", "failed"}


def test_a_query_over_its_life(spark, tmp_path):
    """Pending, running, done and running again; events before the start of their query; a finished query leaves the state."""

    def at(minute, second=0):
        return f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:{second:02d}"

    files = [
        [(1, "node_started", "q1", at(1), None, None, "a", None, None, None)],
        [(0, "query_started", "q1", at(0), "w", ["a", "b", "c"], None, None, None, None), (2, "node_completed", "q1", at(2), None, None, "a", "success", 60000, None)],
        [(3, "node_started", "q1", at(3), None, None, "b", None, None, None), (4, "node_completed", "q1", at(3), None, None, "b", "failed", 0, "no"), (9, "node_started", "q1", at(4), None, None, "a", None, None, None)],
        [(5, "query_completed", "q1", at(5), None, None, None, "failed", None, None), (6, "query_started", "q2", at(6), "w", ["a"], None, None, None, None)],
        [(7, "query_started", "q3", at(600), "w", ["a"], None, None, None, None)],
        [(8, "query_started", "q4", at(900), "w", ["a"], None, None, None, None)],
    ]
    path, run_id, sizes = str(tmp_path / "log"), uuid.uuid4().hex, []
    for i, rows in enumerate(files):
        df = spark.createDataFrame(rows, SCHEMA.replace("ts timestamp", "ts string")).withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.mode("append").parquet(path)
        progress = []
        stream = live.live_execution(live.read_events(spark, path), late="10 minutes", keep_ms=60_000)
        got = states(S.run_available(stream, "t_life", "update", live.KEYS, run_id=run_id, settings=live.STATE_STORE, progress=progress))
        sizes.append([p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]][-1])
        if i == 0:
            assert got == {("q1", "a"): ("running", None, "running")}
        if i == 1:
            assert got == {("q1", "a"): ("success", 60000, "running"), ("q1", "b"): ("pending", None, "running"), ("q1", "c"): ("pending", None, "running")}
        if i == 2:
            assert got["q1", "b"] == ("failed", 0, "running") and got["q1", "a"] == ("running", None, "running")
    assert {k: v for k, v in got.items() if k[0] == "q1"} == {("q1", "a"): ("running", None, "failed"), ("q1", "b"): ("failed", 0, "failed"), ("q1", "c"): ("pending", None, "failed")}
    assert {q for q, _ in got} == {"q1", "q2", "q3", "q4"}
    assert sizes[-1] < sizes[3], sizes  # q1 and its nodes are gone, although q3 and q4 came


def test_active_query_started_last(spark):
    df = spark.createDataFrame([("a", 0, "n", 5), ("b", 0, "n", 9), ("b", 1, "m", 9), ("c", 0, "n", 9 - 1)], "query_id string, position int, node_name string, started_us long")
    assert {(r["query_id"], r["node_name"]) for r in live.active_query(df).collect()} == {("b", "n"), ("b", "m")}


def forest():
    rng = np.random.default_rng(3)
    ints = {k: rng.integers(-1, 5, size=(2, 7)) for k in ("feature", "left", "right")}
    return ints | {"threshold": rng.normal(size=(2, 7)), "cover": rng.uniform(size=(2, 7)), "value": rng.uniform(size=(2, 7, 3)), "classes": 3}


def test_model_store_versions(spark, tmp_path):
    store = ModelStore(spark, str(tmp_path / "models"))
    with pytest.raises(KeyError):
        store.load("m")
    model = Model("kmeans", ["a", "b"], [[1.0, 2.5], [0.1, -3.0]], {"a": 0.5, "b": None}, {"n_clusters": 2}, forest())
    assert store.save("m", model) == 1 and store.save("m", Model("kmeans", ["a"], [[9.0]]), promote=False) == 2
    back = ModelStore(spark, str(tmp_path / "models")).load("m")  # another reader
    assert (back.version, back.columns, back.centers, back.frozen, back.parameters) == (1, model.columns, model.centers, model.frozen, model.parameters)
    assert all((back.forest[k] == model.forest[k]).all() for k in model.forest if k != "classes") and back.forest["classes"] == 3
    store.promote("m", 2)
    assert store.load("m").version == 2 and store.load("m", 1).centers == model.centers
    store.promote("m", 1)  # and back
    assert store.current("m") == 1 and store.versions("m") == [1, 2]
    with pytest.raises(KeyError):
        store.promote("m", 7)


def test_swapped_model_scores_the_next_batch(spark, tmp_path):
    """A stream is resumed as in a new session: the old version's rows stay, new rows are scored by the new version."""

    customers = table(spark, SF, "customer")
    names = ["TENURE", "monthly_spend"]
    store = ModelStore(spark, str(tmp_path / "models"))
    store.save("segments", Model("kmeans", names, [[12.0, 0.0], [12.0, 50000.0]]))
    run_id, path = uuid.uuid4().hex, str(tmp_path / "arrivals")

    def score():
        stream = spark.readStream.schema(customers.schema).parquet(path)
        again = ModelStore(spark, str(tmp_path / "models"))
        return S.score_with_store(stream, table(spark, SF, "orders"), table(spark, SF, "lineitem"), again, "segments", run_id=run_id)

    even = customers.where("c_custkey % 2 = 0")
    even.write.parquet(path)
    first = {r["CUST_ID"]: r for r in score().collect()}
    assert len(first) == even.count() and {r["model_version"] for r in first.values()} == {1}
    store.save("segments", Model("kmeans", names, [[12.0, 50000.0], [12.0, 0.0]]))
    customers.where("c_custkey % 2 = 1").write.mode("append").parquet(path)
    both = {r["CUST_ID"]: r for r in score().collect()}
    assert len(both) == customers.count() and all(both[c] == r for c, r in first.items())
    assert {r["model_version"] for c, r in both.items() if c not in first} == {2}


def test_explanation_log_counts_what_was_explained(spark, tmp_path):
    people = spark.createDataFrame([("C1", 0), ("C2", 0), ("C3", 1)], "customer_id string, cluster_label int")
    made = Explanation("lime", "as_requested", "", people, people.select("cluster_label").distinct())
    empty = Explanation("none", "no_centers", "", people.limit(0), people.select("cluster_label").limit(0))
    for i, e in enumerate((made, made, empty)):
        assert L.log_explanation(str(tmp_path / "log"), e, "why", record_id=i) is None
    got = {tuple(r) for r in L.explanation_counts(spark.read.parquet(str(tmp_path / "log"))).collect()}
    assert got == {("lime", "as_requested", 2, 6, 4), ("none", "no_centers", 1, 0, 0)}


def test_dropped_tables_are_forgotten(spark):
    """A fit is made anew after its tables are deleted."""

    from cohortlens.plans import common
    from cohortlens.session import on_drop  # noqa: F401

    seen = {"k": 1}
    common.on_drop(seen.clear)
    from cohortlens import session

    for forget in session._ON_DROP:
        forget()
    assert not seen and not common._FITS


def test_a_call_reads_and_writes_a_state_once():
    """However many nodes and events a query has, a call reads each of its states once at most, and writes it once."""

    calls, kept = [], {}

    class Value:
        def __init__(self, name):
            self.name = name

        def get(self):
            calls.append(f"get {self.name}")
            return kept.get(self.name)

        def update(self, v):
            calls.append(f"put {self.name}")
            kept[self.name] = v

    class Handle:
        def getValueState(self, name, schema):
            return Value(name)

        def registerTimer(self, at):
            calls.append(f"register {at}")

        def deleteTimer(self, at):
            calls.append(f"delete {at}")

    def event(kind, number, at_us, node=None, status=None, nodes=None):
        return {"type": kind, "event_id": number, "at_us": at_us, "node_name": node, "status": status, "nodes": nodes, "workflow_name": "w", "duration_ms": None, "error": None}

    machine = live.ExecutionState(1000)
    machine.init(Handle())
    runs = [event("node_started", i, 5_000 + i, f"n{i % 40}") for i in range(400)]
    out = list(machine.handleInputRows(("q",), iter([event("query_started", 0, 0, nodes=["n0", "z"]), *runs]), None))
    assert calls == ["get query", "put query", "put nodes"] and len(out) == 41
    assert [(r.position, r.node_name, r.status) for r in out[:2]] == [(0, "n0", "running"), (1, "z", "pending")]
    calls.clear()
    out = list(machine.handleInputRows(("q",), iter([event("node_completed", 500, 9_000, "n0", "failed"), event("query_completed", 501, 9_000_000, status="failed")]), None))
    assert calls == ["get query", "get nodes", "put query", "put nodes", "put due", "register 10000"]
    assert (out[0].status, out[0].query_status, out[0].started_us) == ("failed", "failed", 0)
    calls.clear()
    list(machine.handleInputRows(("q",), iter([event("query_completed", 502, 12_000_000, status="success")]), None))
    assert calls == ["get query", "get nodes", "put query", "get due", "delete 10000", "put due", "register 13000"]


def test_packed_state_asks_the_store_once():
    """The values of a query are read together and cleared together, a changed one is written once, and the states of a call leave as one row."""

    import json

    calls, kept = [], {}

    class Map:
        def iterator(self):
            calls.append("read")
            return iter([((k,), v) for k, v in kept.items()])

        def updateValue(self, k, v):
            calls.append(f"put {k[0]}")
            kept[k[0]] = v

        def clear(self):
            calls.append("clear")
            kept.clear()

    class Handle:
        def getMapState(self, name, keys, values):
            return Map()

        def registerTimer(self, at):
            calls.append(f"register {at}")

        def deleteTimer(self, at):
            calls.append(f"delete {at}")

    def event(kind, number, at_us, node=None, status=None, nodes=None):
        return {"event": json.dumps({"type": kind, "event_id": number, "at_us": at_us, "node_name": node, "status": status, "nodes": nodes, "workflow_name": "w", "duration_ms": None, "error": 'a "b"\n'})}

    machine = live.PackedState(live.ExecutionState(1000))
    machine.init(Handle())
    whole = [event("query_started", 0, 0, nodes=["n0", "z"]), *[event("node_started", i, 5_000 + i, f"n{i % 40}") for i in range(400)], event("query_completed", 501, 9_000_000, status="failed")]
    (out,) = machine.handleInputRows(("q",), iter(whole), None)
    assert calls == ["read", "register 10000", "put query", "put nodes", "put due"]
    assert (out.query_id, out.workflow_name, out.query_status, out.started_us) == ("q", "w", "failed", 0) and len(json.loads(out.nodes)) == 41
    calls.clear()
    (out,) = machine.handleInputRows(("q",), iter([event("node_completed", 500, 9_000, "n0", "failed"), event("query_completed", 502, 12_000_000, status="success")]), None)
    assert calls == ["read", "delete 10000", "register 13000", "put query", "put nodes", "put due"]
    assert out.query_status == "success" and json.loads(out.nodes)[0] == {"position": 0, "node_name": "n0", "status": "failed", "duration_ms": None, "error": 'a "b"\n'}
    calls.clear()
    assert not list(machine.handleExpiredTimer(("q",), None, None)) and calls == ["clear"] and not kept


def test_texts_pass_the_state_machine_whole(spark):
    odd = ['say "x"\n\t\\', "é雪 ", "", "null", "{[,]}"]
    rows = [(0, "query_started", "q\"1'", "2024-01-01 00:00:00", odd[0], odd, None, None, None, None)]
    rows += [(i + 1, "node_completed", "q\"1'", f"2024-01-01 00:00:0{i}", None, None, n, odd[-i - 1], 2**62 + i, n) for i, n in enumerate(odd)]
    rows += [(9, "node_started", "late", "2024-01-01 00:00:09", None, None, "n", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA.replace("ts timestamp", "ts string")).withColumn("ts", F.to_timestamp("ts"))
    got = {(r["query_id"], r["node_name"]): tuple(r)[1:] for r in run(live.live_execution(live.read_events(spark, live.write_events(df)))).select(*[c.split()[0] for c in live.STATE_COLUMNS.split(", ")]).collect()}
    want = {("q\"1'", n): (i, n, odd[-i - 1], 2**62 + i, n, odd[0], "running", 1_704_067_200_000_000) for i, n in enumerate(odd)}
    assert got == want | {("late", "n"): (None, "n", "running", None, None, None, "running", None)}
