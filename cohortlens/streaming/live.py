"""Live execution state (K1, K2): a keyed state machine over the event stream.

Every query has a state of its own: its node list, the newest known state of each node
(pending, running, success or failed) and its own status. Events may come in any order
and over any files: a node's state is the one of its newest event (start before end at
one instant), and a node that runs again is running again. A finished query leaves the
state by an event-time timer, ``keep`` after its end; as no event of it can be later
than its end, the watermark has by then closed it. So the state holds the open queries
and those just finished, not the history, and a query's state is bounded by its nodes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cohortlens import session

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
STATE_COLUMNS = "query_id string, position int, node_name string, status string, duration_ms bigint, error string, workflow_name string, query_status string, started_us bigint"
STATE = Row(*[c.split()[0] for c in STATE_COLUMNS.split(", ")])
KEYS = ["query_id", "node_name"]
EVENT_COLUMNS = ["type", "event_id", "at_us", "workflow_name", "nodes", "node_name", "status", "duration_ms", "error"]
NODE_COLUMNS = "position int, node_name string, status string, duration_ms bigint, error string"
#: A call's states as one row, the nodes as text.
PACKED_COLUMNS = "query_id string, workflow_name string, query_status string, started_us bigint, nodes string"
PACKED = Row(*[c.split()[0] for c in PACKED_COLUMNS.split(", ")])
#: At one instant a run's end comes after its start.
RANK = {"node_started": 0, "node_completed": 1}


class ExecutionState(StatefulProcessor):
    """One query's nodes, kept as one value beside the query's own: a call reads and
    writes each once at most, whatever the number of nodes. ``keep_ms``: how long a
    finished query stays."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.query = handle.getValueState("query", "workflow_name string, nodes array<string>, started_us bigint, status string, ended_us bigint")
        node = "struct<node_name:string,at_us:bigint,rank:int,event_id:bigint,status:string,duration_ms:bigint,error:string>"
        self.nodes = handle.getValueState("nodes", f"nodes array<{node}>")
        self.due = handle.getValueState("due", "at_ms bigint")  # the timer of a finished query

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        query = self.query.get()
        workflow, planned, started, status, ended = query or (None, [], None, None, None)
        planned, finished = list(planned), ended
        seen = self.nodes.get() if query else None
        known = {v[0]: tuple(v[1:]) for v in seen[0]} if seen else {}
        changed = False
        for e in rows:
            kind, at = e["type"], e["at_us"]
            if kind == "query_started":
                workflow, planned, started = e["workflow_name"], list(e["nodes"] or []), at
            elif kind == "query_completed":
                status, ended = e["status"], at
            elif kind in RANK:
                now = (at, RANK[kind], e["event_id"], "running" if kind == "node_started" else e["status"], e["duration_ms"], e["error"])
                name = e["node_name"]
                if name not in known or now[:3] > known[name][:3]:
                    known[name], changed = now, True
        if query is None or (workflow, planned, started, status, ended) != (query[0], list(query[1]), *query[2:]):
            self.query.update((workflow, planned, started, status, ended))
        if changed:
            self.nodes.update(([(name, *v) for name, v in known.items()],))
        if ended != finished:
            if finished is not None:
                self.handle.deleteTimer(self.due.get()[0])
            self.due.update((ended // 1000 + self.keep_ms,))
            self.handle.registerTimer(ended // 1000 + self.keep_ms)
        names = [*planned, *sorted(known.keys() - set(planned))]
        idle = (None, None, None, "pending", None, None)
        for i, name in enumerate(names):
            yield STATE(key[0], i if name in planned else None, name, *known.get(name, idle)[3:], workflow, status or "running", started)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        for state in (self.query, self.nodes, self.due):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


class Whole:
    """The values of a state machine, each a text in one map of a key: they are read
    together when the machine first asks for one, a changed one is written once, by
    ``flush``, and they are cleared together."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.kept = handle.getMapState("whole", "name string", "value string")
        self.names: list[str] = []
        self.begin()

    def begin(self) -> None:
        self.parts: dict | None = None
        self.new: dict = {}

    def part(self, name: str) -> Part:
        self.names.append(name)
        return Part(self, name)

    def get(self, name: str):
        if name in self.new:
            return self.new[name]
        if self.parts is None:
            self.parts = {k[0]: json.loads(v[0]) for k, v in self.kept.iterator()}
        return self.parts.get(name)

    def flush(self) -> None:
        if self.new and all(name in self.new and self.new[name] is None for name in self.names):
            self.kept.clear()
            return
        for name, value in self.new.items():
            if value is not None:
                self.kept.updateValue((name,), (json.dumps(value, separators=(",", ":")),))
            else:
                self.kept.removeKey((name,))


class Part:
    """One of the machine's values."""

    def __init__(self, whole: Whole, name: str):
        self.whole, self.name = whole, name

    def get(self):
        return self.whole.get(self.name)

    def update(self, value: tuple) -> None:
        self.whole.new[self.name] = value

    def clear(self) -> None:
        self.whole.new[self.name] = None


class PackedState(StatefulProcessor):
    """Runs a state machine for one exchange of each kind with the state store: its
    values are read and written as one, an event comes as one text, and the states that a
    call gives leave as one row."""

    def __init__(self, machine: ExecutionState):
        self.machine = machine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.whole = handle, Whole(handle)
        self.machine.init(self)

    def getValueState(self, name: str, schema: str) -> Part:
        return self.whole.part(name)

    def registerTimer(self, at_ms: int) -> None:
        self.handle.registerTimer(at_ms)

    def deleteTimer(self, at_ms: int) -> None:
        self.handle.deleteTimer(at_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        self.whole.begin()
        states = list(self.machine.handleInputRows(key, (json.loads(r["event"]) for r in rows), timerValues))
        self.whole.flush()
        if states:
            nodes = [{"position": s[1], "node_name": s[2], "status": s[3], "duration_ms": s[4], "error": s[5]} for s in states]
            yield PACKED(key[0], *states[0][6:], json.dumps(nodes, separators=(",", ":")))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.whole.begin()
        states = list(self.machine.handleExpiredTimer(key, timerValues, expiredTimerInfo))
        self.whole.flush()
        return iter(states)

    def close(self) -> None:
        self.machine.close()


def live_execution(events: DataFrame, late: str = "1 day", keep_ms: int = 3_600_000) -> DataFrame:
    """K2: STATE_COLUMNS of every query that an event touches (update mode). Events
    later than ``late`` behind the newest are dropped; choose it by the source."""

    seen = events.withWatermark("ts", late).withColumn("at_us", F.unix_micros("ts"))
    seen = seen.select("query_id", "ts", F.to_json(F.struct(*EVENT_COLUMNS), {"ignoreNullFields": "false"}).alias("event"))
    packed = seen.groupBy("query_id").transformWithState(
        statefulProcessor=PackedState(ExecutionState(keep_ms)), outputStructType=PACKED_COLUMNS, outputMode="Update", timeMode="EventTime")
    names = [c.split()[0] for c in STATE_COLUMNS.split(", ")]
    return packed.select("query_id", "workflow_name", "query_status", "started_us", F.inline(F.from_json("nodes", f"array<struct<{NODE_COLUMNS}>>"))).select(*names)


def write_events(events: DataFrame, files: int | None = None) -> str:
    """K1: the event log as an append-only folder in the shared folder; ``drop_materialized``
    deletes it. ``files`` deals the events to as many files."""

    spark: SparkSession = events.sparkSession
    path = f"{session.ensure_checkpoint_dir(spark).rstrip('/')}/cohortlens-tables/execution-events-{uuid.uuid4().hex}"
    (events.repartition(files, "event_id") if files else events).write.parquet(path)
    session.remember(spark, path)
    return path


def read_events(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def active_query(states: DataFrame) -> DataFrame:
    """The nodes of the query that started last (ties: the larger id), in its order."""

    last = states.agg(F.max(F.struct("started_us", "query_id")).alias("q")).select(F.col("q.query_id").alias("query_id"))
    return states.join(F.broadcast(last), "query_id")  # one row
