"""The bucketed log: appended once, looked up in place."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import querylog as L
from cohortlens.sources.logstore import COLUMNS, LogStore

SCHEMA = "id string, query_text_normalized string, dataset_id string, created_at string"


def _log(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in COLUMNS])


def _rows(n=600, seed=4):
    """A third of all rows ask one text, most of them in one minute; nulls, ties and repeated days occur."""

    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot = i % 3 == 0
        text = "show me all" if hot else rng.choice([None, "", "a", "b", "c d", "null"])
        stamp = "2024-03-01T10:15:%02d+00:00" % rng.randrange(60) if hot and rng.random() < 0.7 else "2024-0%d-%02dT%02d:%02d:00+00:00" % (
            rng.randrange(1, 4), rng.randrange(1, 6), rng.randrange(3), rng.randrange(4))
        rows.append((f"r{i:04d}", text, rng.choice(["x", "x", None]), None if rng.random() < 0.02 else stamp))
    return rows


def _earlier(rows):
    """The previous row of the same key, by hand; a null time comes first."""

    out, last = {}, {}
    for r in sorted(rows, key=lambda r: (r[3] is not None, r[3] or "", r[0])):
        out[r[0]] = last.get(r[1:3])
        last[r[1:3]] = r[0]
    return out


def _got(df):
    return {r.request_id: r.cached_id for r in df.collect()}


@pytest.fixture
def store(spark, tmp_path):
    s = LogStore(spark, f"log_{tmp_path.name}", str(tmp_path / "log"), buckets=4)
    yield s
    spark.sql(f"DROP TABLE IF EXISTS {s.name}")


def test_reuse_by_hand(spark, store):
    rows = _rows()
    assert _got(L.log_reuse(_log(spark, rows))) == _earlier(rows)
    store.append(_log(spark, rows[:350]), "run", "1")
    store.append(_log(spark, rows[350:]), "run", "2")
    assert _got(L.log_reuse(store.rows())) == _earlier(rows)
    assert L.log_reuse(_log(spark, rows[:0])).count() == 0


def test_stored_log_rows_are_not_exchanged(spark, store):
    store.append(_log(spark, _rows()), "run", "1")
    old = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for c, v in zip(old, ("-1", "false")):
            spark.conf.set(c, v)
        lines = L.log_reuse(store.rows())._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)

    def depth(line):
        return re.search(r"[A-Za-z*]", line).start()

    at = next(i for i, line in enumerate(lines) if "FileScan" in line and "query_text_normalized" in line)
    level, above = depth(lines[at]), []
    for line in reversed(lines[:at]):
        if depth(line) < level:
            level = depth(line)
            above.append(line)
    assert any("Window" in a for a in above) and any("SortMergeJoin" in a for a in above)
    assert not any("Exchange" in a for a in above)
    assert any("Exchange" in line for line in lines)  # the small rows of keys and minutes move


def test_repeated_and_resumed_batches(spark, store, tmp_path):
    rows = _rows(90)
    log = _log(spark, rows)
    assert store.append(log, "run", "1") and not store.append(log, "run", "1")
    assert store.rows().count() == 90
    assert store.append(log.limit(0), "run", "none") and not store.append(log, "run", "none")
    assert store.append(log, "ru", "n1") and store.rows().count() == 180  # another run's rows are others
    # a writer lost after a part of its batch was committed: begun, not complete
    whole = store._touch
    store._touch = lambda *parts: None if parts[0] == "complete" else whole(*parts)
    store.append(_log(spark, rows[:40]), "run", "3")
    store._touch = whole
    assert store.append(log, "run", "3") and store.rows().count() == 270
    assert store.rows().where("batch = '3'").select("id").distinct().count() == 90
    assert not store.append(log, "run", "3")


def test_reopened(spark, store):
    rows = _rows(120)
    store.append(_log(spark, rows), "run", "1")
    spark.sql(f"DROP TABLE {store.name}")
    again = LogStore(spark, store.name, store.path, buckets=4)
    assert again.rows().count() == 120 and not again.append(_log(spark, rows), "run", "1")
    assert _got(L.log_reuse(again.rows())) == _earlier(rows)
    for other in ({"buckets": 8}, {"buckets": 4, "period": "month"}):
        with pytest.raises(ValueError):
            LogStore(spark, "other", store.path, **other)


def test_months(spark, tmp_path):
    rows = _rows(150)
    store = LogStore(spark, f"months_{tmp_path.name}", str(tmp_path / "log"), buckets=3, period="month")
    store.append(_log(spark, rows), "run", "1")
    assert {r.period for r in store.rows().select("period").distinct().collect()} == {r[3] and r[3][:7] for r in rows}
    assert _got(L.log_reuse(store.rows())) == _earlier(rows)
    spark.sql(f"DROP TABLE {store.name}")
