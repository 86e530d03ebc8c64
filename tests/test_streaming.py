"""Debounced micro-batches: full, aged, by timer and at the close; no event is lost."""

import json
import time

import pytest

from kilnworks.streaming import jobs as J


def _write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps({"tenant": t, "topic": "quotes", "ts": ts}) for t, ts in rows))


def _ready(df):
    return sorted((r.tenant, r.reason, r.batches, r.events) for r in df.collect())


def test_full_batches_and_the_rest(spark, tmp_path):
    now = time.time()
    events, out, ck = tmp_path / "events", str(tmp_path / "out"), str(tmp_path / "ck")
    _write(events, "a.json", [("hot", now + i / 1000) for i in range(257)] + [("cold", now)] * 3)
    year = 366 * 86_400_000
    run = lambda: J.drain_debounced(J.debounce(J.read_events(spark, str(events)), 100, year), out, ck, 120)
    assert _ready(run()) == [("hot", "count", 2, 200)]
    assert _ready(J.waiting(spark, ck)) == [("cold", "close", 1, 3), ("hot", "close", 1, 57)]
    _write(events, "b.json", [("hot", now)] * 50 + [("cold", now)] * 97)  # the state goes on from the checkpoint
    assert _ready(run()) == [("cold", "count", 1, 100), ("hot", "count", 1, 100), ("hot", "count", 2, 200)]
    assert _ready(J.waiting(spark, ck)) == [("hot", "close", 1, 7)]


def test_old_events_go_at_once(spark, tmp_path):
    events = tmp_path / "events"
    _write(events, "a.json", [("t", time.time() - 7200)] * 5 + [("u", time.time())] * 4)
    ck = str(tmp_path / "ck")
    got = J.drain_debounced(J.debounce(J.read_events(spark, str(events)), 100, 3_600_000), str(tmp_path / "out"), ck, 120)
    assert _ready(got) == [("t", "age", 1, 5)] and _ready(J.waiting(spark, ck)) == [("u", "close", 1, 4)]


def test_timer_fires_for_events_that_waited(spark, tmp_path):
    events, out, ck = tmp_path / "events", str(tmp_path / "out"), str(tmp_path / "ck")
    _write(events, "a.json", [("t", time.time() + 8)] * 6)
    spark.conf.set(J.PROVIDER, J.ROCKSDB)
    ready = J.debounce(J.read_events(spark, str(events)), 100, 1000)
    q = ready.writeStream.trigger(processingTime="1 second").option("checkpointLocation", ck).format("parquet").start(out)
    try:
        until = time.time() + 90
        while time.time() < until:
            time.sleep(2)
            got = _ready(spark.read.schema(J.READY).parquet(out)) if (tmp_path / "out" / "_spark_metadata").exists() else []
            if got:
                break
        assert got == [("t", "age", 1, 6)]
    finally:
        q.stop()
        spark.conf.unset(J.PROVIDER)


def test_partial_counts_are_few(spark):
    rows = spark.range(50_000).selectExpr("if(id % 3 = 0, 'hot', concat('t', id % 7)) AS tenant", "'x' AS topic", "id * 1.0 AS ts").repartition(4)
    parts = J.partial_counts(rows).collect()
    assert len(parts) <= 4 * 8 and sum(r.n for r in parts) == 50_000 and min(r.oldest for r in parts) == 0.0
    assert J.partial_counts(rows.limit(0)).collect() == []


@pytest.mark.parametrize(("n", "oldest", "ready"), [(0, 0, False), (3, 0, True), (1, 90, False), (1, 30, True)])
def test_batch_rule(spark, n, oldest, ready):
    from pyspark.sql import functions as F
    row = spark.range(1).select(J.batch_ready(F.lit(n), F.lit(oldest), F.lit(100), 3, 60).alias("r")).first()
    assert row.r is ready
