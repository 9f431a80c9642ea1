"""Traces as a stream against the same rows at once."""

import random
import time

import pytest

from quillstone.operators import prompts
from quillstone.streaming import traces

pytest.importorskip("google.protobuf")


@pytest.fixture
def rocks(spark):
    before = {k: spark.conf.get(k, None) for k in traces.STATE}
    for k, v in traces.STATE.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run(spark, tmp_path, wait=0.0, **limits):
    """What has come is taken; timers need a query that goes on, so it is stopped and not awaited."""
    stream = spark.readStream.schema(traces.EVENTS).parquet(str(tmp_path / "in"))
    out = traces.traced(stream, **limits).writeStream.foreachBatch(lambda df, n: df.write.mode("append").parquet(str(tmp_path / "out"))).outputMode("update")
    query = out.option("checkpointLocation", str(tmp_path / "at")).trigger(processingTime="1 second").start()
    ends = time.time() + 100  # a query with timers always has a next batch, so what it has read is counted
    while time.time() < ends and not any(p["numInputRows"] for p in query.recentProgress):
        assert query.exception() is None
        time.sleep(0.2)
    time.sleep(wait)
    query.stop()
    return {r.request_id: r for r in traces.last_versions(spark.read.parquet(str(tmp_path / "out"))).collect()}


def put(spark, tmp_path, rows):
    spark.createDataFrame(rows, traces.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def test_any_order_gives_what_a_batch_gives(rocks, tmp_path):
    from datetime import datetime, timedelta

    rng, t0 = random.Random(1), datetime(2024, 1, 1)
    rows = []
    for i in range(12):
        rows.append((f"r{i}", "start", t0 + timedelta(seconds=i), f"p{i}", None, None, None))
        for n in range(rng.randrange(0, 3)):
            rows.append((f"r{i}", "end", t0 + timedelta(seconds=i + n + 1, milliseconds=250), None, f"c{n}", 10 * n, "bad" if rng.random() < 0.3 else None))
    rows += [("alone", "end", t0, None, "c", 1, None), (None, "start", t0, "p", None, None, None)]
    rng.shuffle(rows)
    for i in range(0, len(rows), 20):
        put(rocks, tmp_path, rows[i : i + 20])
        got = run(rocks, tmp_path)
    all_ = rocks.createDataFrame(rows, traces.EVENTS)
    starts = all_.where("kind = 'start' and request_id is not null").selectExpr("request_id", "at as start_time", "prompt")
    ends = all_.where("kind = 'end'").selectExpr("request_id", "at as end_time", "content", "total_tokens", "error")
    names = ["request_id", "start_time", "end_time", "prompt", "content", "total_tokens", "error", "duration_ms"]
    assert {tuple(r[n] for n in names) for r in got.values()} == {tuple(r[n] for n in names) for r in prompts.traces(starts, ends).collect()}


def test_open_requests_expire_and_late_ends_count(rocks, tmp_path):
    from datetime import datetime

    put(rocks, tmp_path, [("a", "start", datetime(2024, 1, 1), "p", None, None, None)])
    got = run(rocks, tmp_path, wait=12, expiry_ms=500)
    assert got["a"].error == traces.EXPIRED and got["a"].end_time is None
    put(rocks, tmp_path, [("a", "end", datetime(2024, 1, 1, 0, 0, 2), None, "late", 5, None)])
    got = run(rocks, tmp_path, expiry_ms=3_600_000)
    assert (got["a"].content, got["a"].error, got["a"].duration_ms) == ("late", None, 2000.0)
