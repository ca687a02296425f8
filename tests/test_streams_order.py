"""Streams over several micro-batches: silent sources, late rows, disorder."""

import json
import random
import time
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fairlead.operators import tracks
from fairlead.sources import sinks
from fairlead.streaming import late, ordered, sources
from fairlead.streaming.tracks import drain

T0 = datetime(2024, 1, 1)
FIX = "mmsi long, event_time timestamp, lat double, lon double, speed double"


def minute(m):
    return T0 + timedelta(minutes=m)


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def stream(spark, path, schema, per_batch=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(str(path))


# --- sources that fall silent --------------------------------------------------------------------------------------------
def two_sources(spark, tmp_path, silent_rows=True):
    schema = "mmsi long, event_time timestamp"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "b"))
    put(spark, tmp_path / "a", [(1, minute(0)), (1, minute(5))], schema)
    if silent_rows:
        put(spark, tmp_path / "b", [(2, minute(0))], schema)
    both = {n: stream(spark, tmp_path / n, schema, 10) for n in "ab"}
    return sources.merged(spark, both, "event_time", "1 minute", str(tmp_path / "beats"))


def windows(rows):
    return rows.groupBy(F.window("event_time", "1 minute")).agg(F.count("*").alias("n"))


def counts(spark, name):
    return {r.window.start: r.n for r in spark.table(name).collect()}


@pytest.mark.parametrize("ever", [True, False])
def test_a_silent_source_holds_windows_open_until_its_heartbeat(spark, tmp_path, ever):
    schema, name = "mmsi long, event_time timestamp", f"idle_{ever}"
    both = windows(two_sources(spark, tmp_path, ever))
    query = both.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        query.processAllAvailable()
        put(spark, tmp_path / "a", [(1, minute(9))], schema)
        query.processAllAvailable()
        assert counts(spark, name) == {}  # the second source is still at minute 0, or has never been seen
        sources.beat(spark, str(tmp_path / "beats"), "b", minute(9).replace(tzinfo=UTC))
        query.processAllAvailable()
        assert counts(spark, name) == {minute(0): 1 + ever, minute(5): 1}
        put(spark, tmp_path / "b", [(2, minute(8)), (2, minute(30))], schema)  # it goes on
        put(spark, tmp_path / "a", [(1, minute(30))], schema)
        query.processAllAvailable()
        assert counts(spark, name) == {minute(0): 1 + ever, minute(5): 1, minute(8): 1, minute(9): 1}
    finally:
        query.stop()


def test_rule_on_reports():
    now = [0.0]
    rule = sources.IdleRule({"a": "/in/a", "b": "/in/b"}, 30, lambda: now[0])
    report = lambda a, b, newest: {"sources": [{"description": "Files[/in/a]", "numInputRows": a}, {"description": "Files[/in/b]", "numInputRows": b}], "eventTime": {"max": newest} if newest else {}}
    assert rule.observe(report(1, 1, "2024-01-01T00:00:00.000Z")) == []
    now[0] = 20
    assert rule.observe(report(1, 0, "2024-01-01T00:10:00.000Z")) == []  # not long enough
    now[0] = 40
    assert rule.observe(report(1, 0, "2024-01-01T00:20:00.000Z")) == [("b", datetime(2024, 1, 1, 0, 20, tzinfo=UTC))]
    assert rule.observe(report(0, 0, None)) == []  # said already
    now[0] = 45
    assert rule.observe(report(1, 0, "2024-01-01T00:21:00.000Z")) == [("b", datetime(2024, 1, 1, 0, 21, tzinfo=UTC))]
    now[0] = 100
    assert rule.observe(report(0, 0, None)) == []  # both are silent: nobody is held up
    assert rule.observe(report(0, 5, "2024-01-01T00:22:00.000Z")) == [("a", datetime(2024, 1, 1, 0, 22, tzinfo=UTC))]


def test_the_watch_moves_a_running_stream(spark, tmp_path):
    schema, beats = "mmsi long, event_time timestamp", str(tmp_path / "beats")
    rows = two_sources(spark, tmp_path)
    rule = sources.IdleRule({"a": f"{tmp_path}/a", "b": f"{tmp_path}/b"}, 1.0)
    watch = sources.IdleWatch(spark, "watched", beats, rule)
    spark.streams.addListener(watch)
    query = windows(rows).writeStream.format("memory").queryName("watched").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        for m in range(6, 60):  # the first source goes on, the second one is silent
            put(spark, tmp_path / "a", [(1, minute(m))], schema)
            query.processAllAvailable()
            if minute(0) in counts(spark, "watched"):
                break
            time.sleep(0.3)
        assert counts(spark, "watched")[minute(0)] == 2
    finally:
        query.stop()
        spark.streams.removeListener(watch)


# --- late rows -----------------------------------------------------------------------------------------------------------
def test_every_row_is_on_time_or_late(spark, tmp_path):
    given = [[(1, minute(m), 1.0, 1.0, 0.0) for m in (0, 3, 10)], [(1, minute(m), 2.0, 2.0, 0.0) for m in (4, 9, 20)], [(2, minute(5), 3.0, 3.0, 0.0), (2, minute(18), 3.0, 3.0, 0.0), (2, minute(30), 3.0, 3.0, 0.0), (3, None, 3.0, 3.0, 0.0)]]
    for rows in given:
        put(spark, tmp_path / "in", rows, FIX)
        time.sleep(1.1)  # files are taken by their times
    tagged = late.tagged(stream(spark, tmp_path / "in", FIX), "event_time", "2 minutes", shares=3)
    kept, out = [], []
    both = late.to_both(tagged, lambda b, n: kept.extend((n, r.mmsi, r.event_time) for r in b.collect()), lambda b, n: out.extend((n, r.mmsi, r.event_time, r.watermark) for r in b.collect()))
    sinks.fan_out(tagged, both, str(tmp_path / "ck")).awaitTermination()
    assert sorted(r[1:] for r in kept) == [(1, minute(m)) for m in (0, 3, 9, 10, 20)] + [(2, minute(30))]
    got = {r[1:] for r in out}
    assert got == {(1, minute(4), minute(8)), (2, minute(5), minute(18)), (2, minute(18), minute(18)), (3, None, minute(18))}
    assert len(kept) + len(out) == sum(map(len, given))


def test_late_rows_as_reject_records_and_the_rest_in_windows(spark, tmp_path):
    for rows in ([(1, minute(m), 1.0, 1.0, 0.0) for m in (0, 10)], [(1, minute(1), 2.0, 2.0, 0.0), (1, minute(25), 2.0, 2.0, 0.0)], [(7, minute(2), 1.0, 1.0, 0.0), (7, minute(40), 1.0, 1.0, 0.0)]):
        put(spark, tmp_path / "in", rows, FIX)
        time.sleep(1.1)
    tagged = late.tagged(stream(spark, tmp_path / "in", FIX), "event_time", "2 minutes", shares=2)
    drain(late.quarantine_late(tagged, "PositionReport"), "rejects_t", str(tmp_path / "ck"))
    got = {r.key: json.loads(r.value) for r in spark.table("rejects_t").collect()}
    assert set(got) == {"1", "7"} and got["1"]["reason"] == "late" and json.loads(got["7"]["raw"])["lat"] == 1.0
    windowed = late.on_time(tagged, "event_time", "2 minutes").groupBy(F.window("event_time", "1 minute")).agg(F.count("*").alias("n"))
    drain(windowed, "windows_t", str(tmp_path / "ck2"))
    assert {r.window.start: r.n for r in spark.table("windows_t").collect()} == {minute(m): 1 for m in (0, 10, 25)}
    with pytest.raises(ValueError, match="watermark"):
        late.tagged(tagged, "event_time", "1 minute")


# --- disorder ------------------------------------------------------------------------------------------------------------
def test_a_shuffled_stream_gives_the_rows_of_the_table(spark, tmp_path):
    rng = random.Random(4)
    fixes = [(v, T0 + timedelta(seconds=97 * i + v), rng.random(), rng.random(), float(i)) for v in range(5) for i in range(40)] + [(9, minute(3), 1.0, 2.0, 0.0)]
    near = sorted(fixes, key=lambda r: r[1] + timedelta(minutes=rng.uniform(0, 9)))  # at most nine minutes out of order
    for i in range(0, len(near), 41):
        put(spark, tmp_path / "in", near[i : i + 41], FIX)
        time.sleep(1.1)
    beats = str(tmp_path / "beats")
    closing = sources.merged(spark, {"fixes": stream(spark, tmp_path / "in", FIX, 1000)}, "event_time", "10 minutes", beats)
    sources.beat(spark, beats, "fixes", minute(60 * 24).replace(tzinfo=UTC))  # all in one batch, and then past all
    drain(ordered.previous_in_order(closing, ready=True), "ordered_one_t", str(tmp_path / "ck1"))
    put(spark, tmp_path / "in", [(99, minute(60 * 24), 0.0, 0.0, 0.0), (None, minute(5), 0.0, 0.0, 0.0), (8, None, 0.0, 0.0, 0.0)], FIX)
    drain(ordered.previous_in_order(stream(spark, tmp_path / "in", FIX), "10 minutes"), "ordered_t", str(tmp_path / "ck"))
    columns = ["mmsi", "event_time", "lat", "prev_lat", "prev_lon", "prev_event_time", "distance_nm", "delta_h", "implied_kn"]
    want = sorted(map(tuple, tracks.enrich_track(spark.createDataFrame(fixes, FIX)).select(*columns).collect()), key=str)
    for name in ("ordered_one_t", "ordered_t"):
        assert sorted(map(tuple, spark.table(name).select(*columns).collect()), key=str) == want


def test_vessels_of_one_share_keep_their_own_previous_fixes(spark, tmp_path):
    fixes = [(v, minute(7 * i + v), float(v), float(i), 1.0) for v in range(3) for i in range(4)]
    for part in (fixes[::2], fixes[1::2]):
        put(spark, tmp_path / "in", part, FIX)
    closing = sources.merged(spark, {"fixes": stream(spark, tmp_path / "in", FIX, 1000)}, "event_time", "10 minutes", str(tmp_path / "beats"))
    sources.beat(spark, str(tmp_path / "beats"), "fixes", minute(60 * 24).replace(tzinfo=UTC))
    drain(ordered.previous_in_order(closing, ready=True, shares=1), "one_share_t", str(tmp_path / "ck"))
    got = {(r.mmsi, r.lon): (r.prev_lat, r.prev_lon) for r in spark.table("one_share_t").collect()}
    assert got == {(v, float(i)): (float(v), float(i - 1)) if i else (None, None) for v in range(3) for i in range(4)}
