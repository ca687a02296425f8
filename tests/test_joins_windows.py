from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fairlead.operators import joins, windows

RELAXED = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
T0 = datetime(2024, 1, 1)


@RELAXED
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(0, 30)), max_size=30), st.lists(st.tuples(st.integers(1, 3), st.integers(0, 30)), max_size=15, unique=True))
def test_asof_equals_intervals_and_brute_force(spark, left, right):
    a = spark.createDataFrame([(i, k, T0 + timedelta(hours=h)) for i, (k, h) in enumerate(left)], "id long, k long, t timestamp")
    b = spark.createDataFrame([(k, T0 + timedelta(hours=h), 100 * k + h) for k, h in right], "k long, at timestamp, v long")
    versions = joins.version_intervals(b, "k", "at", "v")
    got = {r.id: r.v for r in joins.asof_join(a, versions, "k", "t", "at", ["v"]).collect()}
    other = {r.id: r.v for r in joins.interval_join(a, versions, "k", "t", "at", "valid_to", ["v"]).collect()}
    want = {i: max((100 * k + h for k2, h in right if k2 == k and h <= t), default=None) for i, (k, t) in enumerate(left)}
    assert got == other == want


def test_asof_ignores_null_keys_and_times(spark):
    a = spark.createDataFrame([(1, None, T0), (2, 1, None), (3, 1, T0)], "id long, k long, t timestamp")
    b = spark.createDataFrame([(None, T0, 5), (1, None, 6), (1, T0, 7)], "k long, at timestamp, v long")
    assert {r.id: r.v for r in joins.asof_join(a, b, "k", "t", "at", ["v"]).collect()} == {1: None, 2: None, 3: 7}


def test_nearest_prefers_the_earlier_on_ties(spark):
    a = spark.createDataFrame([(1, "x", T0 + timedelta(hours=5)), (2, "y", T0)], "id long, k string, t timestamp")
    b = spark.createDataFrame([("x", T0 + timedelta(hours=4), 1), ("x", T0 + timedelta(hours=6), 2), ("y", T0 + timedelta(days=9), 3)], "k string, at timestamp, v long")
    assert {r.id: r.v for r in joins.nearest_time_join(a, b, ["k"], "t", "at", ["v"], "id").collect()} == {1: 1, 2: None}


def test_upsert_and_insert(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    u = spark.createDataFrame([(2, "B"), (3, "C"), (3, "D")], "k long, v string")
    assert sorted(map(tuple, joins.upsert(t, u, "k").collect())) == [(1, "a"), (2, "B"), (3, "D")]
    assert sorted(map(tuple, joins.insert_ignore(t, u, "k").collect())) == [(3, "C")]


def test_segments_credit_only_continuous_intervals(spark):
    minutes = [0, 10, 20, 60, 70, 80]
    on = [True, True, False, True, True, None]
    d = spark.createDataFrame([("v", T0 + timedelta(minutes=m), s) for m, s in zip(minutes, on)], "k string, t timestamp, on boolean")
    rows = windows.segments(d, ["k"], "t", F.col("on"), 30).orderBy("t").collect()
    assert [(r.segment_id, r.interval_s) for r in rows] == [(1, 600), (1, 0), (2, 600), (2, 0)]


def test_sessions_chain_by_neighbours(spark):
    d = spark.createDataFrame([("a", 1, T0), ("b", 1, T0 + timedelta(hours=20)), ("c", 1, T0 + timedelta(hours=43)), ("d", 1, T0 + timedelta(hours=68))], "event_id string, k int, t timestamp")
    got = {r.event_id: r.session_id for r in windows.assign_session(d, ["k"], "t", "event_id").collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d"}
    assert windows.top_k(d, ["k"], [F.desc("t")], 2).count() == 2


def test_zip_of_unequal_series_is_null(spark):
    d = spark.createDataFrame([([1, 2], [3, 4]), ([1], [2, 3])], "a array<int>, b array<int>")
    got = [r[0] for r in d.select(joins.zip_series("a", "b")).collect()]
    assert [tuple(x) for x in got[0]] == [(1, 3), (2, 4)] and got[1] is None


def test_orderings_and_flags(spark):
    d = spark.createDataFrame([(1, "JIT", 2.0, None), (2, "NO_JIT", None, True), (3, "NO_JIT", 1.0, False), (4, "JIT", 2.0, False), (5, None, 9.0, None)], "id int, kind string, wait double, bad boolean")
    ids = lambda x: [r.id for r in x.collect()]
    assert ids(windows.longest_wait_first(d, "wait", "id")) == [5, 1, 4, 3, 2]
    assert ids(windows.by_priority(d, "kind", ["NO_JIT"], "wait", "id")) == [3, 2, 5, 1, 4]
    assert ids(windows.in_session_order(d, "kind", "wait", "id")) == [5, 1, 4, 2, 3]
    flags = {r.kind: r.any_flagged for r in windows.any_flagged(d, ["kind"], F.col("bad")).collect()}
    assert flags == {"JIT": False, "NO_JIT": True, None: False}
    assert windows.any_flagged(d.limit(0), ["kind"], F.col("bad")).count() == 0
