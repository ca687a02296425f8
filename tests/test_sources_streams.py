import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlead.operators import tracks
from fairlead.sources import contracts, files, silver, sinks
from fairlead.streaming import tracks as streams

T0 = datetime(2024, 1, 1)


def envelope(kind="PositionReport", meta=None, **body):
    return json.dumps({"MessageType": kind, "MetaData": {"MMSI": 224000001, "time_utc": "2026-07-28 17:13:08.6 +0000 UTC"} | (meta or {}), "Message": {kind: body}})


def test_contract_types():
    s = contracts.contract_schema({"fields": [{"name": "a", "type": ["null", "double"]}, {"name": "b", "type": "long"}, {"name": "c", "type": ["null"]}, {"name": "d", "type": {"type": "enum"}}, {"name": "e", "type": "bytes"}]})
    assert [f.dataType for f in s] == [T.DoubleType(), T.LongType(), T.StringType(), T.StringType(), T.BinaryType()]


def test_positions(spark):
    raw = [envelope(Latitude=36.0, Longitude=-5.0, Sog=3.0), envelope(Latitude=120.0, Longitude=-5.0, Sog=3.0), envelope(meta={"MMSI": 0}, UserID=7, Latitude=1.0, Longitude=1.0, Sog=0.0), envelope(meta={"MMSI": 0, "time_utc": ""}, Latitude=1.0, Longitude=1.0, Sog=-1.0), "{oops", envelope("Other")]
    m = contracts.parse_messages(spark.createDataFrame([(x,) for x in raw], "value string"))
    good, bad = contracts.positions(m)
    assert sorted(r.mmsi for r in good.collect()) == [7, 224000001]
    assert sorted(r.reasons for r in bad.collect()) == [["lat"], ["mmsi", "timestamp", "speed"]]
    assert {r.message_type: r.messages for r in contracts.message_counts(m).collect()} == {"PositionReport": 4, "Other": 1, "unreadable": 1}
    rec = {r.key: json.loads(r.value) for r in contracts.reject_records(bad, "PositionReport").collect()}
    assert rec["224000001"]["reason"] == "lat" and rec[None]["message_type"] == "PositionReport"


def test_topic_values_into_contract_columns(spark):
    contract = {"fields": [{"name": "mmsi", "type": "long"}, {"name": "lat", "type": ["null", "double"]}, {"name": "kind", "type": "string", "default": "ais"}, {"name": "raw_name", "type": ["null", "string"]}]}
    values = [b'{"mmsi": 1, "lat": 2.5, "kind": "x", "more": 1}', b'{"mmsi": 2}', b'{"lat": 1.0}', b"oops", None, b"[1]"]
    rows = spark.createDataFrame([(v, i, "c") for i, v in enumerate(values)], "value binary, _offset long, mmsi string")
    good, bad = contracts.split(contracts.decoded(rows, contract))
    assert good.columns == ["_offset", "raw", "mmsi", "lat", "kind", "raw_name"]
    assert sorted((r._offset, r.mmsi, r.lat, r.kind) for r in good.collect()) == [(0, 1, 2.5, "x"), (1, 2, None, "ais")]
    assert sorted((r._offset, r.reasons) for r in bad.collect()) == [(2, ["mmsi"]), (3, ["value"]), (4, ["value"]), (5, ["value"])]
    plan = contracts.decoded(rows, contract)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_static(spark):
    raw = envelope("ShipStaticData", UserID=5, ImoNumber=0, Name="ALGECIRAS@@@@", Type=70, Dimension={"A": 150, "B": 50, "C": 20, "D": 10}, MaximumStaticDraught=12.344, Destination="@@@", Eta={"Month": 1, "Day": 2, "Hour": 3, "Minute": 4})
    r = contracts.static_data(contracts.parse_messages(spark.createDataFrame([(raw,)], "value string")))[0].first()
    assert (r.mmsi, r.imo, r.name, r.length_m, r.beam_m, r.draught_m, r.destination) == (5, None, "ALGECIRAS", 200, 30, 12.34, None)
    assert r.eta == '{"Day":2,"Hour":3,"Minute":4,"Month":1}'


def test_select_area_limits_vessels(spark):
    with pytest.raises(ValueError):
        contracts.select_area(spark.range(1), [], list(range(51)))


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text('{"x": 1}\n{"x": 2}{"x": 3}   {"x": 4}')
    got = files.joined_objects(spark, str(tmp_path / "a.txt"), T.StructType([T.StructField("x", T.IntegerType())]), 1, 2)
    assert [r.o.x for r in got.orderBy("idx").collect()] == [2, 3]
    (tmp_path / "b.txt").write_text('{"s": "x} {y", "o": {"p": 1}}\n {"s": "a\\"} {", "o": {"p": 2}}{"s": "", "o": {}}')
    o = files.joined_objects(spark, str(tmp_path / "b.txt"), "s string, o struct<p: int>")
    assert [(r.o.s, r.o.o.p) for r in o.orderBy("idx").collect()] == [("x} {y", 1), ('a"} {', 2), ("", None)]
    (tmp_path / "r.csv").write_text("Title,,\nIMO Number,Name,Total fuel\n9000001,A,5\n9000002,B,6\n")
    r = files.register_csv(spark, str(tmp_path / "r.csv"))
    assert r.columns == ["IMO Number", "Name", "Total fuel"] and r.count() == 2
    ports = spark.createDataFrame([("ES", "ALG", "Algeciras", "1-------", "36.13,-5.45"), ("ES", "", "None", "1", "1,1"), ("ES", "XXX", "Rail", "-2", "1,1"), ("ES", "BAD", "Bad", "1", "x")], "Country string, Location string, Name string, Function string, CoordinatesDecimal string")
    assert [tuple(r) for r in files.sea_ports(ports).collect()] == [("ESALG", "Algeciras", 36.13, -5.45)]
    with pytest.raises(RuntimeError, match="nothere"):
        files.require_tables(spark, "nothere")
    h = spark.createDataFrame([([("correlation_id", b"a"), ("correlation_id", b"b")],), ([],)], "headers array<struct<key:string,value:binary>>")
    assert [r[0] for r in h.select(files.header("headers", "correlation_id")).collect()] == ["b", None]


def test_partitioned_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, "2024-01-01", "a"), (2, "2024-01-02", "b")], "id long, _dt string, v string")
    d.write.parquet(str(tmp_path / "in"))
    q = sinks.daily_files(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    back = files.all_files(spark, str(tmp_path / "out"))
    assert sorted((r.id, str(r.partition_date)) for r in back.collect()) == [(1, "2024-01-01"), (2, "2024-01-02")]
    e = spark.createDataFrame([("x", T0, 1), ("x", T0, 1), ("y", T0 + timedelta(days=1), 2)], "event_id string, emitted_at timestamp, v int")
    assert sinks.publish(e, "recommendations_t", str(tmp_path / "docs")) == 2
    assert sinks.publish(e, "recommendations_t", str(tmp_path / "docs")) == 0
    assert spark.read.json(str(tmp_path / "docs")).count() == 2
    sinks.upsert_table(spark.createDataFrame([(1, "a")], "k int, v string"), "ports_t", "k")
    sinks.upsert_table(spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string"), "ports_t", "k")
    assert sorted((r.k, r.v) for r in spark.table("ports_t").collect()) == [(1, "b"), (2, "c")]
    sinks.create_table(spark, "notes_t", {"k": ("int", "it's a key")})
    sinks.create_table(spark, "notes_t", {"k": ("int", "again")})
    assert spark.table("notes_t").columns == ["k"]


def test_swap_and_compaction_keep_rows(spark, tmp_path):
    row = lambda k, v: spark.createDataFrame([(k, v)], "k int, v string")
    sinks.upsert_table(row(1, "a"), "swap_t", "k")
    spark.sql("ALTER TABLE swap_t RENAME TO swap_t__previous")  # as a call leaves it that ends between two steps
    sinks.upsert_table(row(2, "b"), "swap_t", "k")
    assert sorted((r.k, r.v) for r in spark.table("swap_t").collect()) == [(1, "a"), (2, "b")]
    assert not spark.catalog.tableExists("swap_t__previous")
    path = str(tmp_path / "days")
    d = spark.range(40).selectExpr("id", "concat('2024-01-0', id % 2 + 1) AS _dt").repartition(8)
    d.write.partitionBy("_dt").parquet(path)
    sinks.compact_day(spark, path, "_dt")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(40))
    assert all(len(list(f.glob("*.parquet"))) == 1 for f in (tmp_path / "days").glob("_dt=*"))


def test_messages_are_parsed_once(spark):
    raw = spark.createDataFrame([(envelope(Latitude=36.0, Longitude=-5.0, Sog=3.0),)], "value string")
    plan = contracts.checked_positions(contracts.parse_messages(raw))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_dated_documents_keep_earlier_batches(spark, tmp_path):
    path = str(tmp_path / "dated")
    event = lambda *keys: spark.createDataFrame([(k, T0, i) for i, k in enumerate(keys)], "event_id string, emitted_at timestamp, v int")
    stored = lambda: sorted(r.event_id for r in spark.read.json(path).collect())
    sinks.dated_documents(event("a"), path)
    sinks.dated_documents(event("b", "a"), path)
    assert stored() == ["a", "b"]
    sinks.dated_documents(event("b", "a"), path)  # a replay
    sinks.dated_documents(event("c"), path, batch="7")
    sinks.dated_documents(event("c", "d"), path, batch="7")
    assert stored() == ["a", "b", "c", "d"]


def batches(spark, tmp_path, name, rows, schema, per_file=1):
    """Rows as files that a stream reads one at a time."""
    path = tmp_path / name
    for i, chunk in enumerate(rows):
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(spark.read.parquet(str(path)).schema).option("maxFilesPerTrigger", per_file).parquet(str(path))


def test_previous_fix_is_kept_between_batches(spark, tmp_path):
    schema = "mmsi long, event_time timestamp, lat double, lon double, speed double, nav_status int"
    rows = [[(1, T0, 0.0, 0.0, 1.0, 0), (1, T0 + timedelta(hours=1), 0.0, 1.0, 1.0, 0)], [(1, T0 + timedelta(hours=2), 0.0, 2.0, 1.0, 0), (2, T0, 5.0, 5.0, 1.0, 0)]]
    s = streams.previous_fix(batches(spark, tmp_path, "fix", rows, schema))
    streams.drain(s, "previous_fix_t", str(tmp_path / "ckf"))
    got = {(r.mmsi, r.event_time): r for r in spark.table("previous_fix_t").collect()}
    assert len(got) == 4 and got[1, T0].prev_lon is None
    assert {got[1, T0 + timedelta(hours=h)].prev_lon for h in (1, 2)} == {0.0, 1.0}
    assert got[1, T0 + timedelta(hours=2)].implied_kn == pytest.approx(60.04, abs=0.01)


def test_windowed_summary_equals_the_batch_on_closed_windows(spark, tmp_path):
    schema = "mmsi long, event_time timestamp, lat double, lon double, speed double, nav_status int"
    rows = [[(i % 4, T0 + timedelta(seconds=20 * i), 36.13, -5.42, 0.0, (5, 1)[i % 2]) for i in range(30)]]
    port = {"port_name": F.lit("ALGECIRAS"), "port_lat": F.lit(36.12972), "port_lon": F.lit(-5.42278), "port_radius_nm": F.lit(5.0), "length_m": F.lit(100), "ship_type": F.lit(70)}
    stream = batches(spark, tmp_path, "port", rows, schema).withColumns(port)
    streams.drain(streams.windowed_summary(stream), "summary_t", str(tmp_path / "cks"))
    live = {r.window.start: (r.congested_count, r.atracados_json) for r in spark.table("summary_t").collect()}
    d = spark.read.parquet(str(tmp_path / "port")).withColumns(port)
    batch = {r.window.start: (r.congested_count, r.atracados_json) for r in tracks.port_summary(tracks.unique_inventory(tracks.port_inventory(d))).collect()}
    assert live and all(batch[w] == v for w, v in live.items())


def test_static_join_and_dedup(spark, tmp_path):
    p = batches(spark, tmp_path, "p", [[(1, T0 + timedelta(days=2)), (1, T0 + timedelta(days=40))]], "mmsi long, event_time timestamp")
    s = batches(spark, tmp_path, "s", [[(1, T0, "a"), (1, T0 + timedelta(days=1), "b")]], "mmsi long, _ingestion_time timestamp, name string")
    streams.drain(streams.with_static(p, s), "joined_t", str(tmp_path / "ckj"))
    assert sorted(r.name for r in spark.table("joined_t").collect()) == ["a", "b"]
    m = batches(spark, tmp_path, "m", [[(0, 1, T0), (0, 1, T0)], [(0, 1, T0), (0, 2, T0)]], "_partition long, _offset long, _ingestion_time timestamp")
    streams.drain(streams.distinct_messages(m), "distinct_t", str(tmp_path / "ckd"))
    assert spark.table("distinct_t").count() == 2


def test_fan_out(spark, tmp_path):
    src = batches(spark, tmp_path, "fan", [[(1,), (2,)]], "id long")
    seen = []
    sinks.fan_out(src, [lambda b, n: seen.append(b.count()), lambda b, n: seen.append(b.where("id > 1").count())], str(tmp_path / "ckfan")).awaitTermination()
    assert seen == [2, 1]


def test_silver_tables(spark):
    names = "mmsi long, name string, callsign string, destination string, imo long, ship_type int, length_m int, beam_m int, draught_m double, eta string, timestamp string, lat double, lon double, speed double, cog double, heading int, nav_status int"
    technical = "correlation_id string, _kafka_ingestion_time timestamp, _kafka_partition long, _kafka_offset long, _schema_version long, source_file string"
    row = lambda offset, **kw: {"mmsi": 1, "name": " A ", "callsign": " ", "destination": "es-alg", "timestamp": "2024-02-01T10:00:00+00:00", "lat": 36.0, "lon": -5.0, "correlation_id": "c", "_kafka_partition": 0, "_kafka_offset": offset, "source_file": "/b/_dt=2024-02-01/f"} | kw
    rows = [row(1), row(1), row(2, speed=-1.0), row(3, lat=None), row(4, timestamp="soon"), row(5, mmsi=None), row(6, source_file="/b/_dt=2023-12-31/f"), row(7, source_file="/b/f"), row(8, speed=0.0)]
    d = spark.createDataFrame(rows, f"{names}, {technical}")
    got = silver.silver_positions(d, "2024-01-01").collect()
    assert sorted(r.kafka_offset for r in got) == [1, 8] and {str(r.event_date) for r in got} == {"2024-02-01"}
    s = {r.kafka_offset: r for r in silver.silver_static(d, "2024-01-01").collect()}
    assert sorted(s) == [1, 2, 3, 4, 8] and (s[1].vessel_name, s[1].call_sign, s[1].destination_clean) == ("A", None, "ESALG")
    assert silver.silver_positions(d.limit(0), "2024-01-01").count() == 0


def test_alerts_of_a_window_over_two_batches_equal_the_table(spark, tmp_path):
    schema = "mmsi long, correlation_id string, event_time timestamp, lat double, lon double, speed double, nav_status int"
    moored = lambda n, s: (n, f"m{n}-{s}", T0 + timedelta(seconds=s), 36.13, -5.42, 0.0, 5)
    inbound = lambda s: (99, f"i{s}", T0 + timedelta(seconds=s), 36.13, -5.2, 12.0, 0)
    # Each batch alone holds half of the moored vessels.
    half = 3
    rows = [[moored(n, 5) for n in range(half)] + [inbound(10)], [moored(n, 30) for n in range(half - 1, 2 * half)] + [inbound(40)], [inbound(86_400 * 3)]]
    port = {"port_name": F.lit("ALGECIRAS"), "port_lat": F.lit(36.12972), "port_lon": F.lit(-5.42278), "port_radius_nm": F.lit(5.0), "length_m": F.lit(100), "ship_type": F.lit(70)}
    stream = batches(spark, tmp_path, "alerts", rows, schema).withColumns(port)
    streams.drain(streams.windowed_alerts(stream).select("correlation_id", "congested_count", "payload_json"), "alerts_t", str(tmp_path / "cka"))
    table = spark.read.parquet(str(tmp_path / "alerts")).withColumns(port)
    inventory = tracks.unique_inventory(tracks.port_inventory(table), 1)
    want = tracks.eta_alerts(tracks.eta_candidates(tracks.dynamic_eta(table), 1), tracks.port_summary(inventory))
    want = [tuple(r) for r in want.select("correlation_id", "congested_count", "payload_json").collect()]
    assert len(want) == 1 and want[0][:2] == ("i10", 2 * half)
    assert [tuple(r) for r in spark.table("alerts_t").collect()] == want
