import json

import pytest
from pyspark.sql import functions as F

from fairlead.operators import tracks

FIX = "mmsi long, event_time string, lat double, lon double, speed double, nav_status int"


def fixes(spark, rows):
    return spark.createDataFrame(rows, FIX).withColumn("event_time", F.to_timestamp("event_time"))


def test_jump_needs_more_than_the_threshold_and_time(spark):
    t = tracks.enrich_track(fixes(spark, [(1, "2024-01-01 00:00:00", 0.0, 0.0, 1.0, 0), (1, "2024-01-01 01:00:00", 0.0, 0.5, 1.0, 0), (1, "2024-01-01 02:00:00", 0.0, 2.0, 1.0, 0), (2, "2024-01-01 00:00:00", 5.0, 5.0, 1.0, 0)]))
    good, jumps = tracks.split_spoofing(t)
    assert good.count() == 3
    j = jumps.first()
    assert j.reason == tracks.SPOOFED and abs(j.implied_kn - 1.5 * 60.04) < 0.1


def test_exact_threshold_is_plausible(spark):
    d = spark.createDataFrame([(50.0, 1.0, 1.0), (50.0001, 1.0, 1.0), (None, None, None), (None, 5.0, 0.0), (None, 5.0, None)], "implied_kn double, distance_nm double, delta_h double")
    good, jumps = tracks.split_spoofing(d)
    assert good.count() == 3 and jumps.count() == 1  # an unknown speed after a known distance goes to neither side


def test_statuses_exclude_one_another(spark):
    rows = [(5, 4.9, 0.0, None, "ATRACADO"), (1, 4.9, 0.0, None, "FONDEADO"), (0, 5.1, 10.0, 1.0, "EN_CAMINO"), (0, 5.1, 0.5, None, None), (0, 900.0, 10.0, 90.0, None), (0, 4.0, 3.0, 1.0, None)]
    d = spark.createDataFrame(rows, "nav_status int, distance_to_port_nm double, speed double, eta_hours double, expected string").withColumn("port_radius_nm", F.lit(5.0))
    assert all(r.s == r.expected for r in d.withColumn("s", tracks.port_status()).collect())


def test_destinations(spark):
    d = spark.createDataFrame([(1, "es bcn / VLC"), (2, "ALGECIRAS"), (3, "ROTTERDAM"), (4, None), (5, "E.S. VLC")], "id int, destination string")
    got = {r.id: (r.port_name, r.code) for r in tracks.resolve_destination(d).withColumn("code", tracks.exact_port_code()).collect()}
    assert got == {1: ("VALENCIA", None), 2: ("ALGECIRAS", "ESALG"), 3: ("UNKNOWN", None), 4: ("UNKNOWN", None), 5: ("VALENCIA", "ESVLC")}
    aliases = spark.createDataFrame([(a, p["name"], i) for i, p in enumerate(tracks.PORTS) for a in p["aliases"]], "alias string, port_name string, precedence int")
    other = {r.id: r.port_name for r in tracks.resolve_by_aliases(d, "id", aliases).collect()}
    assert other == {1: "VALENCIA", 2: "ALGECIRAS", 3: None, 4: None, 5: "VALENCIA"}


def test_pieces_of_destinations_are_never_broadcast(spark, tmp_path):
    spark.createDataFrame([(1, "for valencia"), (2, "es bcn"), (3, None), (4, "x")], "id long, destination string").write.parquet(f"{tmp_path}/d")
    aliases = spark.createDataFrame([(a, p["name"], i) for i, p in enumerate(tracks.PORTS) for a in p["aliases"]], "alias string, port_name string, precedence int")
    out = tracks.resolve_by_aliases(spark.read.parquet(f"{tmp_path}/d"), "id", aliases)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    lines = out._jdf.queryExecution().executedPlan().toString().splitlines()
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            under = lines[i + 1 :]
            under = under[: next((k for k, x in enumerate(under) if depth(x) <= depth(line)), len(under))]
            assert not any("Generate" in x for x in under)
    assert sum("BroadcastHashJoin" in x for x in lines) == 1
    assert {r.id: r.port_name for r in out.collect()} == {1: "VALENCIA", 2: "BARCELONA", 3: None, 4: None}


def test_alias_filter_needs_ports():
    with pytest.raises(ValueError):
        tracks.alias_filter("destination", [])


def test_alert_payload(spark):
    base = "2024-01-01 00:00:0"
    rows = [(1, base + "1", 36.13, -5.42, 0.0, 5), (2, base + "2", 37.0, -5.4, 12.0, 0), (2, base + "5", 37.1, -5.4, 12.0, 0), (3, base + "3", 50.0, -5.4, 1.0, 0)]
    d = fixes(spark, rows).withColumns({"port_name": F.lit("ALGECIRAS"), "port_lat": F.lit(36.12972), "port_lon": F.lit(-5.42278), "port_radius_nm": F.lit(5.0), "length_m": F.lit(100), "ship_type": F.lit(70), "correlation_id": F.col("event_time").cast("string")})
    inventory = tracks.port_inventory(d)
    out = tracks.eta_alerts(tracks.eta_candidates(tracks.dynamic_eta(d)), tracks.port_summary(tracks.unique_inventory(inventory))).collect()
    assert len(out) == 1
    p = json.loads(out[0].payload_json)
    assert p["paquete_1"]["mmsi"] == 2 and p["paquete_1"]["lat_buque"] == 37.0 and p["paquete_1"]["ETA_static"] is None
    assert p["paquete_2"]["estados"]["num_buques_atracados"] == [{"mmsi": 1, "eslora": 100, "tipo_buque": 70}]
    assert p["paquete_2"]["estados"]["num_buques_fondeados"] == []


def test_congestion_counts_what_the_lists_hold(spark):
    rows = [("A", "ATRACADO", 1, 10), ("A", "ATRACADO", 1, 11), ("A", "FONDEADO", 1, 10), ("A", "FONDEADO", 2, 10), ("A", "EN_CAMINO", 3, 10), ("B", "EN_CAMINO", 4, 10), ("A", "ATRACADO", None, 10)]
    unique = spark.createDataFrame(rows, "port_name string, vessel_status string, mmsi long, length_m int").withColumns({"ship_type": F.lit(70), "window": F.lit(1)})
    lists = {r.port_name: (r.congested_count, len(json.loads(r.atracados_json))) for r in tracks.port_summary(unique).collect()}
    assert {r.port_name: (r.congested_count, r.berthed) for r in tracks.congestion(unique).collect()} == lists == {"A": (2, 3), "B": (0, 0)}
