import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fairlead.functions import codes, text, voyage
from fairlead.operators import queueing, recommendations, registers, routes

RELAXED = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
LEGS = st.lists(st.tuples(st.floats(1, 300), st.floats(0, 60)), min_size=1, max_size=6)


def bisection(legs, target, design):
    hours = lambda v: sum(d / max(v * (1 - x / 100), 0.5) for d, x in legs)
    low, high = 0.4 * design, 1.2 * design
    if target <= hours(high):
        return "too_short", high, 0
    if target >= hours(low):
        return "too_long", low, 0
    for i in range(1, 51):
        mid = (low + high) / 2
        if abs(hours(mid) - target) <= 0.05:
            return "ok", mid, i
        low, high = (mid, high) if hours(mid) > target else (low, mid)
    return "not_converged", mid, 50


@RELAXED
@given(st.lists(st.tuples(LEGS, st.floats(1, 200), st.floats(8, 25)), min_size=1, max_size=10))
def test_jit_speed_is_the_plain_bisection(spark, cases):
    d = spark.createDataFrame([(i, [(float(a), float(b)) for a, b in legs], float(t), float(v)) for i, (legs, t, v) in enumerate(cases)], "i int, legs array<struct<distance_nm:double,loss_pct:double>>, t double, v double")
    for r in d.withColumn("j", voyage.jit_speed("legs", "t", "v")).collect():
        outcome, speed, n = bisection(*cases[r.i])
        assert (r.j.outcome, r.j.iterations) == (outcome, n)
        assert r.j.speed_kn == pytest.approx(speed, abs=0.0051)


def test_kwon_bounds(spark):
    rows = [(None, 10.0, 0.8, 0.0), (0.5, 0.0, 0.8, 0.0), (21.0, 30.0, 0.8, 1.7 * 1.15 * 6**1.5), (20.9, 60.0, 0.7, 1.4 * 5**1.5), (70.0, 0.0, 0.9, 60.0), (34.0, 180.0, 0.6, 0.4 * 0.85 * 8**1.5)]
    d = spark.createDataFrame(rows, "w double, a double, cb double, e double")
    assert all(abs(r.k - r.e) < 1e-9 for r in d.withColumn("k", voyage.kwon_loss_pct("w", "a", "cb")).collect())


def test_carbon_intensity(spark):
    d = spark.createDataFrame([("70", 190.0, 32.0, 11.0, 14.0, 300.0, None, None), ("70", 190.0, 32.0, 11.0, 10.0, 300.0, None, None), ("Container ship", 190.0, None, None, 14.0, 300.0, 12.0, 50000.0), ("x", 0.0, 1.0, 1.0, 1.0, 1.0, None, None)], "t string, l double, b double, h double, v double, nm double, e double, dwt double")
    r = d.withColumn("k", voyage.ship_type_key("t")).withColumn("c", voyage.carbon_intensity("v", "l", "b", "h", "k", "nm", "e", "dwt")).collect()
    assert 3 < r[0].c.cii < 20 and r[1].c.cii < r[0].c.cii and r[0].c.method == "fallback_admiralty"
    assert r[2].k == "container" and r[2].c.method == "eexi" and r[2].c.co2_kg == pytest.approx(r[2].c.cii * 50000 * 300 / 1000, abs=0.1)
    assert r[3].c is None
    assert r[2].c.design_speed_kn == round(0.235 * math.sqrt(9.81 * 0.97 * 190) / 0.5144, 2)


def test_halves_are_rounded_as_in_sql(spark):
    d = spark.createDataFrame([("ferry", 200.0, 17.0, 12.0)], "k string, l double, b double, h double")
    t = 0.55 * 200.0 * 17.0 * 12.0 * 1.025 * 0.35  # a little below 8050.35, and ten times that is a half
    assert t * 10 == 80503.5 and d.select(voyage.deadweight_t("l", "b", "h", "k")).first()[0] == 8050.4
    e = spark.createDataFrame([(2.5, 3.0), (-2.5, -3.0), (None, None)], "x double, want double")
    assert all(r.want == r.got for r in e.withColumn("got", voyage.rounded(F.col("x"), 0)).collect())


def test_signals(spark):
    d = spark.createDataFrame([(0.1, 39.9), (0.09, 40.0), (1.25, 299.0), (2.5, 300.0), (None, 1.0)], "w double, m double")
    assert [(r[0], r[1]) for r in d.select(voyage.sea_state("w"), voyage.freshness("m")).collect()] == [("Rizada", "fresco"), ("Mar en calma", "atenuado"), ("Fuerte marejada", "atenuado"), ("Gruesa o más", "retirado"), ("Sin dato del modelo", "fresco")]
    s = spark.createDataFrame([(5.0, 12.0, 14.0, 8.0, True), (5.0, 12.0, 14.0, -8.0, True), (5.0, 12.0, None, 2.0, False)], "wait double, fast double, now double, saving double, over boolean")
    got = [r[0] for r in s.select(voyage.short_summary("wait", "fast", "now", "saving", F.lit(11.0), "over")).collect()]
    assert "Ahorro" in got[0] and "AVISO" in got[1] and "diseño" in got[1] and "?" in got[2]


def test_queue(spark):
    rows = [("P", i, "ATRACADO", i, 200.0, "container") for i in range(5)] + [("P", 10, "FONDEADO", 0, 210.0, "container"), ("P", 11, "EN_CAMINO", 0, 220.0, "container"), ("P", 12, "FONDEADO", 1, None, "70"), ("P", 13, "FONDEADO", 2, 120.0, "bulk")]
    v = spark.createDataFrame(rows, "port string, mmsi long, state string, list_pos int, length_m double, ship_type string")
    got = {r.mmsi: r for r in queueing.port_queue_wait(v).collect()}
    mu = 28 * 1.28
    release = mu / 2 * (1 + 0.38**2) / 5
    assert got[10].berths == 6 and got[10].queue_position == 1 and got[12].queue_position == 2 and got[11].queue_position == 3
    assert got[10].wait_h == round(release + 1, 1) and got[11].queue_h == pytest.approx(release + 2 * mu / 6)
    assert got[13].segment == "small" and got[13].release_h == 0 and got[13].wait_h == 1.0


def test_admission_and_savings(spark):
    a = spark.createDataFrame([("V", 1.0, 5.0), (None, None, 5.0), ("V", 1.0, 0.0)], "puerto string, lat_buque double, velocidad_buque double")
    got = [(r.outcome, r.missing_fields) for r in recommendations.admit(a, ["puerto", "lat_buque", "velocidad_buque"]).collect()]
    assert got == [("OK", []), ("MISSING_FIELDS", ["puerto", "lat_buque"]), ("NOT_APPLICABLE", [])]
    d = spark.createDataFrame([(10.0, 6.0, 900000.0, 300000.0, 50000.0), (10.0, 12.0, 900000.0, 300000.0, None), (0.0, 1.0, None, None, None)], "cii_now double, cii_jit double, co2_now_kg double, co2_jit_kg double, dwt_real_t double")
    d = d.withColumns({"wait_h": F.lit(30.0), "eta_dynamic_h": F.lit(10.0), "transit_h": F.lit(12.5), "event_time": F.lit("2024-01-01").cast("timestamp")})
    r = recommendations.savings(d).collect()
    assert r[0].saving_pct == 40.0 and r[0].fuel_saved_t == pytest.approx(600 / 3.114, abs=1e-3) and r[0].idle_hours_avoided == 20 and r[0].eta_difference_h == 2.5
    assert r[1].fuel_saved_t is None and r[1].worse_cii and r[2].saving_pct is None and not r[2].worse_cii


def test_routes(spark):
    pts = spark.createDataFrame([(1, i, 0.0, float(i), 20.0, 90.0) for i in range(9)], "route_id long, idx int, lat double, lon double, wind_kn double, wind_from double")
    c = routes.cumulative(pts).orderBy("idx").collect()
    assert c[0].leg_nm == 0 and c[8].cum_nm == pytest.approx(8 * 60.04, abs=0.1)
    asked = spark.createDataFrame([(1, -5.0), (1, 90.06), (1, 1e6)], "route_id long, nm double")
    got = {r.nm: r.lon for r in routes.position_along_route(pts, asked).collect()}
    assert got[-5.0] == 0 and got[90.06] == pytest.approx(1.5, abs=1e-3) and got[1e6] == 8
    legs = routes.legs(pts)
    loss = routes.legs_with_loss(legs, spark.createDataFrame([(1, 0.7)], "route_id long, block_coefficient double")).first()
    assert len(loss.legs) == 8 and loss.legs[0].loss_pct == pytest.approx(1.7 * 5**1.5)
    places = spark.range(1, 31).select("id", routes.sampled_places(F.col("id").cast("int")).alias("p")).collect()
    for r in places:
        want = list(range(r.id)) if r.id <= 6 else sorted({round(k * (r.id - 1) / 5) for k in range(6)})
        assert r.p == want


def test_weather_without_forecast_is_null_and_whole(spark):
    pts = spark.createDataFrame([(1, i, 0.0, float(i)) for i in range(30)], "route_id long, idx int, lat double, lon double").withColumn("eta", F.lit("2024-01-01").cast("timestamp"))
    none = spark.createDataFrame([], "cell_lat double, cell_lon double, valid_at timestamp, wave_height double, wind_kn double, wind_from double")
    out = routes.route_weather(pts, none)
    assert out.count() == 30 and out.where("wave_height is not null").count() == 0


def test_text(spark):
    d = spark.createDataFrame([("2026-07-28 17:13:08.621081171 +0000 UTC",), ("2026-07-28 17:13:08 +0000 UTC",), ("",), ("soon",), (None,)], "t string")
    assert [r[0] for r in d.select(text.iso_utc(text.vendor_time("t"))).collect()] == ["2026-07-28T17:13:08.621081+00:00", "2026-07-28T17:13:08+00:00", None, None, None]
    p = spark.createDataFrame([("ALGECIRAS@@@@  ",), ("@@@@@@",), (None,)], "x string")
    assert [r[0] for r in p.select(text.strip_padding("x")).collect()] == ["ALGECIRAS", None, None]
    n = spark.createDataFrame([("1,234.5",), ("Division by zero!",), ("1e-05",), (None,)], "x string")
    assert [r[0] for r in n.select(text.figure("x")).collect()] == [1234.5, None, 1e-05, None]


def test_codes(spark):
    t = {r.ship_type: (r.category, r.hazard) for r in codes.ship_type_table(spark).collect()}
    assert t[70] == ("Carga", None) and t[81] == ("Tanque", "A") and t[10][0] == "Reservado" and len(t) == 100
    d = spark.createDataFrame([(0.0,), (99.9,), (600.0,), (600.1,), (None,)], "m double")
    assert [r[0] for r in d.select(codes.length_band("m")).collect()] == ["OTHER", "0-100", "300-600", "OTHER", "OTHER"]
    assert codes.nav_status_table(spark).count() == 16


def test_register(spark):
    raw = spark.createDataFrame([("9000001", "A", "1,000.5", "50", "5"), ("9000002", "B", "Division by zero!", "0", "5"), ("12", "C", "1", "1", "1")], ["IMO Number", "Name", "Total fuel consumption [t]", "Fuel consumption per distance [kg/nm]", "Fuel consumption per transport work (dwt) [g]"])
    got = {r.imo: r for r in registers.derive_register(raw).collect()}
    assert set(got) == {9000001, 9000002}
    assert got[9000001].dwt == 10000 and got[9000001].annual_distance_nm == pytest.approx(20010) and got[9000002].annual_distance_nm is None
