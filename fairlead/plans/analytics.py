"""Queries on waits, queues, voyages, routes, registers, messages and upserts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.functions import text as tx
from fairlead.functions import voyage as vy
from fairlead.operators import joins, models, portcalls, queueing, recommendations, registers, routes, windows
from fairlead.session import shared_folder
from fairlead.sources import contracts, files, silver
from fairlead.sources.tables import BucketedTable

from .proxies import FIXES_SQL, bearing_sql, fixes, gc_sql, hav_sql, table


# --- waits -------------------------------------------------------------------------------------------------------------
def _waits(spark, sf_dir):
    """Each line of an order as a call: its delay in days as the wait, order priority as port, price band as length band."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    j = li.select("l_orderkey", "l_linenumber", "l_shipdate").join(o, li["l_orderkey"] == o["o_orderkey"])
    band = F.when(F.col("o_totalprice") < 150000, "100-200").otherwise("200-300")
    return j.select(
        "o_orderkey", "l_linenumber", F.col("o_custkey").alias("mmsi"), F.col("o_orderpriority").alias("destination_port_code"), band.alias("length_band"),
        F.col("o_orderstatus").alias("ship_category"), (F.datediff("l_shipdate", "o_orderdate") % 97 / 4.0).alias("wait_hours"),
    )


_WAITS_SQL = """waits AS (SELECT o_orderkey, l_linenumber, o_custkey AS mmsi, o_orderpriority AS destination_port_code, CASE WHEN o_totalprice < 150000 THEN '100-200' ELSE '200-300' END AS length_band, o_orderstatus AS ship_category,
  (date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) % 97) / 4.0 AS wait_hours FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _stats_sql(keys):
    q = lambda p: f"round(CAST(quantile_disc(wait_hours, {p}) AS DOUBLE), 2)"
    return f"WITH {_WAITS_SQL} SELECT {keys}, count(*) AS port_calls, count(DISTINCT mmsi) AS vessels, round(avg(wait_hours), 2) AS avg_wait_hours, {q(0.5)} AS median_wait_hours, {q(0.25)} AS p25_wait_hours, {q(0.75)} AS p75_wait_hours, round(min(wait_hours), 2) AS min_wait_hours, round(max(wait_hours), 2) AS max_wait_hours FROM waits WHERE wait_hours >= 0 GROUP BY {keys}"


def waiting_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portcalls.waiting_stats(portcalls.eligible(_waits(spark, sf_dir)), ["destination_port_code", "length_band"], exact=True)


def waiting_stats_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portcalls.waiting_stats(portcalls.eligible(_waits(spark, sf_dir)), ["destination_port_code", "length_band", "ship_category"], exact=True)


def label_vs_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, keys = portcalls.eligible(_waits(spark, sf_dir)), ["destination_port_code", "length_band"]
    base = portcalls.waiting_stats(calls, keys, exact=True)
    return portcalls.label_jit(calls, base, keys).groupBy(*keys, "jit_label").agg(F.count("*").alias("calls"))


def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = portcalls.eligible(_waits(spark, sf_dir))
    by = portcalls.waiting_stats(calls, ["destination_port_code", "length_band"], exact=True)
    portcalls.reconcile(calls, by)
    return by.agg(F.sum("port_calls").alias("port_calls"))


def longest_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = portcalls.eligible(_waits(spark, sf_dir)).select("o_orderkey", "l_linenumber", "destination_port_code", "wait_hours")
    return windows.longest_wait_first(calls, "wait_hours", "o_orderkey", "l_linenumber")


def calls_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = portcalls.eligible(_waits(spark, sf_dir)).select("o_orderkey", "l_linenumber", "ship_category", "wait_hours")
    return windows.by_priority(calls, "ship_category", ["F"], "wait_hours", "o_orderkey", "l_linenumber")


# --- queues ------------------------------------------------------------------------------------------------------------
def _vessels(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    j = o.join(joins.small_side(c.select("c_custkey", "c_nationkey")), o["o_custkey"] == F.col("c_custkey"))
    state = F.when(F.col("o_orderstatus") == "F", "ATRACADO").when(F.col("o_orderstatus") == "O", "FONDEADO").otherwise("EN_CAMINO")
    return j.select(F.col("c_nationkey").alias("port"), F.col("o_orderkey").alias("mmsi"), state.alias("state"), F.col("o_orderkey").alias("list_pos"), F.when(F.col("o_orderkey") % 50 != 0, F.floor(F.col("o_totalprice") / 800)).cast("double").alias("length_m"), (F.col("o_orderkey") % 100).cast("string").alias("ship_type"))


def queue_wait(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = queueing.port_queue_wait(_vessels(spark, sf_dir))
    return q.select("port", "mmsi", "segment", "queue_position", "berths", F.round("release_h", 6).alias("release_h"), F.round("queue_h", 6).alias("queue_h"))


_QUEUE_SQL = """
WITH v AS (SELECT c_nationkey AS port, o_orderkey AS mmsi, CASE o_orderstatus WHEN 'F' THEN 'ATRACADO' WHEN 'O' THEN 'FONDEADO' ELSE 'EN_CAMINO' END AS state, o_orderkey AS list_pos,
  coalesce(CASE WHEN o_orderkey % 50 <> 0 THEN CAST(floor(o_totalprice / 800) AS DOUBLE) END, 150.0) AS length_m, o_orderkey % 100 AS k FROM orders JOIN customer ON o_custkey = c_custkey),
t AS (SELECT *, CASE WHEN length_m < 0 THEN 'vlarge' WHEN length_m < 150 THEN 'small' WHEN length_m < 250 THEN 'medium' WHEN length_m < 350 THEN 'large' ELSE 'vlarge' END AS segment,
  CASE WHEN k BETWEEN 60 AND 69 OR k BETWEEN 40 AND 49 THEN 10.0 WHEN k BETWEEN 70 AND 79 THEN 36.0 WHEN k BETWEEN 80 AND 89 THEN 49.0 WHEN k IN (31, 32, 33, 50, 51, 52, 53, 54) THEN 20.0 ELSE 36.0 END
  * CASE WHEN length_m < 0 THEN 1.43 WHEN length_m < 100 THEN 1.03 WHEN length_m < 200 THEN 1.0 WHEN length_m < 300 THEN 1.28 ELSE 1.43 END AS mu,
  CASE WHEN k BETWEEN 60 AND 69 OR k BETWEEN 40 AND 49 THEN 0.25 WHEN k BETWEEN 70 AND 79 THEN 0.4 WHEN k BETWEEN 80 AND 89 THEN 0.49 WHEN k IN (31, 32, 33, 50, 51, 52, 53, 54) THEN 0.35 ELSE 0.4 END AS cv FROM v),
s AS (SELECT port, segment, count(CASE WHEN state = 'ATRACADO' THEN 1 END) AS berthed, avg(CASE WHEN state = 'ATRACADO' THEN mu / 2 * (1 + cv * cv) END) AS residual FROM t GROUP BY ALL),
s2 AS (SELECT *, CAST(greatest(1, ceil(round(berthed * 1.2, 9))) AS INTEGER) AS berths FROM s),
s3 AS (SELECT *, CASE WHEN berthed = 0 THEN 0.0 ELSE residual / greatest(1, least(berthed, berths)) END AS release_h FROM s2),
q AS (SELECT *, CAST(row_number() OVER (PARTITION BY port, segment ORDER BY CASE state WHEN 'FONDEADO' THEN 0 ELSE 1 END, list_pos, mmsi) AS INTEGER) AS queue_position FROM t WHERE state <> 'ATRACADO')
SELECT q.port, mmsi, q.segment, queue_position, berths, round(release_h, 6) AS release_h, round(release_h + (queue_position - 1) * mu / berths, 6) AS queue_h FROM q JOIN s3 ON q.port = s3.port AND q.segment = s3.segment
"""


def subject_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's largest order as subject vessel, half of them not on its port's lists yet."""
    v = _vessels(spark, sf_dir).withColumn("imo", F.lit(None).cast("long"))
    subject = windows.latest_per_key(v, ["port"], [F.desc("mmsi")])
    listed = v.join(subject.where("port % 2 = 0").select("port", "mmsi"), ["port", "mmsi"], "left_anti")
    merged = queueing.merge_subject(listed, subject.drop("list_pos"))
    return merged.groupBy("port").agg(F.count("*").alias("vessels"), F.sum(F.col("is_subject").cast("int")).alias("subjects"), F.max(F.when(F.col("is_subject"), F.col("mmsi"))).alias("subject"))


# --- voyages -----------------------------------------------------------------------------------------------------------
_TYPES = ["bulk carrier", "Oil tanker", "container ship", "ro-ro", "ferry", "unknown thing", "70", "85"]


def _hulls(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    raw = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return p.select("p_partkey", raw.alias("raw_type"), (60 + F.col("p_partkey") % 340).cast("double").alias("length_m"), (10 + F.col("p_size") % 40).cast("double").alias("beam_m"), (4 + F.col("p_partkey") % 14).cast("double").alias("draught_m"), (F.col("p_partkey") % 26).cast("double").alias("speed"), (50 + F.col("p_partkey") % 900).cast("double").alias("distance_nm"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_retailprice") / 200).alias("eexi"), F.when(F.col("p_partkey") % 6 == 0, F.lit(50000.0)).alias("dwt"))


def carbon_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _hulls(spark, sf_dir).withColumn("key", vy.ship_type_key("raw_type"))
    c = h.withColumn("c", vy.carbon_intensity("speed", "length_m", "beam_m", "draught_m", "key", "distance_nm", "eexi", "dwt"))
    return c.select("p_partkey", "key", F.col("c.cii").alias("cii"), F.col("c.method").alias("method"), "c.design_speed_kn", "c.dwt_real_t", F.round("c.dwt_estimated_t", 0).alias("dwt_estimated_t"), F.round(F.col("c.co2_kg"), 0).alias("co2_kg"))


def _case(place, default):
    return "CASE key " + " ".join(f"WHEN '{k}' THEN {v[place]}" for k, v in vy.HULLS.items()) + f" ELSE {default} END"


_HULL_SQL = """WITH h AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'bulk_carrier' WHEN 1 THEN 'oil_tanker' WHEN 2 THEN 'container' WHEN 3 THEN 'ro_ro' WHEN 4 THEN 'ferry' WHEN 5 THEN 'general_cargo' WHEN 6 THEN 'general_cargo' ELSE 'oil_tanker' END AS key,
  CAST(60 + p_partkey % 340 AS DOUBLE) AS length_m, CAST(10 + p_size % 40 AS DOUBLE) AS beam_m, CAST(4 + p_partkey % 14 AS DOUBLE) AS draught_m, CAST(p_partkey % 26 AS DOUBLE) AS speed, CAST(50 + p_partkey % 900 AS DOUBLE) AS distance_nm,
  CASE WHEN p_partkey % 3 = 0 THEN p_retailprice / 200 END AS eexi, CASE WHEN p_partkey % 6 = 0 THEN CAST(50000 AS DOUBLE) END AS dwt FROM part)"""
_CII_SQL = f"""{_HULL_SQL}, a AS (SELECT *, round({_case(0, 0.18)} * sqrt(9.81 * 0.97 * length_m) / 0.5144, 2) AS design_speed_kn, CAST({_case(1, 0.7)} AS DOUBLE) * length_m * beam_m * draught_m * 1.025 AS disp, CAST({_case(2, 0.65)} AS DOUBLE) AS ratio, CAST({_case(3, 450.0)} AS DOUBLE) AS cadm FROM h),
b AS (SELECT *, round(disp * ratio, 1) AS est, CASE WHEN speed > 0 THEN pow(disp, 2.0 / 3) * pow(speed, 3) / cadm * 190 * (distance_nm / speed) / 1000 * 3.114 END AS co2, coalesce(eexi > 0 AND speed > 0, false) AS indexed, round(eexi * pow(speed / design_speed_kn, 2), 4) AS by_index FROM a)
SELECT p_partkey, key, CASE WHEN indexed THEN by_index WHEN speed <= 0 THEN CAST(0 AS DOUBLE) ELSE round(co2 * 1000 / (est * distance_nm), 4) END AS cii, CASE WHEN indexed THEN 'eexi' ELSE 'fallback_admiralty' END AS method, design_speed_kn, CASE WHEN indexed THEN dwt END AS dwt_real_t,
  round(CASE WHEN NOT indexed THEN est END, 0) AS dwt_estimated_t, round(CASE WHEN indexed THEN round(by_index * dwt * distance_nm / 1000, 1) WHEN speed <= 0 THEN 0 ELSE round(co2, 1) END, 0) AS co2_kg FROM b"""


def kwon_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    wind, angle = F.when(F.col("l_linenumber") != 7, F.col("l_quantity") * 1.4), (F.col("l_orderkey") % 181).cast("double")
    cb = F.element_at(F.array(F.lit(0.82), F.lit(0.7), F.lit(0.6)), (F.col("l_partkey") % 3 + 1).cast("int"))
    loss = vy.kwon_loss_pct(wind, angle, cb)
    return li.withColumns({"loss": loss, "bn": vy.beaufort(wind)}).groupBy("bn", "l_returnflag").agg(F.count("*").alias("rows"), F.round(F.sum("loss"), 4).alias("loss"), F.round(F.max("loss"), 4).alias("most"))


_BN = "CASE WHEN wind IS NULL THEN NULL " + " ".join(f"WHEN wind < {b} THEN {n}" for b, n in vy.BEAUFORT) + " ELSE 12 END"
_KWON_SQL = f"""WITH a AS (SELECT *, CASE WHEN l_linenumber <> 7 THEN l_quantity * 1.4 END AS wind, l_orderkey % 181 AS ang, CASE l_partkey % 3 WHEN 0 THEN 1.15 WHEN 1 THEN 1.0 ELSE 0.85 END AS hull FROM lineitem), b AS (SELECT *, {_BN} AS bn FROM a),
c AS (SELECT *, CASE WHEN wind IS NULL THEN CAST(0 AS DOUBLE) ELSE CAST(greatest(0, least(60, CASE WHEN ang <= 30 THEN 1.7 WHEN ang <= 60 THEN 1.4 WHEN ang <= 90 THEN 1.0 WHEN ang <= 150 THEN 0.7 ELSE 0.4 END * hull * pow(bn, 1.5))) AS DOUBLE) END AS loss FROM b)
SELECT CAST(bn AS INTEGER) AS bn, l_returnflag, count(*) AS rows, round(sum(loss), 4) AS loss, round(max(loss), 4) AS most FROM c GROUP BY 1, 2"""


def _orders_as_routes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    leg = F.struct(F.col("l_linenumber").alias("idx"), (F.col("l_extendedprice") / 400).alias("distance_nm"), (F.col("l_discount") * 300).alias("loss_pct"))
    legs = F.transform(F.array_sort(F.collect_list(leg)), lambda x: F.struct(x["distance_nm"].alias("distance_nm"), x["loss_pct"].alias("loss_pct")))
    return li.groupBy("l_orderkey").agg(legs.alias("legs"))


def jit_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _orders_as_routes(spark, sf_dir).withColumn("target", (F.col("l_orderkey") % 60 + 2).cast("double"))
    return r.withColumn("j", vy.jit_speed("legs", "target", F.lit(15.0))).select("l_orderkey", "j.speed_kn", "j.transit_h", "j.iterations", "j.converged", "j.outcome", "j.exceeds_design")


_JIT_SQL = """WITH RECURSIVE r AS (SELECT l_orderkey, CAST(l_orderkey % 60 + 2 AS DOUBLE) AS target, sum((l_extendedprice / 400) / (1 - l_discount * 300 / 100)) AS k FROM lineitem GROUP BY l_orderkey),
b(l_orderkey, target, k, lo, hi, v, n, done) AS (
  SELECT l_orderkey, target, k, 6.0::DOUBLE, 18.0::DOUBLE, 12.0::DOUBLE, 0, false FROM r WHERE target > k / 18 AND target < k / 6
  UNION ALL
  SELECT l_orderkey, target, k, CASE WHEN k / ((lo + hi) / 2) > target THEN (lo + hi) / 2 ELSE lo END, CASE WHEN k / ((lo + hi) / 2) > target THEN hi ELSE (lo + hi) / 2 END, (lo + hi) / 2, n + 1, abs(k / ((lo + hi) / 2) - target) <= 0.05 FROM b WHERE NOT done AND n < 50
), last AS (SELECT * FROM b WHERE done)
SELECT l_orderkey, round(v, 2) AS speed_kn, round(k / v, 2) AS transit_h, n AS iterations, true AS converged, 'ok' AS outcome, v > 15 AS exceeds_design FROM last
UNION ALL SELECT l_orderkey, 18.0, round(k / 18, 2), 0, false, 'too_short', true FROM r WHERE target <= k / 18
UNION ALL SELECT l_orderkey, 6.0, round(k / 6, 2), 0, false, 'too_long', false FROM r WHERE target > k / 18 AND target >= k / 6"""


def route_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _orders_as_routes(spark, sf_dir)
    return r.select("l_orderkey", F.size("legs").alias("legs"), F.round(vy.mean_loss_pct("legs"), 4).alias("mean_loss_pct"), F.round(vy.transit_hours("legs", F.lit(12.0)), 4).alias("hours"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived states of recommendations, on orders."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    over, worse, met, delta = k % 7 == 0, k % 5 == 0, k % 3 == 0, (k % 11 - 5).cast("double")
    wave, age = F.when(k % 13 != 0, (k % 40) / 10.0), (k % 400).cast("double")
    idle, wait, transit = F.when(k % 17 != 0, (k % 23).cast("double")), (k % 31).cast("double"), (k % 19).cast("double")
    parts = vy.anchoring_breakdown(idle, wait, transit)
    return o.select(vy.severity(over, worse).alias("severity"), vy.confidence(F.when(k % 4 == 0, "fallback_admiralty").otherwise("eexi"), F.when(k % 2 == 0, F.lit(1.0))).alias("confidence"), vy.saturation(met, delta).alias("saturation"), vy.headline(over, worse, met, delta).alias("headline"), vy.sea_state(wave).alias("sea"), vy.freshness(age).alias("freshness"), parts["avoided"].alias("avoided")).groupBy("severity", "confidence", "saturation", "headline", "sea", "freshness").agg(F.count("*").alias("rows"), F.sum("avoided").alias("avoided"))


_SIGNALS_SQL = """WITH s AS (SELECT o_orderkey AS k FROM orders), d AS (SELECT k, CASE WHEN k % 7 = 0 THEN 'critical' WHEN k % 5 = 0 THEN 'alert' ELSE 'ok' END AS severity, CASE WHEN k % 4 = 0 THEN 'baja' WHEN k % 2 = 0 THEN 'alta' ELSE 'media' END AS confidence,
  CASE WHEN k % 3 = 0 THEN 'ninguna' WHEN k % 11 - 5 < 0 THEN 'frenando-al-minimo' ELSE 'a-maxima-velocidad' END AS saturation,
  CASE WHEN k % 7 = 0 THEN 'Necesita más velocidad de la de diseño' WHEN k % 3 <> 0 AND k % 11 - 5 < 0 THEN 'Fondeará igual: solo recorta el consumo' WHEN k % 5 = 0 THEN 'Llega a tiempo, emitiendo más' ELSE 'Llega a tiempo emitiendo menos' END AS headline,
  CASE WHEN k % 13 = 0 THEN 'Sin dato del modelo' WHEN k % 40 < 1 THEN 'Mar en calma' WHEN k % 40 < 5 THEN 'Rizada' WHEN k % 40 < 12.5 THEN 'Marejada' WHEN k % 40 < 25 THEN 'Fuerte marejada' ELSE 'Gruesa o más' END AS sea,
  CASE WHEN k % 400 < 40 THEN 'fresco' WHEN k % 400 < 300 THEN 'atenuado' ELSE 'retirado' END AS freshness, CASE WHEN k % 17 <> 0 THEN CAST(k % 23 - greatest(0, k % 31 - k % 19) AS DOUBLE) END AS avoided FROM s)
SELECT severity, confidence, saturation, headline, sea, freshness, count(*) AS rows, sum(avoided) AS avoided FROM d GROUP BY ALL"""


def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    a = e.select("event_id", F.when(F.col("event_id") % 9 != 0, F.col("event_type")).alias("puerto"), F.when(F.col("event_id") % 14 != 0, F.lit(1.0)).alias("lat_buque"), F.lit(2.0).alias("velocidad_buque_raw"), (F.col("event_id") % 4).cast("double").alias("velocidad_buque"))
    out = recommendations.admit(a, ["puerto", "lat_buque", "velocidad_buque"])
    return out.groupBy("outcome", F.concat_ws(",", "missing_fields").alias("missing")).agg(F.count("*").alias("alerts"))


def savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    d = o.select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("event_time"), (k % 13).cast("double").alias("cii_now"), (k % 7).cast("double").alias("cii_jit"), (F.col("o_totalprice") * 10).alias("co2_now_kg"), (F.col("o_totalprice") * 8).alias("co2_jit_kg"), F.when(k % 3 == 0, F.lit(50000.0)).alias("dwt_real_t"), (k % 50).cast("double").alias("wait_h"), F.when(k % 10 != 0, (k % 30).cast("double")).alias("eta_dynamic_h"), (k % 40).cast("double").alias("transit_h"))
    return recommendations.savings(d).select("o_orderkey", "saving_pct", "idle_hours_avoided", "fuel_saved_t", "eta_difference_h", "worse_cii")


_SAVINGS_SQL = """WITH d AS (SELECT o_orderkey, o_orderkey AS k, o_totalprice AS p FROM orders), e AS (SELECT *, CASE WHEN k % 13 <> 0 THEN round(100.0 * (k % 13 - k % 7) / (k % 13), 1) END AS saving_pct FROM d)
SELECT o_orderkey, saving_pct, CASE WHEN k % 10 <> 0 THEN CAST(greatest(0, k % 50 - k % 30) AS DOUBLE) END AS idle_hours_avoided, CASE WHEN k % 3 = 0 THEN round((p * 10 - p * 8) / 3.114 / 1000, 3) END AS fuel_saved_t, CASE WHEN k % 10 <> 0 THEN CAST(k % 40 - k % 30 AS DOUBLE) END AS eta_difference_h, coalesce(saving_pct < 0, false) AS worse_cii FROM e"""


# --- routes ------------------------------------------------------------------------------------------------------------
def _points(spark, sf_dir):
    """Each vessel's fixes as one route."""
    from pyspark.sql import Window as W

    f = fixes(spark, sf_dir)
    return f.select(F.col("mmsi").alias("route_id"), F.row_number().over(W.partitionBy("mmsi").orderBy("event_time")).alias("idx"), "lat", "lon", "event_time", (F.col("event_id") % 60).cast("double").alias("wind_kn"), (F.col("event_id") * 17 % 360).cast("double").alias("wind_from"))


_POINTS_SQL = f"points AS (SELECT mmsi AS route_id, row_number() OVER (PARTITION BY mmsi ORDER BY event_time) AS idx, lat, lon, CAST(event_id % 60 AS DOUBLE) AS wind_kn, CAST(event_id * 17 % 360 AS DOUBLE) AS wind_from FROM ({FIXES_SQL}))"
_CUM_SQL = f"""{_POINTS_SQL}, l AS (SELECT *, coalesce({hav_sql("plat", "plon", "lat", "lon")}, 0) AS leg_nm FROM (SELECT *, lag(lat, 1) OVER w AS plat, lag(lon, 1) OVER w AS plon FROM points WINDOW w AS (PARTITION BY route_id ORDER BY idx)) WHERE plat IS NOT NULL UNION ALL SELECT *, NULL, NULL, 0 FROM points WHERE idx = 1),
cum AS (SELECT *, sum(leg_nm) OVER (PARTITION BY route_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS cum_nm FROM l)"""


def route_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.cumulative(_points(spark, sf_dir)).select("route_id", "idx", F.round("leg_nm", 4).alias("leg_nm"), F.round("cum_nm", 3).alias("cum_nm"))


def route_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = routes.legs(_points(spark, sf_dir))
    return g.groupBy("route_id").agg(F.count("*").alias("legs"), F.round(F.sum("distance_nm"), 3).alias("nm"), F.round(F.sum("course"), 2).alias("courses"), F.sum("leg_wind_kn").alias("winds"))


def position_along_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    asked = p.where("idx = 1").select("route_id", F.explode(F.array(*[F.lit(float(x)) for x in (0, 137, 900, 1e7)])).alias("nm"))
    return routes.position_along_route(p, asked).select("route_id", "nm", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"))


_ALONG_SQL = f"""WITH {_CUM_SQL}, n AS (SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2, lead(cum_nm) OVER w AS cum2 FROM cum WINDOW w AS (PARTITION BY route_id ORDER BY idx)), a AS (SELECT route_id, unnest([0.0, 137.0, 900.0, 10000000.0]) AS nm FROM points WHERE idx = 1)
SELECT a.route_id, CAST(nm AS DOUBLE) AS nm, round(lat + coalesce(CASE WHEN cum2 > cum_nm THEN (nm - cum_nm) / (cum2 - cum_nm) * (lat2 - lat) END, 0), 4) AS lat, round(lon + coalesce(CASE WHEN cum2 > cum_nm THEN (nm - cum_nm) / (cum2 - cum_nm) * (lon2 - lon) END, 0), 4) AS lon FROM a JOIN n ON a.route_id = n.route_id AND nm >= cum_nm AND (cum2 IS NULL OR nm < cum2)"""


def nearest_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixes(spark, sf_dir)
    left = f.where("nav_status = 5").select("event_id", "mmsi", "event_time")
    right = f.where("nav_status = 1").select("mmsi", F.col("event_time").alias("at"), F.col("event_id").alias("near_id"))
    return joins.nearest_time_join(left, right, ["mmsi"], "event_time", "at", ["near_id"], "event_id", within_hours=48).select("event_id", "near_id")


_NEAREST_SQL = f"""WITH fixes AS ({FIXES_SQL}), m AS (SELECT a.event_id, b.event_id AS near_id, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(epoch_us(a.event_time) - epoch_us(b.event_time)), b.event_time) AS rn FROM fixes a JOIN fixes b ON a.mmsi = b.mmsi AND a.nav_status = 5 AND b.nav_status = 1 AND abs(epoch_us(a.event_time) - epoch_us(b.event_time)) <= 172800000000)
SELECT f.event_id, m.near_id FROM fixes f LEFT JOIN m ON f.event_id = m.event_id AND m.rn = 1 WHERE f.nav_status = 5"""


def route_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir).withColumn("eta", F.col("event_time"))
    e = fixes(spark, sf_dir)
    cell = lambda c: F.floor(F.col(c) / 2) * 2
    forecast = e.groupBy(cell("lat").alias("cell_lat"), cell("lon").alias("cell_lon"), F.date_trunc("hour", "event_time").alias("valid_at")).agg(F.max("speed").alias("wave_height"))
    w = routes.route_weather(p.drop("wind_kn", "wind_from"), forecast, cell_deg=2, columns=("wave_height",), within_hours=6)
    return w.select("route_id", "idx", "source_place", F.round("wave_height", 4).alias("wave_height"))


_ROUTE_WEATHER_SQL = f"""
WITH fixes AS ({FIXES_SQL}), p AS (SELECT mmsi AS route_id, row_number() OVER (PARTITION BY mmsi ORDER BY event_time) - 1 AS place, count(*) OVER (PARTITION BY mmsi) AS n, lat, lon, event_time AS eta FROM fixes),
asked AS (SELECT DISTINCT route_id, CASE WHEN n <= {routes.WEATHER_POINTS} THEN i ELSE CAST(round_even(i * ((n - 1) / {routes.WEATHER_POINTS - 1}.0), 0) AS BIGINT) END AS k
  FROM (SELECT DISTINCT route_id, n FROM p), range({routes.WEATHER_POINTS}) r(i) WHERE n > {routes.WEATHER_POINTS} OR i < n),
near AS (SELECT route_id, place, arg_min(k, abs(k - place) * 1000000 + k) AS source_place FROM p JOIN asked USING (route_id) GROUP BY ALL),
forecast AS (SELECT floor(lat / 2) * 2 AS clat, floor(lon / 2) * 2 AS clon, date_trunc('hour', event_time) AS valid_at, max(speed) AS wave FROM fixes GROUP BY ALL),
got AS (SELECT route_id, place AS source_place, arg_min(wave, abs(epoch_us(eta) - epoch_us(valid_at)) * 10 + CASE WHEN valid_at <= eta THEN 0 ELSE 1 END) AS wave
  FROM p JOIN (SELECT route_id, k AS place FROM asked) USING (route_id, place) JOIN forecast ON clat = floor(lat / 2) * 2 AND clon = floor(lon / 2) * 2 AND abs(epoch_us(eta) - epoch_us(valid_at)) <= 6 * 3600000000 GROUP BY ALL)
SELECT route_id, CAST(place + 1 AS INTEGER) AS idx, CAST(source_place AS INTEGER) AS source_place, round(wave, 4) AS wave_height FROM near LEFT JOIN got USING (route_id, source_place)
"""


# --- keys, sessions, upserts -------------------------------------------------------------------------------------------
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.latest_per_key(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


def topk_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-30").cast("timestamp_ntz")
    return windows.recent(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", now, 240, 3, "event_id").select("user_id", "event_type", "rank", "event_id")


def latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.newer_than(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", None, 50).select("event_id")


def session_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.assign_session(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id", 24).select("event_id", "session_id")


def session_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    placed = windows.assign_session(e, ["user_id", "event_type"], "ts", "event_id", 24)
    return windows.in_session_order(placed.select("session_id", "ts", "event_id"), "session_id", "ts", "event_id")


def any_critical(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return windows.any_flagged(e, ["user_id"], (F.col("event_type") == "purchase") & (F.col("value") > 50))


def session_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = windows.assign_session(table(spark, sf_dir, "events").withColumn("delta", F.col("value") - 50), ["user_id", "event_type"], "ts", "event_id", 24)
    return windows.session_evolution(s, "session_id", "ts", "delta").select("session_id", F.round("first_value", 6).alias("first_value"), F.round("last_value", 6).alias("last_value"), F.round(F.col("minutes") * 60).cast("long").alias("seconds"), "events", "regime_changed")


_SESSION_SQL = """s AS (SELECT *, sum(CASE WHEN floor(epoch(ts)) - floor(epoch(prev)) <= 86400 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS chain FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS prev FROM events)),
t AS (SELECT *, first_value(event_id) OVER (PARTITION BY user_id, event_type, chain ORDER BY ts, event_id) AS session_id FROM s)"""


def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return joins.upsert(c, _new_customers(c), "c_custkey")


def _new_customers(c: DataFrame) -> DataFrame:
    """A tenth of the customers with new values, half of them under new keys."""
    moved = F.when(F.col("c_custkey") % 20 == 3, 10_000_000).otherwise(0)
    return c.where("c_custkey % 10 = 3").select((F.col("c_custkey") + moved).alias("c_custkey"), F.lit("NEW").alias("c_mktsegment"), (F.col("c_acctbal") + 1).alias("c_acctbal"))


def upsert_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a table of bucket versions: customers are stored, updated, and read back."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    stored = BucketedTable(spark, f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}", "c_custkey", buckets=64)
    stored.upsert(c)
    stored.upsert(_new_customers(c))
    return stored.read()


def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    twice = c.select((F.col("c_custkey") + 100).alias("c_custkey"), "c_mktsegment").unionByName(c.select((F.col("c_custkey") + 100).alias("c_custkey"), F.lit("ZZZ").alias("c_mktsegment")))
    return joins.insert_ignore(c, twice, "c_custkey")


def lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return joins.lookup(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity"), s, "l_suppkey", ["s_name"]).groupBy("s_name").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("rows"))


def message_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 16).alias("part"), F.floor(F.col("event_id") / 32).alias("offset"), "event_id")
    return windows.without_repeats(e, ["part", "offset"], [F.desc("event_id")])


def keyed_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    a = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("x"), F.array_sort(F.collect_list(F.when(F.col("l_returnflag") != "A", F.col("l_linenumber")))).alias("y"))
    z = a.withColumn("z", joins.zip_series("x", "y"))
    return z.groupBy(F.col("z").isNull().alias("blank")).agg(F.count("*").alias("orders"), F.sum(F.aggregate("z", F.lit(0), lambda s, p: s + p["first"] - p["second"])).alias("difference"))


# --- messages and quality ----------------------------------------------------------------------------------------------
def _messages(spark, sf_dir):
    """events as raw envelopes, every ninth broken in some way."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    lat = F.when(k % 9 == 1, F.lit(120.0)).otherwise(36 + (k % 500) / 100.0)
    time = F.when(k % 9 == 2, F.lit("soon")).otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(".123456789 +0000 UTC")))
    mmsi = F.when(k % 9 == 3, F.lit(0).cast("long")).otherwise(F.col("user_id") + 224_000_000)
    kind = F.when(F.col("event_type") == "view", "Other").otherwise("PositionReport")
    body = F.to_json(F.struct(kind.alias("MessageType"), F.struct(mmsi.alias("MMSI"), time.alias("time_utc")).alias("MetaData"), F.struct(F.struct(lat.alias("Latitude"), F.lit(1.5).alias("Longitude"), F.col("value").alias("Sog")).alias("PositionReport")).alias("Message")))
    return contracts.parse_messages(e.select(F.when(k % 9 == 4, F.lit("{broken")).otherwise(body).alias("value")))


def contract_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = contracts.checked_positions(_messages(spark, sf_dir))
    rejected = F.get_json_object(F.when(F.size("reasons") > 0, contracts.reject_value("PositionReport")), "$.reason")
    return checked.groupBy(F.coalesce(rejected, F.lit("valid")).alias("reason")).agg(F.count("*").alias("messages"))


def silver_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions that pass the row checks, by day of their file; every seventh has no vessel, every ninth no place."""
    k = F.col("event_id")
    bronze = table(spark, sf_dir, "events").select(
        F.when(k % 7 != 0, F.col("user_id")).alias("mmsi"),
        F.when(k % 11 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("timestamp"),
        F.when(k % 9 == 1, 120.0).otherwise(36.0).alias("lat"),
        F.lit(1.5).alias("lon"),
        F.when(k % 5 != 0, F.col("value")).alias("speed"),
        F.lit(180.0).alias("cog"),
        F.lit(511).alias("heading"),
        F.lit(0).alias("nav_status"),
        F.col("event_type").alias("correlation_id"),
        F.col("ts").cast("timestamp").alias("_kafka_ingestion_time"),
        (k % 16).alias("_kafka_partition"),
        F.floor(k / 16).alias("_kafka_offset"),
        F.lit(1).alias("_schema_version"),
        F.concat(F.lit("/bronze/_dt="), F.date_format("ts", "yyyy-MM-dd"), F.lit("/part-0")).alias("source_file"),
    )
    sound = silver.silver_positions(bronze, "2024-01-10")
    return sound.groupBy(F.col("bronze_partition_date").alias("day")).agg(
        F.count("*").alias("positions"),
        F.count("speed_over_ground_knots").alias("with_speed"),
        F.countDistinct("mmsi").alias("vessels"),
    )


def contract_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.positions(_messages(spark, sf_dir))[0].groupBy("mmsi", F.substring("timestamp", 1, 10).alias("day"), F.substring("timestamp", 20, 13).alias("tail")).agg(F.count("*").alias("messages"), F.round(F.sum("speed"), 4).alias("speed"))


def message_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.message_counts(_messages(spark, sf_dir))


def props_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_type", F.from_json("props", "k long").getField("k").alias("k")).groupBy("event_type").agg(F.count("k").alias("known"), F.sum("k").alias("total"), F.max("k").alias("most"))


def text_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.upper("p_type"), F.lit("@@ ")).alias("padded"), F.when(F.col("p_partkey") % 5 == 0, "Division by zero!").otherwise(F.concat(F.lit("1,"), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"), F.lit(".5 kg"))).alias("cell"))
    return p.select("p_partkey", tx.strip_padding("padded").alias("clean"), tx.figure("cell").alias("number"), tx.first_figure("cell").alias("first"), tx.plain_destination("padded").alias("plain"))


def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 8 != 0, F.col("o_totalprice")).alias("price"), (F.col("o_totalprice") / 2 + 90000).alias("part"))
    return registers.coverage_report(o, {"price": (0, 300000)}, [("part", "price")])


def feature_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("quantity"), "l_returnflag", F.lit(1).alias("one"))
    return registers.feature_profile(li, ["quantity", "l_returnflag", "one"])


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registers.profile(table(spark, sf_dir, "events"), "ts", "user_id")


def register_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "part")
    raw = s.select(
        (F.col("p_partkey") + 999_000).cast("string").alias("IMO Number"), F.col("p_name").alias("Name"), F.col("p_type").alias("Ship type"), F.when(F.col("p_partkey") % 4 == 0, "Division by zero!").otherwise(F.format_number(F.col("p_retailprice") * 10, 2)).alias("Total fuel consumption [m tonnes]"),
        F.col("p_size").cast("string").alias("Annual average Fuel consumption per distance [kg / n mile]"), (F.col("p_size") / 10.0).cast("string").alias("Annual average Fuel consumption per transport work (dwt) [g / dwt tonnes · n miles]"), F.concat(F.lit("EEXI ("), F.col("p_size"), F.lit(".5 gCO2)")).alias("Technical efficiency"),
    )
    d = registers.derive_register(raw)
    return d.select("imo", "name", "eexi", F.round("annual_fuel_t", 2).alias("annual_fuel_t"), F.round("annual_distance_nm", 2).alias("annual_distance_nm"), F.round("dwt", 2).alias("dwt"))


_REGISTER_SQL = """SELECT p_partkey + 999000 AS imo, trim(p_name) AS name, CAST(p_size + 0.5 AS DOUBLE) AS eexi, CASE WHEN p_partkey % 4 <> 0 THEN round(p_retailprice * 10, 2) END AS annual_fuel_t,
  CASE WHEN p_partkey % 4 <> 0 AND p_size > 0 THEN round(round(p_retailprice * 10, 2) * 1000 / p_size, 2) END AS annual_distance_nm, CASE WHEN p_size > 0 THEN round(p_size * 1000 / (p_size / 10.0), 2) END AS dwt FROM part WHERE p_partkey + 999000 BETWEEN 1000000 AND 9999999"""


# --- models: rows only -------------------------------------------------------------------------------------------------
def _samples(spark, sf_dir):
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id").select("doc_id", "source", F.length("text").cast("double").alias("chars"), F.regexp_count("text", F.lit(r"\S+")).cast("double").alias("words"), F.regexp_count("text", F.lit("[!%&|*$]")).cast("double").alias("signs"), (F.col("doc_id") % 7).cast("double").alias("noise"), F.lit(1.0).alias("constant"), "quality")


_FEATURES = ["chars", "words", "signs", "noise", "constant"]


def feature_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = models.feature_screen(_samples(spark, sf_dir).withColumn("gaps", F.when(F.col("doc_id") % 3 > 0, F.col("words"))), [*_FEATURES, "gaps"], "quality")
    return s.select("feature", *[F.round(c, 6).alias(c) for c in ("missing_pct", "mutual_information", "pearson", "spearman")])


_SCREEN_SQL = r"""WITH s AS (SELECT doc_id, quality AS y, CAST(length(text) AS DOUBLE) AS chars, CAST(len(regexp_extract_all(text, '\S+')) AS DOUBLE) AS words, CAST(length(regexp_replace(text, '[^!%&|*$]', '', 'g')) AS DOUBLE) AS signs, CAST(doc_id % 7 AS DOUBLE) AS noise FROM documents JOIN labels USING (doc_id)),
l AS (SELECT y, unnest([{'f': 'chars', 'x': chars}, {'f': 'words', 'x': words}, {'f': 'signs', 'x': signs}, {'f': 'noise', 'x': noise}, {'f': 'constant', 'x': CAST(1 AS DOUBLE)}, {'f': 'gaps', 'x': CASE WHEN doc_id % 3 > 0 THEN words END}], recursive := true) FROM s),
k AS (SELECT f, count(x) AS known, count(*) AS n FROM l GROUP BY f),
q AS (SELECT f, list_distinct(quantile_disc(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS cuts FROM l GROUP BY f),
r AS (SELECT f, x, y, CASE WHEN x IS NULL THEN 0.5 ELSE (rank() OVER (PARTITION BY f ORDER BY x NULLS LAST) - 1 + (count(*) OVER (PARTITION BY f, x) - 0) / 2.0) / known END AS rx,
  CASE WHEN x IS NULL THEN -1 ELSE len(list_filter(cuts, lambda c: c < x)) END AS b FROM l JOIN k USING (f) JOIN q USING (f)),
j AS (SELECT f, b, y, count(*) AS n FROM r GROUP BY ALL),
t AS (SELECT f, sum(n / tot * ln(n * tot / (nb * ny))) AS mi FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY f) AS DOUBLE) AS tot, sum(n) OVER (PARTITION BY f, b) AS nb, sum(n) OVER (PARTITION BY f, y) AS ny FROM j) GROUP BY f),
c AS (SELECT f, 100.0 * (1 - count(x) / count(*)) AS missing, CASE WHEN min(x) < max(x) THEN corr(x, y) END AS pearson, CASE WHEN min(x) < max(x) THEN corr(rx, y) END AS spearman FROM r GROUP BY f)
SELECT f AS feature, round(missing, 6) AS missing_pct, round(greatest(mi, 0), 6) AS mutual_information, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman FROM c JOIN t USING (f)"""


def stable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which features stay: each fold's model is judged with one feature after the other dealt anew."""
    features = ["chars", "words", "signs", "noise"]
    by = models.fold_importances(_samples(spark, sf_dir), features, "quality", "source", models.candidates()["logistic_regression"])
    return models.select_stable(by, forced=["words"])


def permuted_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each feature dealt anew: its rows, their sum, and those of the others, which stay as they were."""
    moved = models.permuted(_samples(spark, sf_dir).select("doc_id", "words", "signs"), ["words", "signs"])
    return moved.groupBy("feature").agg(F.count("*").alias("rows"), F.countDistinct("doc_id").alias("documents"), F.sum("words").alias("words"), F.sum("signs").alias("signs"), F.sum(F.col("words") * F.col("words")).alias("words_squared"), F.max("signs").alias("most_signs"))


_PERMUTED_SQL = r"""SELECT feature, count(*) AS rows, count(DISTINCT doc_id) AS documents, sum(words) AS words, sum(signs) AS signs, sum(words * words) AS words_squared, max(signs) AS most_signs
FROM (SELECT doc_id, CAST(len(regexp_extract_all(text, '\S+')) AS DOUBLE) AS words, CAST(length(regexp_replace(text, '[^!%&|*$]', '', 'g')) AS DOUBLE) AS signs FROM documents JOIN labels USING (doc_id)), (VALUES (''), ('words'), ('signs')) v(feature) GROUP BY feature"""


def grouped_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.grouped_cv(_samples(spark, sf_dir), ["chars", "words", "signs"], "quality", "source")


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _samples(spark, sf_dir).withColumn("prediction", (F.col("signs") < 20).cast("int"))
    m = models.confusion_metrics(s, ["source"], "quality")
    return m.select("source", "tp", "tn", "fp", "fn", F.round("balanced_accuracy", 6).alias("balanced_accuracy"), F.round("f1_macro", 6).alias("f1_macro"))


_CONFUSION_SQL = """WITH s AS (SELECT source, quality AS y, CASE WHEN length(regexp_replace(text, '[^!%&|*$]', '', 'g')) < 20 THEN 1 ELSE 0 END AS p FROM documents JOIN labels USING (doc_id)),
c AS (SELECT source, count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 0) AS tn, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn FROM s GROUP BY source),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p1, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r1, CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0 END AS p0, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END AS r0 FROM c)
SELECT source, tp, tn, fp, fn, round((r0 + r1) / 2, 6) AS balanced_accuracy, round(((CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0 END) + (CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0 END)) / 2, 6) AS f1_macro FROM m"""

QUERIES = {
    f.__name__: f
    for f in (
        waiting_stats, waiting_stats_by_type, label_vs_median, reconciliation, queue_wait, subject_merge, carbon_intensity, kwon_loss, jit_speed, route_losses, signals, admission, savings, route_cumulative, route_legs, position_along_route, nearest_time, route_weather,
        latest_per_key, topk_recent, latest_rows, session_assign, session_evolution, upsert, upsert_buckets, insert_ignore, lookup_join, message_dedup, keyed_zip, contract_split, contract_rows, message_counts, props_extract, text_cleaning, coverage_report, feature_profile, profile, register_derivation,
        feature_screen, stable_features, permuted_columns, grouped_cv, confusion, longest_waits, calls_by_priority, session_order, any_critical, silver_days,
    )
}
_EVENT_KIND = "CASE WHEN event_type = 'view' THEN 'Other' ELSE 'PositionReport' END"
SQL = {
    "waiting_stats": _stats_sql("destination_port_code, length_band"),
    "waiting_stats_by_type": _stats_sql("destination_port_code, length_band, ship_category"),
    "label_vs_median": f"WITH {_WAITS_SQL}, m AS (SELECT destination_port_code, length_band, round(CAST(quantile_disc(wait_hours, 0.5) AS DOUBLE), 2) AS med FROM waits WHERE wait_hours >= 0 GROUP BY ALL) SELECT destination_port_code, length_band, CASE WHEN wait_hours <= med THEN 1 ELSE 0 END AS jit_label, count(*) AS calls FROM waits JOIN m USING (destination_port_code, length_band) WHERE wait_hours >= 0 GROUP BY ALL",
    "reconciliation": f"WITH {_WAITS_SQL} SELECT count(*) AS port_calls FROM waits WHERE wait_hours >= 0",
    "queue_wait": _QUEUE_SQL,
    "subject_merge": "SELECT c_nationkey AS port, count(*) AS vessels, CAST(1 AS BIGINT) AS subjects, max(o_orderkey) AS subject FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey",
    "carbon_intensity": _CII_SQL,
    "kwon_loss": _KWON_SQL,
    "jit_speed": _JIT_SQL,
    "route_losses": "SELECT l_orderkey, CAST(count(*) AS INTEGER) AS legs, round(sum(l_extendedprice / 400 * l_discount * 300) / sum(l_extendedprice / 400), 4) AS mean_loss_pct, round(sum((l_extendedprice / 400) / greatest(12 * (1 - l_discount * 300 / 100), 0.5)), 4) AS hours FROM lineitem GROUP BY l_orderkey",
    "signals": _SIGNALS_SQL,
    "admission": "SELECT CASE WHEN m <> '' THEN 'MISSING_FIELDS' WHEN event_id % 4 = 0 THEN 'NOT_APPLICABLE' ELSE 'OK' END AS outcome, m AS missing, count(*) AS alerts FROM (SELECT event_id, concat_ws(',', CASE WHEN event_id % 9 = 0 OR event_type IS NULL THEN 'puerto' END, CASE WHEN event_id % 14 = 0 THEN 'lat_buque' END) AS m FROM events) GROUP BY ALL",
    "savings": _SAVINGS_SQL,
    "route_cumulative": f"WITH {_CUM_SQL} SELECT route_id, CAST(idx AS INTEGER) AS idx, round(leg_nm, 4) AS leg_nm, round(cum_nm, 3) AS cum_nm FROM cum",
    "route_legs": f"WITH {_POINTS_SQL}, n AS (SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2, lead(wind_kn) OVER w AS w2 FROM points WINDOW w AS (PARTITION BY route_id ORDER BY idx)) SELECT route_id, count(*) AS legs, round(sum({hav_sql('lat', 'lon', 'lat2', 'lon2')}), 3) AS nm, round(sum({bearing_sql('lat', 'lon', 'lat2', 'lon2')}), 2) AS courses, sum(w2) AS winds FROM n WHERE lat2 IS NOT NULL GROUP BY route_id",
    "position_along_route": _ALONG_SQL,
    "nearest_time": _NEAREST_SQL,
    "latest_per_key": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "topk_recent": "SELECT user_id, event_type, CAST(rn AS INTEGER) AS rank, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE ts >= TIMESTAMP '2024-01-20') WHERE rn <= 3",
    "latest_rows": "SELECT event_id FROM events ORDER BY ts DESC LIMIT 50",
    "session_assign": f"WITH {_SESSION_SQL} SELECT event_id, session_id FROM t",
    "session_evolution": f"WITH {_SESSION_SQL}, g AS (SELECT session_id, min(ts) AS a, max(ts) AS b, count(*) AS events, arg_min(value - 50, ts) AS f, arg_max(value - 50, ts) AS l FROM t GROUP BY session_id) SELECT session_id, round(f, 6) AS first_value, round(l, 6) AS last_value, CAST(floor(epoch(b)) - floor(epoch(a)) AS BIGINT) AS seconds, events, sign(f) <> sign(l) AS regime_changed FROM g",
    "upsert": "WITH u AS (SELECT c_custkey + CASE WHEN c_custkey % 20 = 3 THEN 10000000 ELSE 0 END AS c_custkey, 'NEW' AS c_mktsegment, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 10 = 3) SELECT * FROM u UNION ALL SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM u)",
    "upsert_buckets": "WITH u AS (SELECT c_custkey + CASE WHEN c_custkey % 20 = 3 THEN 10000000 ELSE 0 END AS c_custkey, 'NEW' AS c_mktsegment, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 10 = 3) SELECT * FROM u UNION ALL SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM u)",
    "insert_ignore": "SELECT c_custkey + 100 AS c_custkey, c_mktsegment FROM customer WHERE c_custkey + 100 NOT IN (SELECT c_custkey FROM customer)",
    "lookup_join": "SELECT s_name, sum(l_quantity) AS quantity, count(*) AS rows FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 3 <> 0) ON l_suppkey = s_suppkey GROUP BY s_name",
    "message_dedup": 'SELECT part, "offset", event_id FROM (SELECT event_id % 16 AS part, event_id // 32 AS "offset", event_id, row_number() OVER (PARTITION BY event_id % 16, event_id // 32 ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1',
    "keyed_zip": "WITH a AS (SELECT l_orderkey, count(*) AS n, count(CASE WHEN l_returnflag <> 'A' THEN 1 END) AS m FROM lineitem GROUP BY 1) SELECT n <> m AS blank, count(*) AS orders, CASE WHEN n <> m THEN NULL ELSE CAST(0 AS BIGINT) END AS difference FROM a GROUP BY 1, 3",
    "contract_split": f"SELECT CASE event_id % 9 WHEN 1 THEN 'lat' WHEN 2 THEN 'timestamp' WHEN 3 THEN 'mmsi' ELSE 'valid' END AS reason, count(*) AS messages FROM events WHERE {_EVENT_KIND} = 'PositionReport' AND event_id % 9 <> 4 GROUP BY 1",
    "contract_rows": f"SELECT user_id + 224000000 AS mmsi, strftime(ts, '%Y-%m-%d') AS day, '.123456+00:00' AS tail, count(*) AS messages, round(sum(value), 4) AS speed FROM events WHERE {_EVENT_KIND} = 'PositionReport' AND event_id % 9 NOT IN (1, 2, 3, 4) GROUP BY 1, 2",
    "message_counts": f"SELECT CASE WHEN event_id % 9 = 4 THEN 'unreadable' ELSE {_EVENT_KIND} END AS message_type, count(*) AS messages FROM events GROUP BY 1",
    "props_extract": "SELECT event_type, count(k) AS known, CAST(sum(k) AS BIGINT) AS total, max(k) AS most FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1",
    "text_cleaning": "SELECT p_partkey, upper(p_type) AS clean, CASE WHEN p_partkey % 5 <> 0 THEN 1000.5 + p_partkey % 1000 END AS number, CASE WHEN p_partkey % 5 <> 0 THEN CAST(1 AS DOUBLE) END AS first, regexp_replace(upper(p_type), '[^A-Z0-9]', '', 'g') AS plain FROM part",
    "coverage_report": "WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 8 <> 0 THEN o_totalprice END AS price, o_totalprice / 2 + 90000 AS part FROM orders) SELECT 'coverage_pct' AS \"check\", 'o_orderkey' AS subject, round(100.0 * count(o_orderkey) / count(*), 2) AS value FROM o UNION ALL SELECT 'coverage_pct', 'price', round(100.0 * count(price) / count(*), 2) FROM o UNION ALL SELECT 'coverage_pct', 'part', round(100.0 * count(part) / count(*), 2) FROM o UNION ALL SELECT 'out_of_range', 'price', count(CASE WHEN NOT price BETWEEN 0 AND 300000 THEN 1 END) FROM o UNION ALL SELECT 'part_over_whole', 'part>price', count(CASE WHEN part > price THEN 1 END) FROM o",
    "feature_profile": "SELECT 'quantity' AS feature, round(100 * avg(CASE WHEN l_linenumber = 3 THEN 1.0 ELSE 0 END), 4) AS missing_pct, count(DISTINCT CASE WHEN l_linenumber <> 3 THEN l_quantity END) AS distinct_values, false AS constant FROM lineitem UNION ALL SELECT 'l_returnflag', 0, count(DISTINCT l_returnflag), false FROM lineitem UNION ALL SELECT 'one', 0, 1, true FROM (SELECT count(*) FROM lineitem)",
    "profile": "SELECT count(*) AS rows, count(DISTINCT user_id) AS entities, min(ts) AS first, max(ts) AS last FROM events",
    "register_derivation": _REGISTER_SQL,
    "confusion": _CONFUSION_SQL,
    "feature_screen": _SCREEN_SQL,
    "route_weather": _ROUTE_WEATHER_SQL,
    "permuted_columns": _PERMUTED_SQL,
    "longest_waits": f"WITH {_WAITS_SQL} SELECT o_orderkey, l_linenumber, destination_port_code, wait_hours FROM waits WHERE wait_hours >= 0 ORDER BY wait_hours DESC, o_orderkey, l_linenumber",
    "calls_by_priority": f"WITH {_WAITS_SQL} SELECT o_orderkey, l_linenumber, ship_category, wait_hours FROM waits WHERE wait_hours >= 0 ORDER BY CASE WHEN ship_category = 'F' THEN 0 ELSE 1 END, wait_hours DESC, o_orderkey, l_linenumber",
    "session_order": f"WITH {_SESSION_SQL} SELECT session_id, ts, event_id FROM t ORDER BY session_id, ts, event_id",
    "any_critical": "SELECT user_id, coalesce(bool_or(event_type = 'purchase' AND value > 50), false) AS any_flagged FROM events GROUP BY user_id",
    "silver_days": "SELECT CAST(ts AS DATE) AS day, count(*) AS positions, count(CASE WHEN event_id % 5 <> 0 THEN value END) AS with_speed, count(DISTINCT user_id) AS vessels FROM events WHERE event_id % 7 <> 0 AND user_id IS NOT NULL AND event_id % 9 <> 1 AND event_id % 11 <> 0 AND event_type IS NOT NULL AND ts >= TIMESTAMP '2024-01-10' AND (event_id % 5 = 0 OR value IS NULL OR value >= 0) GROUP BY 1",
}
