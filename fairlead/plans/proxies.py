"""Vessel views of the driver's tables, written the same way for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as position reports: a user is a vessel, its destination one of three ports."""
    return fixes_of(table(spark, sf_dir, "events"))


def fixes_of(e: DataFrame) -> DataFrame:
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.col("user_id") % 3 + 1).cast("int"))
    return e.select(
        F.col("event_id"), F.col("user_id").alias("mmsi"), F.col("ts").alias("event_time"),
        (36 + (F.col("event_id") * 37 % 600) / 100.0).alias("lat"), (-6 + (F.col("event_id") * 53 % 900) / 100.0).alias("lon"), (F.col("value") / 10).alias("speed"),
        F.when(F.col("event_type") == "purchase", 5).when(F.col("event_type") == "signup", 1).otherwise(0).alias("nav_status"),
        (F.col("event_id") * 7 % 400).cast("double").alias("cog"), (100 + F.col("user_id") % 300).cast("int").alias("length_m"), (70 + F.col("user_id") % 10).cast("int").alias("ship_type"), F.col("event_id").cast("string").alias("correlation_id"),
        pick("VALENCIA", "ALGECIRAS", "BARCELONA").alias("port_name"), pick(39.4457, 36.12972, 41.338).alias("port_lat"), pick(-0.3198, -5.42278, 2.1675).alias("port_lon"), F.lit(60.0).alias("port_radius_nm"),
    )


FIXES_SQL = """
SELECT event_id, user_id AS mmsi, ts AS event_time, 36 + (event_id * 37 % 600) / 100.0 AS lat, -6 + (event_id * 53 % 900) / 100.0 AS lon, value / 10 AS speed,
  CASE WHEN event_type = 'purchase' THEN 5 WHEN event_type = 'signup' THEN 1 ELSE 0 END AS nav_status,
  CAST(event_id * 7 % 400 AS DOUBLE) AS cog, CAST(100 + user_id % 300 AS INTEGER) AS length_m, CAST(70 + user_id % 10 AS INTEGER) AS ship_type, CAST(event_id AS VARCHAR) AS correlation_id,
  CASE user_id % 3 WHEN 0 THEN 'VALENCIA' WHEN 1 THEN 'ALGECIRAS' ELSE 'BARCELONA' END AS port_name,
  CAST(CASE user_id % 3 WHEN 0 THEN 39.4457 WHEN 1 THEN 36.12972 ELSE 41.338 END AS DOUBLE) AS port_lat,
  CAST(CASE user_id % 3 WHEN 0 THEN -0.3198 WHEN 1 THEN -5.42278 ELSE 2.1675 END AS DOUBLE) AS port_lon, CAST(60 AS DOUBLE) AS port_radius_nm
FROM events
"""


#: Microseconds of the first instant of the events; their month is told as a fortieth of its length, so that fixes are minutes apart.
_T0, _SHRINK = 1_704_067_200_000_000, 40


def berthing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as position reports about three service points: a user is a vessel that comes and goes every six hours. It
    nears its port from the north, waits (a fifth of vessels do not stop for it, and half show no status) and is served (a
    seventh are not)."""
    e = table(spark, sf_dir, "events")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.col("user_id") % 3 + 1).cast("int"))
    micros = F.expr(f"(unix_micros(cast(ts AS timestamp)) - {_T0}) div {_SHRINK}")
    e = e.select("event_id", F.col("user_id").alias("mmsi"), F.timestamp_micros(micros + _T0).alias("event_time"), (F.expr(f"(unix_micros(cast(ts AS timestamp)) - {_T0}) div {_SHRINK * 60_000_000}") + F.col("user_id") * 37).alias("m"), pick("ESVLC", "ESALG", "ESBCN").alias("destination_port_code"), pick(39.4457, 36.12972, 41.338).alias("service_lat"), pick(-0.3198, -5.42278, 2.1675).alias("service_lon"))
    e = e.withColumn("m", F.col("m") % 360)
    stopped = ((F.col("m") >= 150) & (F.col("m") < 240) & (F.col("mmsi") % 5 != 0)) | (F.col("m") >= 240)
    served = (F.col("m") >= 240) & (F.col("mmsi") % 7 != 0)
    away = F.when(F.col("m") < 60, 1.5).when(F.col("m") < 150, 0.3 - (F.col("m") - 60) * 0.003).when(served, 0.002).otherwise(0.03)
    status = F.when(served, F.when(F.col("mmsi") % 4 != 0, 5)).when(stopped & (F.col("mmsi") % 2 == 0), 1).otherwise(0)
    return e.select(
        "event_id", "mmsi", "event_time", (F.col("service_lat") + away).alias("lat"), F.col("service_lon").alias("lon"),
        F.when(stopped & (F.col("event_id") % 11 != 0), (F.col("event_id") * 11 % 3) / 20.0).otherwise(8.0).alias("speed"), F.lit(180.0).alias("cog"), (F.col("event_id") % 360).cast("int").alias("heading"),
        status.alias("nav_status"), "destination_port_code", "service_lat", "service_lon", F.when(F.col("event_id") % 3 == 0, 9_000_000 + F.col("mmsi")).alias("imo"),
        F.when(F.col("event_id") % 2 == 0, 60 + F.col("mmsi") % 40).cast("int").alias("ship_type"), (50 + F.col("mmsi") % 400).cast("double").alias("length_m"),
    )


BERTHING_SQL = f"""
SELECT event_id, mmsi, event_time, m, destination_port_code, service_lat, service_lon,
  service_lat + CAST(CASE WHEN m < 60 THEN 1.5 WHEN m < 150 THEN 0.3 - (m - 60) * 0.003 WHEN served THEN 0.002 ELSE 0.03 END AS DOUBLE) AS lat, service_lon AS lon,
  CAST(CASE WHEN stopped AND event_id % 11 <> 0 THEN (event_id * 11 % 3) / 20.0 ELSE 8.0 END AS DOUBLE) AS speed, CAST(180 AS DOUBLE) AS cog, CAST(event_id % 360 AS INTEGER) AS heading,
  CASE WHEN served THEN CASE WHEN mmsi % 4 <> 0 THEN 5 END WHEN stopped AND mmsi % 2 = 0 THEN 1 ELSE 0 END AS nav_status,
  CASE WHEN event_id % 3 = 0 THEN 9000000 + mmsi END AS imo, CASE WHEN event_id % 2 = 0 THEN CAST(60 + mmsi % 40 AS INTEGER) END AS ship_type, CAST(50 + mmsi % 400 AS DOUBLE) AS length_m
FROM (SELECT *, m >= 240 AND mmsi % 7 <> 0 AS served, (m >= 150 AND m < 240 AND mmsi % 5 <> 0) OR m >= 240 AS stopped FROM (
  SELECT event_id, user_id AS mmsi, make_timestamp({_T0} + (epoch_us(ts) - {_T0}) // {_SHRINK}) AS event_time, ((epoch_us(ts) - {_T0}) // {_SHRINK * 60_000_000} + user_id * 37) % 360 AS m,
    CASE user_id % 3 WHEN 0 THEN 'ESVLC' WHEN 1 THEN 'ESALG' ELSE 'ESBCN' END AS destination_port_code,
    CAST(CASE user_id % 3 WHEN 0 THEN 39.4457 WHEN 1 THEN 36.12972 ELSE 41.338 END AS DOUBLE) AS service_lat,
    CAST(CASE user_id % 3 WHEN 0 THEN -0.3198 WHEN 1 THEN -5.42278 ELSE 2.1675 END AS DOUBLE) AS service_lon FROM events))
"""


def gc_sql(a: str, b: str, c: str, d: str) -> str:
    """Great-circle distance, as ``functions.geo.great_circle_nm``."""
    return f"(3440.065 * acos(least(1.0, greatest(-1.0, sin(radians({a})) * sin(radians({c})) + cos(radians({a})) * cos(radians({c})) * cos(radians({d}) - radians({b}))))))"


def hav_sql(a: str, b: str, c: str, d: str) -> str:
    return f"(2 * 3440.065 * asin(sqrt(least(1.0, greatest(0.0, pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2))))))"


def bearing_sql(a: str, b: str, c: str, d: str) -> str:
    y = f"sin(radians({d}) - radians({b})) * cos(radians({c}))"
    x = f"cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d}) - radians({b}))"
    return f"((degrees(atan2({y}, {x})) + 360) % 360)"
