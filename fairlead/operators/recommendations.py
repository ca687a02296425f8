"""Recommendations: admission of alerts and the nested event that is published."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.functions.voyage import CO2_PER_FUEL

MANDATORY = ["puerto", "lat_buque", "lon_buque", "lat_port", "lon_port", "velocidad_buque"]


def admit(alerts: DataFrame, mandatory: list[str] = MANDATORY, speed: str = "velocidad_buque", least_speed: float = 0.0) -> DataFrame:
    """missing_fields, and outcome: MISSING_FIELDS, NOT_APPLICABLE (the vessel does not move) or OK."""
    gaps = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in mandatory]), lambda x: x.isNotNull())
    out = alerts.withColumn("missing_fields", gaps)
    return out.withColumn("outcome", F.when(F.size("missing_fields") > 0, "MISSING_FIELDS").when(F.col(speed) <= least_speed, "NOT_APPLICABLE").otherwise("OK"))


def savings(df: DataFrame) -> DataFrame:
    """From cii_now, cii_jit, co2_now_kg, co2_jit_kg, dwt_real_t, wait_h, eta_dynamic_h, transit_h, event_time: what the
    recommendation changes. Fuel is only stated for a real deadweight."""
    later = lambda h: F.timestamp_micros(F.unix_micros(F.col("event_time").cast("timestamp")) + F.round(h * 3_600_000_000).cast("long"))
    return df.withColumns(
        {
            "saving_pct": F.when(F.col("cii_now") != 0, F.round(100 * (F.col("cii_now") - F.col("cii_jit")) / F.col("cii_now"), 1)),
            "idle_hours_avoided": F.round(F.when(F.col("eta_dynamic_h").isNotNull(), F.greatest(F.lit(0.0), F.col("wait_h") - F.col("eta_dynamic_h"))), 2),
            "fuel_saved_t": F.when(F.col("dwt_real_t").isNotNull(), F.round((F.col("co2_now_kg") - F.col("co2_jit_kg")) / CO2_PER_FUEL / 1000, 3)),
            "eta_current": later(F.col("eta_dynamic_h")),
            "eta_optimized": later(F.col("transit_h")),
        }
    ).withColumn("eta_difference_h", F.round((F.unix_micros("eta_optimized") - F.unix_micros("eta_current")) / 3_600_000_000, 1)).withColumn("worse_cii", F.coalesce(F.col("saving_pct") < 0, F.lit(False)))


def context_lists(vessels: DataFrame, estimates: DataFrame, subjects: DataFrame) -> DataFrame:
    """By port: berthed, anchored and inbound vessels as arrays of structs, the subject vessel marked, waits where known."""
    waits = estimates.select("port", "mmsi", F.col("wait_h").alias("estimated_wait_hours"))
    who = subjects.select("port", "mmsi", F.lit(True).alias("__subject"))
    v = vessels.join(waits, ["port", "mmsi"], "left").join(who, ["port", "mmsi"], "left").withColumn("es_objetivo", F.coalesce("__subject", F.lit(False)))
    plain = F.struct("list_pos", "mmsi", "lat", "lon", "es_objetivo")
    waiting = F.struct("list_pos", "mmsi", "lat", "lon", "es_objetivo", "estimated_wait_hours")
    listed = lambda state, s: F.transform(F.array_sort(F.collect_list(F.when(F.col("state") == state, s))), lambda x: x.dropFields("list_pos"))
    return v.groupBy("port").agg(listed("ATRACADO", plain).alias("berthed"), listed("FONDEADO", waiting).alias("anchored"), listed("EN_CAMINO", waiting).alias("inbound"))


def others(vessels, flag: str = "es_objetivo"):
    """A context list without the subject vessel."""
    return F.filter(vessels, lambda x: ~F.coalesce(x[flag], F.lit(False)))


def recommendation_event(df: DataFrame) -> DataFrame:
    """The nested event from flat columns (and the arrays berthed, anchored, inbound, waypoints, route_weather)."""
    s = lambda *names: F.struct(*[F.col(n) if isinstance(n, str) else F.col(n[0]).alias(n[1]) for n in names])
    size = lambda c: F.greatest(F.size(F.col(c)), F.lit(0))
    return df.select(
        "event_id", "session_id", "emitted_at", F.lit(1).alias("schema_version"),
        F.struct("mmsi", "imo", "name", F.col("lat").alias("lat"), "lon", F.col("speed").alias("speed_kn"), F.col("cog").alias("heading"), "nav_status", F.col("port_name").alias("destination_raw"), F.col("event_time").alias("position_at"), (F.col("type_key") == "container").alias("is_container")).alias("vessel"),
        F.struct(F.col("port_name").alias("name"), F.col("port_lat").alias("lat"), F.col("port_lon").alias("lon"), size("berthed").alias("berthed_count"), size("anchored").alias("anchored_count"), size("inbound").alias("inbound_count")).alias("port"),
        s("berthed", "anchored", "inbound").alias("context_vessels"),
        s("distance_nm", "duration_hours", "waypoints").alias("route"),
        "route_weather",
        F.struct(F.col("wait_h").alias("estimated_wait_hours"), "queue_position", F.col("segment").alias("berth_segment")).alias("queue"),
        F.struct(
            F.col("jit_speed_kn").alias("recommended_speed_kn"), "design_speed_kn", F.round(F.col("jit_speed_kn") - F.col("speed"), 2).alias("speed_delta_kn"), F.col("transit_h").alias("estimated_transit_hours"), "eta_current", "eta_optimized",
            "idle_hours_avoided", "fuel_saved_t", F.col("summary").alias("rationale"), "convergio", "excede_v_diseno", F.col("worse_cii").alias("alerta_cii"), F.col("mean_loss_pct").alias("weather_speed_loss_pct"),
            F.struct(F.col("cii_now").alias("inicial"), F.col("cii_jit").alias("jit"), F.col("cii_method").alias("metodo"), F.col("saving_pct").alias("ahorro_pct")).alias("cii"),
        ).alias("recommendation"),
    )
