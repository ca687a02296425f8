"""Streams of positions: previous fix by keyed state, latest vessel record, windows, dedup, alerts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fairlead.functions.geo import great_circle_nm
from fairlead.operators.tracks import dynamic_eta, eta_alerts, eta_candidates, port_inventory, unique_inventory

STATE_DAYS = 30
LATENESS = "1 minute"
_STATE = "lat double, lon double, at long"
_OUT = "mmsi long, event_time timestamp, lat double, lon double, speed double, nav_status int, prev_lat double, prev_lon double, prev_event_time timestamp"


def _previous(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A vessel's rows of this batch in time order, each with the one before; the last is kept for the next batch. A row
    older than the one kept is not after it and gets no previous fix."""
    if state.hasTimedOut:
        state.remove()
        return
    rows = pd.concat(list(frames)).sort_values("event_time", kind="stable").reset_index(drop=True)
    lat, lon, at = state.get if state.exists else (None, None, None)
    before = pd.DataFrame({"prev_lat": rows["lat"].shift(1), "prev_lon": rows["lon"].shift(1), "prev_event_time": rows["event_time"].shift(1)})
    if at is not None and len(rows):
        kept = pd.Timestamp(at, unit="us", tz=rows["event_time"].dt.tz)
        late = rows["event_time"] < kept
        before.loc[late, :] = None
        first = late.sum()
        if first < len(rows):
            before.loc[first, ["prev_lat", "prev_lon"]] = (lat, lon)
            before.loc[first, "prev_event_time"] = kept
    if len(rows):
        last = rows.iloc[-1]
        micros = int(last["event_time"].value // 1000)
        if at is None or micros >= at:
            state.update((float(last["lat"]), float(last["lon"]), micros))
        expires = max(micros, at or 0) // 1000 + STATE_DAYS * 24 * 3600 * 1000
        state.setTimeoutTimestamp(max(expires, state.getCurrentWatermarkMs() + 1))
    yield pd.concat([rows, before], axis=1)


def previous_fix(positions: DataFrame) -> DataFrame:
    """The stream's own LAG: mmsi, event_time, lat, lon, speed, nav_status and the previous fix, with distance and speed.

    A vessel is forgotten ``STATE_DAYS`` of event time after its last fix."""
    base = positions.withWatermark("event_time", LATENESS).select(F.col("mmsi").cast("long").alias("mmsi"), "event_time", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.col("speed").cast("double").alias("speed"), F.col("nav_status").cast("int").alias("nav_status"))
    out = base.groupBy("mmsi").applyInPandasWithState(_previous, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    hours = (F.unix_timestamp("event_time") - F.unix_timestamp("prev_event_time")) / 3600.0
    return out.withColumn("distance_nm", great_circle_nm("prev_lat", "prev_lon", "lat", "lon")).withColumn("delta_h", hours).withColumn("implied_kn", F.when(F.col("delta_h") > 0, F.col("distance_nm") / F.col("delta_h")))


def distinct_messages(stream: DataFrame, time: str = "_ingestion_time", lateness: str = "10 minutes") -> DataFrame:
    """Each (partition, offset) once; the memory of those seen is bounded by the watermark."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(["_partition", "_offset"])


def with_static(positions: DataFrame, static: DataFrame, days: int = STATE_DAYS) -> DataFrame:
    """Each position with every static record of its vessel received in the ``days`` before it."""
    p = positions.withWatermark("event_time", LATENESS)
    s = static.select(F.col("mmsi").alias("__mmsi"), F.col("_ingestion_time").alias("__at"), *[c for c in static.columns if c not in ("mmsi", "_ingestion_time")]).withWatermark("__at", LATENESS)
    return p.join(s, F.expr(f"mmsi = __mmsi AND __at <= event_time AND __at >= event_time - INTERVAL {days} DAYS")).drop("__mmsi", "__at")


def windowed_summary(resolved: DataFrame, minutes: int = 1, lateness: str = LATENESS) -> DataFrame:
    """Two windowed aggregations in a row, append only: vessels once by window, then by port. ``window`` closes with the
    watermark."""
    unique = unique_inventory(port_inventory(resolved.withWatermark("event_time", lateness)), minutes)
    again = unique.withColumn("at", F.window_time("window")).drop("window").groupBy("port_name", F.window("at", f"{minutes} minutes").alias("window"))
    congested = F.size(F.collect_set(F.when(F.col("vessel_status").isin("ATRACADO", "FONDEADO"), F.col("mmsi"))))
    listed = lambda s: F.to_json(F.array_sort(F.collect_list(F.when(F.col("vessel_status") == s, F.struct("mmsi", F.col("length_m").alias("eslora"), F.col("ship_type").alias("tipo_buque"))))), {"ignoreNullFields": "false"})
    return again.agg(congested.alias("congested_count"), listed("ATRACADO").alias("atracados_json"), listed("FONDEADO").alias("fondeados_json"), listed("EN_CAMINO").alias("en_camino_json"))


def windowed_alerts(resolved: DataFrame, minutes: int = 1, lateness: str = LATENESS) -> DataFrame:
    """The alert payloads of a stream of resolved positions, append only: each moving vessel's first fix of a window met
    with the port's summary of the same window. Windows close with the watermark, so one that spans micro-batches is
    counted whole and alerts once. Late rows beyond ``lateness`` and rows without time take no part."""
    candidates = eta_candidates(dynamic_eta(resolved.withWatermark("event_time", lateness)), minutes)
    return eta_alerts(candidates, windowed_summary(resolved, minutes, lateness))


def drain(stream: DataFrame, name: str, checkpoint: str | None = None, mode: str = "append"):
    """Takes all there is into a table in memory and stops; for tests and inspection."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return query
