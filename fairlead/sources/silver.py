"""Canonical tables of positions and static records: names, types and row checks over what the contracts let through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Canonical name, column it comes from, type.
_POSITION = [
    ("latitude", "lat", "double"),
    ("longitude", "lon", "double"),
    ("speed_over_ground_knots", "speed", "double"),
    ("course_over_ground_degrees", "cog", "double"),
    ("true_heading_degrees", "heading", "int"),
    ("navigation_status_code", "nav_status", "int"),
]
_STATIC = [
    ("imo", "imo", "bigint"),
    ("ship_type_code", "ship_type", "int"),
    ("vessel_length_meters", "length_m", "int"),
    ("vessel_beam_meters", "beam_m", "int"),
    ("vessel_draught_meters", "draught_m", "double"),
    ("eta_raw", "eta", "string"),
]
_TECHNICAL = [
    ("correlation_id", "correlation_id", "string"),
    ("kafka_ingestion_timestamp", "_kafka_ingestion_time", "timestamp"),
    ("kafka_partition", "_kafka_partition", "bigint"),
    ("kafka_offset", "_kafka_offset", "bigint"),
    ("schema_version", "_schema_version", "bigint"),
]


def _cast(columns) -> list[Column]:
    return [F.col(source).cast(kind).alias(name) for name, source, kind in columns]


def _day() -> Column:
    """The day in a source file's ``_dt=`` folder; null without one."""
    return F.to_date(F.nullif(F.regexp_extract("source_file", r"_dt=(\d{4}-\d{2}-\d{2})", 1), F.lit("")))


def _kept(bronze: DataFrame, start: str, *rules: Column) -> DataFrame:
    """Rows with all keys, from the day ``start`` on, for which every rule holds; a null rule does not hold."""
    keys = [F.col(c).isNotNull() for c in ("mmsi", "correlation_id", "_kafka_partition", "_kafka_offset")]
    holds = _day() >= F.lit(start).cast("date")
    for rule in (*keys, *rules):
        holds = holds & rule
    return bronze.where(holds)


def silver_positions(bronze: DataFrame, start: str) -> DataFrame:
    """Positions under their canonical names, each (partition, offset) once. Coordinates out of range, negative speeds and
    unreadable times are left out; a missing speed is allowed."""
    at = F.col("timestamp").cast("string").try_cast("timestamp")
    sound = (at.isNotNull(), F.col("lat").between(-90, 90), F.col("lon").between(-180, 180), F.col("speed").isNull() | (F.col("speed") >= 0))
    out = _kept(bronze, start, *sound).select(
        F.col("mmsi").cast("bigint").alias("mmsi"),
        at.alias("event_timestamp"),
        at.cast("date").alias("event_date"),
        *_cast(_POSITION + _TECHNICAL),
        _day().alias("bronze_partition_date"),
        "source_file",
    )
    return out.dropDuplicates(["kafka_partition", "kafka_offset"]).withColumn("silver_processed_timestamp", F.current_timestamp())


def silver_static(bronze: DataFrame, start: str) -> DataFrame:
    """Static records under their canonical names, each (partition, offset) once; blank names are null."""
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    out = _kept(bronze, start).select(
        F.col("mmsi").cast("bigint").alias("mmsi"),
        text("name").alias("vessel_name"),
        text("callsign").alias("call_sign"),
        text("destination").alias("destination_raw"),
        F.regexp_replace(F.upper(F.trim("destination")), "[^A-Z0-9]", "").alias("destination_clean"),
        *_cast(_STATIC + _TECHNICAL),
        _day().alias("bronze_partition_date"),
        "source_file",
    )
    return out.dropDuplicates(["kafka_partition", "kafka_offset"]).withColumn("silver_processed_timestamp", F.current_timestamp())
