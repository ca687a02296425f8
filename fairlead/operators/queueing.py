"""Berth queues: expected waits of anchored and inbound vessels by port and berth segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MANOEUVRE_H, DEFAULT_LENGTH_M, BERTH_MARGIN = 1.0, 150.0, 1.2
# Mean service hours and coefficient of variation by ship type.
SERVICE = {
    "container": (28.0, 0.38), "bulk": (42.0, 0.38), "tanker": (49.0, 0.49), "general_cargo": (36.0, 0.40), "roro": (24.0, 0.30), "lng": (52.0, 0.50), "offshore": (20.0, 0.35), "passenger": (10.0, 0.25), "other": (36.0, 0.40),
}
# Factor of the service time by length (below the bound); longer, or negative, as the last.
LENGTH_FACTORS = [(100, 1.03), (200, 1.00), (300, 1.28)]
LONGEST_FACTOR = 1.43
# Berth segments by length (below the bound).
SEGMENTS = [(150, "small"), (250, "medium"), (350, "large")]
LONGEST_SEGMENT = "vlarge"
# Names of ship types as feeds write them, lower case with underscores.
TYPE_NAMES = {
    "contenedor": "container", "portacontenedores": "container", "granelero": "bulk", "bulk_carrier": "bulk", "petrolero": "tanker", "oil_tanker": "tanker", "chemical_tanker": "tanker", "gas_carrier": "lng", "lng_tanker": "lng",
    "ro-ro": "roro", "roro_cargo": "roro", "cargo": "general_cargo", "general": "general_cargo", "supply": "offshore", "offshore_supply": "offshore", "container_ship": "container", "container/ro-ro_cargo_ship": "container",
    "general_cargo_ship": "general_cargo", "refrigerated_cargo_carrier": "general_cargo", "combination_carrier": "bulk", "vehicle_carrier": "roro", "ro-ro_ship": "roro", "lng_carrier": "lng", "passenger_ship": "passenger",
    "passenger_ship_(cruise_passenger_ship)": "passenger", "ro-pax_ship": "passenger", "other_ship_types_(offshore)": "offshore", "other_ship_types": "other",
}
# Queue order of states; berthed vessels are served already.
STATE_ORDER = {"FONDEADO": 0, "EN_CAMINO": 1}


def _map(pairs) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs for x in kv])


def service_type(raw) -> Column:
    key = F.replace(F.lower(F.trim(F.col(raw) if isinstance(raw, str) else raw)), F.lit(" "), F.lit("_"))
    code = F.when(key.rlike(r"^\d+$"), key.try_cast("int"))
    by_code = (
        F.when(code.between(60, 69) | code.between(40, 49), "passenger").when(code.between(70, 79), "general_cargo").when(code.between(80, 89), "tanker").when(code.isin(31, 32, 33, 50, 51, 52, 53, 54), "offshore").otherwise("other")
    )
    named = F.when(key.isin(*SERVICE), key).otherwise(F.element_at(_map(TYPE_NAMES.items()), key))
    return F.when(code.isNotNull(), by_code).otherwise(F.coalesce(named, F.lit("other")))


def _by_length(length: Column, pairs, last) -> Column:
    out = F.when(length < 0, F.lit(last))
    for bound, value in pairs:
        out = out.when(length < bound, F.lit(value))
    return out.otherwise(F.lit(last))


def berth_segment(length) -> Column:
    return _by_length(F.col(length) if isinstance(length, str) else length, SEGMENTS, LONGEST_SEGMENT)


def length_factor(length) -> Column:
    return _by_length(F.col(length) if isinstance(length, str) else length, LENGTH_FACTORS, LONGEST_FACTOR)


def service_hours(kind: Column, length: Column) -> Column:
    return F.coalesce(F.element_at(_map((k, v[0]) for k, v in SERVICE.items()), kind), F.lit(36.0)) * length_factor(length)


def service_cv(kind: Column) -> Column:
    return F.coalesce(F.element_at(_map((k, v[1]) for k, v in SERVICE.items()), kind), F.lit(0.40))


def merge_subject(vessels: DataFrame, subject: DataFrame) -> DataFrame:
    """Vessel lists (port, mmsi, state, list_pos, ...) with each port's subject vessel marked, or added at the end of its
    state's list where no list has it."""
    keyed = subject.select("port", "mmsi", F.lit(True).alias("__subject"), *[F.col(c).alias(f"__{c}") for c in ("imo", "length_m")])
    marked = vessels.join(keyed, ["port", "mmsi"], "left")
    marked = marked.withColumns({"is_subject": F.coalesce("__subject", F.lit(False)), "imo": F.coalesce("imo", "__imo"), "length_m": F.coalesce("length_m", "__length_m")}).drop("__subject", "__imo", "__length_m")
    ends = vessels.groupBy("port", "state").agg(F.max("list_pos").alias("__last"))
    new = subject.join(vessels, ["port", "mmsi"], "left_anti").join(ends, ["port", "state"], "left")
    new = new.withColumn("list_pos", F.coalesce("__last", F.lit(-1)) + 1).withColumn("is_subject", F.lit(True))
    return marked.unionByName(new.select(*[c for c in marked.columns]))


def port_queue_wait(vessels: DataFrame, berths: DataFrame | None = None) -> DataFrame:
    """Expected wait of every anchored or inbound vessel.

    ``vessels``: port, mmsi, state (ATRACADO, FONDEADO, EN_CAMINO), list_pos, length_m, ship_type. ``berths``: port,
    segment, berths; inferred from the berthed vessels where None. A berth comes free after the mean residual service of
    those in it over their number; each place in the queue adds its own service over the berths.
    """
    v = vessels.withColumn("length_m", F.coalesce("length_m", F.lit(DEFAULT_LENGTH_M)))
    v = v.withColumns({"segment": berth_segment("length_m"), "__kind": service_type("ship_type")})
    v = v.withColumn("service_h", service_hours(F.col("__kind"), F.col("length_m")))
    berthed = v["state"] == "ATRACADO"
    residual = F.col("service_h") / 2 * (1 + F.pow(service_cv(F.col("__kind")), F.lit(2)))
    seg = v.groupBy("port", "segment").agg(F.count(F.when(berthed, 1)).alias("berthed"), F.avg(F.when(berthed, residual)).alias("__residual"))
    capacity = F.greatest(F.lit(1), F.ceil(F.round(F.col("berthed") * BERTH_MARGIN, 9)).cast("int"))
    if berths is None:
        seg = seg.withColumn("berths", capacity)
    else:
        seg = seg.join(berths, ["port", "segment"], "left").withColumn("berths", F.greatest(F.lit(1), F.coalesce("berths", F.lit(1))))
    seg = seg.withColumn("release_h", F.when(F.col("berthed") == 0, 0.0).otherwise(F.col("__residual") / F.greatest(F.lit(1), F.least("berthed", "berths"))))
    rank = F.element_at(_map(STATE_ORDER.items()), F.col("state"))
    queue = v.where(F.col("state").isin(*STATE_ORDER)).withColumn("queue_position", F.row_number().over(W.partitionBy("port", "segment").orderBy(rank, "list_pos", "mmsi")))
    out = queue.join(seg.select("port", "segment", "berths", "release_h"), ["port", "segment"])
    out = out.withColumn("queue_h", F.col("release_h") + (F.col("queue_position") - 1) * F.col("service_h") / F.col("berths"))
    return out.withColumn("wait_h", F.round(F.col("queue_h") + MANOEUVRE_H, 1)).drop("__kind")


def subject_wait(estimates: DataFrame, subject: DataFrame) -> DataFrame:
    """The subject vessels' waits; one that is berthed does not wait."""
    found = estimates.where("is_subject").select("port", "mmsi", "segment", "queue_position", "wait_h")
    out = subject.join(found, ["port", "mmsi"], "left")
    berthed = F.col("state") == "ATRACADO"
    return out.withColumns({"wait_h": F.when(berthed, 0.0).otherwise(F.col("wait_h")), "queue_position": F.when(berthed, 0).otherwise(F.col("queue_position"))})
