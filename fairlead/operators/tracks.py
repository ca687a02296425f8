"""Vessel tracks: kinematics from the previous fix, implausible jumps, destinations, arrival times, port state, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fairlead.functions.geo import great_circle_nm

from . import slices
from .joins import small_side

IMPLAUSIBLE_KN = 50
CARGO_TYPES = (70, 79)
MOVING_KN = 0.5
ALERT_HOURS, INBOUND_HOURS, CONGESTED_FROM = 48, 72, 1
SPOOFED = "SPOOFING_IMPOSSIBLE_SPEED"
# Ports of interest in order of precedence, as captains write them.
PORTS = [
    {"name": "VALENCIA", "aliases": ["VALENCIA", "VLC", "VLNCIA", "ES VAL", "VALE"], "lat": 39.4457, "lon": -0.3198, "radius_nm": 5.0},
    {"name": "ALGECIRAS", "aliases": ["ALGECIRAS", "ALGEC", "ALG", "ES ALG", "ALGE"], "lat": 36.12972, "lon": -5.42278, "radius_nm": 5.0},
    {"name": "BARCELONA", "aliases": ["BARCELONA", "BCN", "BARNA", "ES BCN", "BARCEL", "BARCN"], "lat": 41.338, "lon": 2.1675, "radius_nm": 5.0},
]
# Whole destinations, cleaned to letters and figures, by port code.
EXACT_DESTINATIONS = {"ESVLC": ("ESVLC", "VALENCIA", "VAL"), "ESBCN": ("ESBCN", "BARCELONA", "BCN"), "ESALG": ("ESALG", "ALGECIRAS", "ALG")}
PORT_NAMES = {"ESVLC": "Valencia", "ESBCN": "Barcelona", "ESALG": "Algeciras"}


def port_table(spark: SparkSession, ports=PORTS) -> DataFrame:
    return spark.createDataFrame([(p["name"], p["aliases"], p["lat"], p["lon"], p["radius_nm"], i) for i, p in enumerate(ports)], "port_name string, aliases array<string>, port_lat double, port_lon double, port_radius_nm double, precedence int")


def enrich_track(positions: DataFrame, key: str = "mmsi", time: str = "event_time", slice_hours: float | None = None) -> DataFrame:
    """Previous fix, distance, hours and implied speed; null at a first fix, and speed null where no time has passed. With
    ``slice_hours`` a vessel's track is dealt over several tasks (see ``slices``), with equal rows."""
    before = ("lat", "lon", time)
    if slice_hours:
        named = {f"prev_{c}": F.col(c) for c in before}
        return movement(slices.whole(slices.along(slices.sliced(positions, [key], time, slice_hours), [time], previous=named)), time)
    order = W.partitionBy(key).orderBy(time)
    return movement(positions.withColumns({f"prev_{c}": F.lag(c).over(order) for c in before}), time)


def movement(fixes: DataFrame, time: str = "event_time") -> DataFrame:
    """Distance, hours and implied speed between a fix and its previous one (prev_lat, prev_lon, prev_<time>)."""
    hours = F.unix_timestamp(time) - F.unix_timestamp(f"prev_{time}")
    return (
        fixes.withColumn("distance_nm", great_circle_nm("prev_lat", "prev_lon", "lat", "lon"))
        .withColumn("delta_h", hours / 3600.0)
        .withColumn("implied_kn", F.when(F.col("delta_h") > 0, F.col("distance_nm") / F.col("delta_h")))
    )


def plausible(threshold: float = IMPLAUSIBLE_KN) -> Column:
    """True, or null where the implied speed is unknown for another reason than a first fix or no time passed."""
    return (F.col("implied_kn") <= threshold) | F.col("distance_nm").isNull() | (F.col("delta_h") <= 0)


def split_spoofing(track: DataFrame, threshold: float = IMPLAUSIBLE_KN) -> tuple[DataFrame, DataFrame]:
    """(valid, jumps): a row whose test is null goes to neither."""
    jumps = track.where(F.col("implied_kn") > threshold).withColumn("reason", F.lit(SPOOFED)).withColumn("threshold_kn", F.lit(float(threshold)))
    return track.where(plausible(threshold)), jumps


def alias_filter(destination: str = "destination", ports=PORTS) -> Column:
    """Some port's alias is within the destination."""
    aliases = [a for p in ports for a in p["aliases"]]
    if not aliases:
        raise ValueError("no ports to look for")
    found = F.lit(False)
    for a in aliases:
        found = found | F.contains(F.upper(destination), F.lit(a))
    return found


def target_fleet(static: DataFrame, ports=PORTS) -> DataFrame:
    return static.where(F.col("ship_type").between(*CARGO_TYPES) & alias_filter("destination", ports))


def resolve_destination(df: DataFrame, destination: str = "destination", ports=PORTS, default: str = "UNKNOWN") -> DataFrame:
    """port_name, port_lat, port_lon, port_radius_nm of the first port with an alias in the destination."""
    upper = F.upper(destination)
    chosen = None
    for p in ports:
        hit = F.lit(False)
        for a in p["aliases"]:
            hit = hit | F.contains(upper, F.lit(a))
        value = F.struct(F.lit(p["name"]).alias("name"), F.lit(p["lat"]).alias("lat"), F.lit(p["lon"]).alias("lon"), F.lit(p["radius_nm"]).alias("radius"))
        chosen = F.when(hit, value) if chosen is None else chosen.when(hit, value)
    df = df.withColumn("__port", chosen)
    return df.withColumns({"port_name": F.coalesce("__port.name", F.lit(default)), "port_lat": F.col("__port.lat"), "port_lon": F.col("__port.lon"), "port_radius_nm": F.col("__port.radius")}).drop("__port")


def resolve_by_aliases(df: DataFrame, row_id: str, aliases: DataFrame, destination: str = "destination") -> DataFrame:
    """The same for an alias table (alias, port_name, precedence) of any size: the first alias by precedence wins.

    Aliases are met by their first three letters at each place of the destination, not with every row. A small alias table
    is broadcast and a larger one meets by a shuffle; the pieces of destinations, many for a row, are never broadcast.
    """
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(destination) - 2, F.lit(1))), lambda i: F.substr(F.upper(destination), i, F.lit(3)))
    pieces = df.where(F.length(destination) >= 3).select(row_id, F.upper(destination).alias("__text"), F.explode(F.array_distinct(cut)).alias("__start"))
    keyed = aliases.where(F.length("alias") >= 3).withColumn("__start", F.substring(F.upper("alias"), 1, 3))
    met = pieces.hint("merge").join(small_side(keyed), "__start").where(F.contains("__text", F.upper("alias")))
    best = met.groupBy(row_id).agg(F.min_by("port_name", F.struct("precedence", "alias")).alias("port_name"))
    return df.join(best.hint("merge"), row_id, "left")


def exact_port_code(destination: str = "destination") -> Column:
    clean = F.regexp_replace(F.upper(destination), "[^A-Z0-9]", "")
    out = None
    for code, names in EXACT_DESTINATIONS.items():
        out = F.when(clean.isin(*names), code) if out is None else out.when(clean.isin(*names), code)
    return out


def exact_port_name(code: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in PORT_NAMES.items() for x in kv]), code)


def dynamic_eta(df: DataFrame) -> DataFrame:
    """distance_to_port_nm, and eta_hours at the present speed for vessels on the move."""
    return df.withColumn("distance_to_port_nm", great_circle_nm("lat", "lon", "port_lat", "port_lon")).withColumn("eta_hours", F.when(F.col("speed") > MOVING_KN, F.col("distance_to_port_nm") / F.col("speed")))


def port_status(inbound_hours: float = INBOUND_HOURS) -> Column:
    """From distance_to_port_nm, nav_status, speed and eta_hours; the three states exclude one another."""
    near = F.col("distance_to_port_nm") <= F.col("port_radius_nm")
    return (
        F.when((F.col("nav_status") == 5) & near, "ATRACADO")
        .when((F.col("nav_status") == 1) & near, "FONDEADO")
        .when((F.col("distance_to_port_nm") > F.col("port_radius_nm")) & (F.col("speed") > MOVING_KN) & (F.col("eta_hours") <= inbound_hours), "EN_CAMINO")
    )


def port_inventory(df: DataFrame, inbound_hours: float = INBOUND_HOURS) -> DataFrame:
    """One scan: rows with a state, distances computed once."""
    return dynamic_eta(df).withColumn("vessel_status", port_status(inbound_hours)).where(F.col("vessel_status").isNotNull())


def unique_inventory(inventory: DataFrame, minutes: int = 1, time: str = "event_time") -> DataFrame:
    """Each vessel once in a port, state and tumbling window."""
    return inventory.groupBy("port_name", "vessel_status", "mmsi", "length_m", "ship_type", F.window(time, f"{minutes} minutes").alias("window")).agg(F.count("*").alias("fixes"))


def _vessels(state: str) -> Column:
    item = F.struct(F.col("mmsi"), F.col("length_m").alias("eslora"), F.col("ship_type").alias("tipo_buque"))
    return F.array_sort(F.collect_list(F.when(F.col("vessel_status") == state, item)))


def port_summary(unique: DataFrame) -> DataFrame:
    """Of each port and window: how many vessels hold berth or anchorage, and the vessels by state as JSON arrays."""
    congested = F.size(F.collect_set(F.when(F.col("vessel_status").isin("ATRACADO", "FONDEADO"), F.col("mmsi"))))
    as_json = lambda s: F.to_json(_vessels(s), {"ignoreNullFields": "false"})
    return unique.groupBy("port_name", "window").agg(
        congested.alias("congested_count"), as_json("ATRACADO").alias("atracados_json"), as_json("FONDEADO").alias("fondeados_json"), as_json("EN_CAMINO").alias("en_camino_json")
    )


def congestion(unique: DataFrame) -> DataFrame:
    """Of each port and window: congested_count as in ``port_summary``, and how many berthed, without the vessels' lists,
    so that no window's vessels are gathered in one place."""
    holds = F.col("vessel_status").isin("ATRACADO", "FONDEADO") & F.col("mmsi").isNotNull()
    by_vessel = unique.groupBy("port_name", "window", "mmsi").agg(F.max(holds.cast("int")).alias("__holds"), F.count(F.when(F.col("vessel_status") == "ATRACADO", 1)).alias("__berthed"))
    return by_vessel.groupBy("port_name", "window").agg(F.sum("__holds").alias("congested_count"), F.sum("__berthed").alias("berthed"))


def eta_candidates(eta: DataFrame, minutes: int = 1, time: str = "event_time", tiebreak: str = "correlation_id") -> DataFrame:
    """The earliest fix of each vessel and window, whole."""
    whole = F.struct(*[F.col(c) for c in eta.columns])
    return eta.where(F.col("eta_hours").isNotNull()).groupBy("mmsi", F.window(time, f"{minutes} minutes").alias("window")).agg(F.min_by(whole, F.struct(time, tiebreak)).alias("row")).select("window", "row.*")


def bound_for_congestion(candidates: DataFrame, summary: DataFrame, horizon_hours: float = ALERT_HOURS, congested_from: int = CONGESTED_FROM) -> DataFrame:
    """Candidates bound for a congested port soon. ``summary``: of ``port_summary`` or ``congestion``."""
    return candidates.join(summary, ["port_name", "window"]).where((F.col("congested_count") >= congested_from) & (F.col("eta_hours") <= horizon_hours))


def eta_alerts(candidates: DataFrame, summary: DataFrame, horizon_hours: float = ALERT_HOURS, congested_from: int = CONGESTED_FROM) -> DataFrame:
    """The same with the two-part JSON payload. Each holds the lists of all its window's vessels, so the payloads grow with
    alerts times vessels; who needs counts only takes ``congestion``."""
    met = bound_for_congestion(candidates, summary, horizon_hours, congested_from)
    names = {"mmsi": "mmsi", "correlation_id": "correlation_id", "imo": "imo", "port_name": "puerto", "nav_status": "estado", "lon": "lon_buque", "lat": "lat_buque", "port_lon": "lon_port", "port_lat": "lat_port", "cog": "direccion", "speed": "velocidad_buque", "length_m": "eslora", "beam_m": "manga", "draught_m": "calado_de_diseno", "ship_type": "tipo_buque"}
    have = set(met.columns)
    first = [F.col(c).alias(n) if c in have else F.lit(None).cast("string").alias(n) for c, n in names.items()]
    first += [F.col("eta_hours").alias("ETA_dynamic"), F.col("eta_hours").alias("ETA"), (F.col("eta_static_raw") if "eta_static_raw" in have else F.lit(None).cast("string")).alias("ETA_static")]
    lists = F.concat(*[x for n, c in (('"num_buques_atracados":', "atracados_json"), (',"num_buques_fondeados":', "fondeados_json"), (',"num_buques_en_camino":', "en_camino_json")) for x in (F.lit(n), F.coalesce(c, F.lit("[]")))])
    body = F.concat(F.lit('{"paquete_1":'), F.to_json(F.struct(*first), {"ignoreNullFields": "false"}), F.lit(',"paquete_2":{"puerto":"'), F.col("port_name"), F.lit('","estados":{'), lists, F.lit("}}}"))
    return met.withColumn("payload_json", body)
