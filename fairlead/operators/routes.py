"""Routes: cumulative distance, legs with weather, forecasts along the way, positions at a distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fairlead.functions.geo import angle_diff_deg, bearing_deg, haversine_nm
from fairlead.functions.voyage import kwon_loss_pct

from .joins import nearest_time_join

WEATHER_POINTS = 6


def cumulative(points: DataFrame, route: str = "route_id", idx: str = "idx") -> DataFrame:
    """leg_nm from the previous point and cum_nm from the first."""
    order = W.partitionBy(route).orderBy(idx)
    leg = F.coalesce(haversine_nm(F.lag("lat").over(order), F.lag("lon").over(order), "lat", "lon"), F.lit(0.0))
    return points.withColumn("leg_nm", leg).withColumn("cum_nm", F.sum("leg_nm").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))


def with_eta(points: DataFrame, speed: str, departure: str, route: str = "route_id", idx: str = "idx") -> DataFrame:
    hours = F.col("cum_nm") / F.col(speed)
    return cumulative(points, route, idx).withColumn("eta", F.timestamp_micros(F.unix_micros(F.col(departure).cast("timestamp")) + F.round(hours * 3_600_000_000).cast("long")))


def legs(points: DataFrame, route: str = "route_id", idx: str = "idx", weather_at: str = "end") -> DataFrame:
    """One row for each leg with its course; wind is taken at the leg's ``weather_at``: 'end' or 'start'."""
    order = W.partitionBy(route).orderBy(idx)
    ahead = points.withColumns({f"{c}2": F.lead(c).over(order) for c in ("lat", "lon", "wind_kn", "wind_from")}).where("lat2 is not null")
    wind = ("wind_kn2", "wind_from2") if weather_at == "end" else ("wind_kn", "wind_from")
    return ahead.select(route, idx, haversine_nm("lat", "lon", "lat2", "lon2").alias("distance_nm"), bearing_deg("lat", "lon", "lat2", "lon2").alias("course"), F.col(wind[0]).alias("leg_wind_kn"), F.col(wind[1]).alias("leg_wind_from"))


def legs_with_loss(route_legs: DataFrame, coefficients: DataFrame, route: str = "route_id", idx: str = "idx") -> DataFrame:
    """route, and its legs in order as array of struct(distance_nm, loss_pct) for ``jit_speed``. ``coefficients``: route, block_coefficient."""
    lossy = route_legs.join(coefficients, route).withColumn("loss_pct", kwon_loss_pct("leg_wind_kn", angle_diff_deg("course", "leg_wind_from"), "block_coefficient"))
    ordered = F.array_sort(F.collect_list(F.struct(idx, "distance_nm", "loss_pct")))
    return lossy.groupBy(route).agg(F.transform(ordered, lambda x: F.struct(x["distance_nm"].alias("distance_nm"), x["loss_pct"].alias("loss_pct"))).alias("legs"))


def sampled_places(n: Column, most: int = WEATHER_POINTS) -> Column:
    """Indices (from 0) of at most ``most`` of ``n`` points, evenly spread, both ends among them."""
    step = (n - 1) / F.lit(most - 1)
    spread = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.rint(k * step).cast("int"))))
    return F.when(n <= most, F.sequence(F.lit(0), n - 1)).otherwise(spread)


def route_weather(points: DataFrame, forecasts: DataFrame, route: str = "route_id", idx: str = "idx", cell_deg: float = 0.5, columns=("wave_height", "wind_kn", "wind_from"), within_hours: int = 3) -> DataFrame:
    """Weather at each point's ETA: sampled points ask the forecast table (cell_lat, cell_lon, valid_at, ...) and the others
    take the nearest sampled point's values, the earlier on ties. No forecast leaves nulls and drops no point."""
    cols = list(columns)
    sizes = points.groupBy(route).agg(F.count("*").cast("int").alias("n"))
    place = W.partitionBy(route).orderBy(idx)
    numbered = points.withColumn("place", F.row_number().over(place) - 1).join(sizes, route).withColumn("asked", sampled_places(F.col("n")))
    near = F.array_min(F.transform("asked", lambda k: F.struct(F.abs(k - F.col("place")).alias("gap"), k.alias("k"))))["k"]
    numbered = numbered.withColumn("source_place", near)
    cell = lambda c: F.floor(F.col(c) / cell_deg) * cell_deg
    asked = numbered.where("place = source_place").select(route, F.col("place"), cell("lat").alias("cell_lat"), cell("lon").alias("cell_lon"), "eta").withColumn("row_id", F.concat_ws("/", route, "place"))
    got = nearest_time_join(asked, forecasts, ["cell_lat", "cell_lon"], "eta", "valid_at", cols, "row_id", within_hours)
    got = got.select(route, F.col("place").alias("source_place"), *cols)
    return numbered.join(got, [route, "source_place"], "left").drop("n", "asked")


def position_along_route(points: DataFrame, asked: DataFrame, route: str = "route_id", idx: str = "idx", nm: str = "nm") -> DataFrame:
    """lat and lon at ``nm`` along the route, linear within a leg, held at both ends. ``asked``: route, nm."""
    order = W.partitionBy(route).orderBy(idx)
    c = cumulative(points, route, idx).withColumns({"lat2": F.lead("lat").over(order), "lon2": F.lead("lon").over(order), "cum2": F.lead("cum_nm").over(order), "__first": F.row_number().over(order) == 1})
    spans = c.select(F.col(route).alias("__route"), "lat", "lon", "lat2", "lon2", "cum_nm", "cum2", "__first")
    at = F.col(nm)
    inside = ((at >= F.col("cum_nm")) | F.col("__first")) & (F.col("cum2").isNull() | (at < F.col("cum2")))
    met = asked.join(spans, (asked[route] == F.col("__route")) & inside, "left")
    part = F.when(F.col("cum2").isNull() | (F.col("cum2") <= F.col("cum_nm")), 0.0).otherwise(F.greatest(F.lit(0.0), (at - F.col("cum_nm")) / (F.col("cum2") - F.col("cum_nm"))))
    between = lambda a, b: F.col(a) + part * (F.coalesce(b, a) - F.col(a))
    return met.select(route, nm, between("lat", "lat2").alias("lat"), between("lon", "lon2").alias("lon"))


def bounding_box(points: DataFrame, keys: list[str]) -> DataFrame:
    return points.groupBy(*keys).agg(F.min("lat").alias("south"), F.min("lon").alias("west"), F.max("lat").alias("north"), F.max("lon").alias("east"))


def mean_loss(route_legs: DataFrame, keys: list[str]) -> DataFrame:
    """Distance-weighted mean loss; 0 without distance."""
    total = F.sum("distance_nm")
    return route_legs.groupBy(*keys).agg(F.when(total > 0, F.sum(F.col("loss_pct") * F.col("distance_nm")) / total).otherwise(0.0).alias("mean_loss_pct"))
