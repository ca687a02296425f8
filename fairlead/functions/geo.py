"""Spherical geometry on columns, in nautical miles and degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_NM = 3440.065


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def _clamped(x: Column, low: float) -> Column:
    """Between ``low`` and 1; null stays null, which least and greatest would skip."""
    return F.when(x < low, low).when(x > 1, 1.0).otherwise(x)


def great_circle_nm(lat1, lon1, lat2, lon2) -> Column:
    """Spherical law of cosines; the cosine is clamped, since acos beyond 1 is NaN and NaN counts as large."""
    a, b, c, d = (F.radians(_col(x)) for x in (lat1, lon1, lat2, lon2))
    cosine = F.sin(a) * F.sin(c) + F.cos(a) * F.cos(c) * F.cos(d - b)
    return F.acos(_clamped(cosine, -1.0)) * EARTH_RADIUS_NM


def haversine_nm(lat1, lon1, lat2, lon2) -> Column:
    """Stable for short distances, unlike the cosine form."""
    a, b, c, d = (F.radians(_col(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return 2 * EARTH_RADIUS_NM * F.asin(F.sqrt(_clamped(h, 0.0)))


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Initial course from the first point to the second, 0 to 360."""
    a, b, c, d = (F.radians(_col(x)) for x in (lat1, lon1, lat2, lon2))
    y = F.sin(d - b) * F.cos(c)
    x = F.cos(a) * F.sin(c) - F.sin(a) * F.cos(c) * F.cos(d - b)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def angle_diff_deg(a, b) -> Column:
    """Smallest angle between two directions, 0 to 180."""
    return F.abs(F.pmod(_col(a) - _col(b) + 180, F.lit(360.0)) - 180)


def course_diff_deg(course, bearing) -> Column:
    """As ``angle_diff_deg``, null for courses outside 0 to 360 (360.x stands for 'not available')."""
    course = _col(course)
    return F.when(course.between(0, 360), angle_diff_deg(course, bearing))


# The sixteen points of the compass, clockwise from north.
_POINTS = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSO", "SO", "OSO", "O", "ONO", "NO", "NNO"]


def compass_point(degrees) -> Column:
    sector = F.pmod(F.floor(_col(degrees) / 22.5 + 0.5), F.lit(16)).cast("int")
    return F.element_at(F.array(*map(F.lit, _POINTS)), sector + 1)


def in_any_box(lat, lon, boxes) -> Column:
    """Inside one of ((south, west), (north, east)) boxes; false for none."""
    inside = F.lit(False)
    for (south, west), (north, east) in boxes:
        inside = inside | (_col(lat).between(south, north) & _col(lon).between(west, east))
    return inside
