import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fairlead.functions import geo

LAT, LON = st.floats(-90, 90), st.floats(-180, 180)
POINTS = st.lists(st.tuples(LAT, LON, LAT, LON, LAT, LON), min_size=1, max_size=40)
RELAXED = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def twin(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    x = math.sin(a) * math.sin(c) + math.cos(a) * math.cos(c) * math.cos(d - b)
    return 3440.065 * math.acos(max(-1.0, min(1.0, x)))


@RELAXED
@given(POINTS)
def test_distance_is_a_metric(spark, rows):
    d = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double")
    for r in d.select("*", geo.great_circle_nm("a", "b", "c", "d").alias("ab"), geo.great_circle_nm("c", "d", "a", "b").alias("ba"), geo.great_circle_nm("c", "d", "e", "f").alias("bc"), geo.great_circle_nm("a", "b", "e", "f").alias("ac"), geo.haversine_nm("a", "b", "c", "d").alias("h")).collect():
        assert 0 <= r.ab <= math.pi * 3440.0651
        assert abs(r.ab - r.ba) < 1e-6
        assert r.ac <= r.ab + r.bc + 1e-2
        assert abs(r.ab - twin(r.a, r.b, r.c, r.d)) < 1e-6
        assert abs(r.ab - r.h) < 0.5


def test_null_points_have_no_distance(spark):
    d = spark.createDataFrame([(None, 1.0, 2.0, 3.0)], "a double, b double, c double, d double")
    assert d.select(geo.great_circle_nm("a", "b", "c", "d"), geo.haversine_nm("a", "b", "c", "d")).first() == (None, None)


def test_angles_and_points(spark):
    d = spark.range(1)
    r = d.select(
        geo.bearing_deg(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("east"), geo.angle_diff_deg(F.lit(350.0), F.lit(10.0)).alias("diff"), geo.course_diff_deg(F.lit(400.0), F.lit(10.0)).alias("none"), geo.compass_point(F.lit(348.75)).alias("n"), geo.compass_point(F.lit(180.0)).alias("s"),
    ).first()
    assert abs(r.east - 90) < 1e-9 and r.diff == 20 and r.none is None and (r.n, r.s) == ("N", "S")
