"""Ordered windows by key and slice against windows by key."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fairlead.operators import joins, slices, tracks, windows

T0 = datetime(2024, 1, 1)
FIX = "mmsi long, event_time timestamp, lat double, lon double, extra string"


@pytest.fixture(scope="module")
def fixes(spark):
    rng, rows = random.Random(8), []
    for vessel, n in ((1, 900), (2, 40), (3, 1), (None, 30)):
        at = rng.sample(range(60 * 24 * 20), n)
        rows += [(vessel, T0 + timedelta(minutes=m), rng.random(), rng.random() if m % 5 else None, "x") for m in at]
    rows.append((2, None, 0.5, 0.5, "x"))
    return spark.createDataFrame(rows, FIX).repartition(4).cache()


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


@pytest.mark.parametrize("hours", [0.5, 7, 24 * 365])
def test_equal_to_windows_by_key(spark, fixes, hours):
    assert rows(tracks.enrich_track(fixes, slice_hours=hours)) == rows(tracks.enrich_track(fixes))
    assert rows(windows.gap_sequence(fixes, ["mmsi"], "event_time", 1, slice_hours=hours)) == rows(windows.gap_sequence(fixes, ["mmsi"], "event_time", 1))
    signal = F.col("lat") < 0.6
    assert rows(windows.segments(fixes, ["mmsi"], "event_time", signal, slice_hours=hours)) == rows(windows.segments(fixes, ["mmsi"], "event_time", signal))
    versions = fixes.where("lat < 0.1 and event_time is not null").select("mmsi", F.col("event_time").alias("since"), F.col("lon").alias("v"))
    got = joins.asof_join(fixes, versions, "mmsi", "event_time", "since", ["v"], slice_hours=hours)
    assert rows(got) == rows(joins.asof_join(fixes, versions, "mmsi", "event_time", "since", ["v"]))


def test_one_huge_track_is_many_tasks(spark):
    long = spark.range(60_000).select(F.when(F.col("id") % 10 > 0, 1).otherwise(F.col("id")).alias("mmsi"), F.timestamp_seconds(F.col("id") * 60).alias("event_time"), F.rand(1).alias("lat"), F.rand(2).alias("lon"))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = tracks.enrich_track(long, slice_hours=12)
        sizes = sorted(r.n for r in made.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count("event_time").alias("n"), F.max("prev_lat")).collect())
        assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[4]
        assert rows(made) == rows(tracks.enrich_track(long))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_empty_and_several_columns_at_once(spark, fixes):
    dealt = slices.sliced(fixes, ["mmsi"], "event_time", 6)
    made = slices.along(dealt, ["event_time"], previous={"a": F.col("lon")}, following={"b": F.col("lat")}, running={"n": F.lit(1)}, latest={"c": F.col("lon")})
    assert slices.whole(made).columns == [*fixes.columns, "a", "b", "n", "c"]
    assert made.agg(F.max("n")).first()[0] == 900
    assert slices.along(dealt.limit(0), ["event_time"], previous={"a": F.col("lon")}).count() == 0
