"""Joins that Spark has no operator for, and keyed upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import slices

#: A dimension of at most so many rows may be broadcast.
BROADCAST_ROWS = 200_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows; larger sides are left to a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def version_intervals(versions: DataFrame, key: str, start: str, tiebreak: str) -> DataFrame:
    """One row for each (key, start): the one with the largest ``tiebreak`` (nulls last), and ``valid_to``, the next start."""
    newest = W.partitionBy(key, start).orderBy(F.col(tiebreak).desc_nulls_last())
    once = versions.where(F.col(start).isNotNull()).withColumn("__rank", F.row_number().over(newest)).where("__rank = 1").drop("__rank")
    return once.withColumn("valid_to", F.lead(start).over(W.partitionBy(key).orderBy(start, tiebreak)))


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, columns: list[str], slice_hours: float | None = None) -> DataFrame:
    """Left as-of join: each left row with ``columns`` of the newest right row of its key at or before its time.

    Both sides meet in one stream ordered by time, and the last right row is carried along: one shuffle, and no row more
    than there are, unlike a join on intervals. Right rows must be unique by (key, time); see ``version_intervals``. With
    ``slice_hours`` a key's stream is dealt over several tasks (see ``slices``), with equal rows.
    """
    carried = F.struct(*[F.col(c) for c in columns])
    kind = right.select(carried.alias("x")).schema["x"].dataType
    row = F.struct(*[F.col(c) for c in left.columns])
    a = left.select(F.col(key).alias("__key"), F.col(left_time).alias("__time"), F.lit(1).alias("__side"), row.alias("__row"), F.lit(None).cast(kind).alias("__right"))
    none = F.lit(None).cast(a.schema["__row"].dataType)
    timed = right.where(F.col(right_time).isNotNull())
    b = timed.select(F.col(key).alias("__key"), F.col(right_time).alias("__time"), F.lit(0).alias("__side"), none.alias("__row"), carried.alias("__right"))
    if slice_hours:
        dealt = slices.sliced(a.unionByName(b), ["__key"], "__time", slice_hours)
        met = slices.whole(slices.along(dealt, ["__time", "__side"], latest={"__known": F.col("__right")}).drop("__right").withColumnRenamed("__known", "__right"))
    else:
        order = W.partitionBy("__key").orderBy(F.col("__time").asc_nulls_first(), "__side").rowsBetween(W.unboundedPreceding, W.currentRow)
        met = a.unionByName(b).withColumn("__right", F.last("__right", ignorenulls=True).over(order))
    known = F.col("__key").isNotNull() & F.col("__time").isNotNull()  # nulls meet nothing
    return met.where("__side = 1").select("__row.*", *[F.when(known, F.col("__right")[c]).alias(c) for c in columns])


def interval_join(left: DataFrame, intervals: DataFrame, key: str, time: str, start: str, end: str, columns: list[str]) -> DataFrame:
    """The same result from validity intervals, as an equi-join with a range condition."""
    r = intervals.select(F.col(key).alias("__key"), F.col(start).alias("__from"), F.col(end).alias("__to"), *columns)
    on = (left[key] == r["__key"]) & (left[time] >= r["__from"]) & (r["__to"].isNull() | (left[time] < r["__to"]))
    return left.join(r, on, "left").drop("__key", "__from", "__to")


def nearest_time_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, columns: list[str], row_id: str, within_hours: int = 24) -> DataFrame:
    """Each left row with the right row of its keys nearest in time, the earlier one on ties; null if none is near.

    Times are met by buckets of ``within_hours``, each left row in its own and the two beside it, so a long series is not
    met whole. ``row_id`` identifies left rows.
    """
    bucket = lambda c: F.floor(F.unix_timestamp(c) / (3600 * within_hours))
    a = left.withColumn("__bucket", F.explode_outer(F.when(F.col(left_time).isNotNull(), F.sequence(bucket(left_time) - 1, bucket(left_time) + 1))))
    b = right.select(*keys, bucket(right_time).alias("__bucket"), F.col(right_time).alias("__at"), F.struct(*columns).alias("__right"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    gap = F.abs(micros(left_time) - micros("__at"))
    met = a.join(b, [*keys, "__bucket"], "left").where(F.col("__at").isNull() | (gap <= 3_600_000_000 * within_hours))
    best = met.where(F.col("__at").isNotNull()).groupBy(row_id).agg(F.min_by("__right", F.struct(gap, F.col("__at"))).alias("__right"))
    return left.join(best, row_id, "left").select(*left.columns, *[F.col("__right")[c].alias(c) for c in columns])


def lookup(left: DataFrame, dimension: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Left lookup by key: a dimension that is small enough is broadcast."""
    return left.join(small_side(dimension.select(key, *columns).dropDuplicates([key])), key, "left")


def upsert(target: DataFrame, updates: DataFrame, key: str | list[str]) -> DataFrame:
    """``target`` with the rows of ``updates`` in place of, or beside, its own; the last of equal updates by their columns."""
    keys = [key] if isinstance(key, str) else key
    both = target.withColumn("__new", F.lit(0)).unionByName(updates.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    best = W.partitionBy(*keys).orderBy(F.desc("__new"), *[F.col(c).desc_nulls_last() for c in target.columns if c not in keys])
    return both.withColumn("__rank", F.row_number().over(best)).where("__rank = 1").drop("__rank", "__new")


def insert_ignore(target: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """The rows of ``updates`` that a target without their key would take: one for each new key."""
    first = W.partitionBy(key).orderBy(*[F.col(c).asc_nulls_last() for c in updates.columns if c != key])
    return updates.where(F.col(key).isNotNull()).join(target.select(key).distinct(), key, "left_anti").withColumn("__rank", F.row_number().over(first)).where("__rank = 1").drop("__rank")


def zip_series(a: Column | str, b: Column | str) -> Column:
    """Two aligned arrays as one array of pairs; null where their lengths differ."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: F.struct(x.alias("first"), y.alias("second"))))
