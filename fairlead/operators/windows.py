"""Ordered operators: segments, sessions, ranking, running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import slices


def seconds_between(start, end) -> Column:
    return F.unix_timestamp(end) - F.unix_timestamp(start)


def segments(df: DataFrame, keys: list[str], time: str, signal: Column, max_gap_minutes: float = 30.0, slice_hours: float | None = None) -> DataFrame:
    """Runs of rows with a signal: ``segment_id`` (from 1 in each key's order) and ``interval_s``, the time to the next row
    where that row has the signal too and is within the gap, else 0. Rows without the signal are left out. With
    ``slice_hours`` a key's rows are dealt over several tasks (see ``slices``), with equal rows."""
    marked = df.withColumn("__on", F.coalesce(signal, F.lit(False)).cast("int"))
    on, fresh = F.col("__on") == 1, (F.col("__on") == 1) & (F.coalesce("__was", F.lit(0)) == 0)
    step = seconds_between(time, "__next.at")
    interval = F.when(on & (F.col("__next.on") == 1) & step.between(0, max_gap_minutes * 60), step).otherwise(0)
    beside = F.struct(F.col(time).alias("at"), F.col("__on").alias("on"))
    if slice_hours:
        dealt = slices.along(slices.sliced(marked, keys, time, slice_hours), [time], previous={"__was": F.col("__on")}, following={"__next": beside})
        dealt = dealt.withColumns({"__new": fresh.cast("int"), "interval_s": interval})
        numbered = slices.whole(slices.along(dealt, [time], running={"segment_id": F.col("__new")}))
    else:
        order = W.partitionBy(*keys).orderBy(time)
        marked = marked.withColumns({"__was": F.lag("__on").over(order), "__next": F.lead(beside).over(order)})
        marked = marked.withColumns({"__new": fresh.cast("int"), "interval_s": interval})
        numbered = marked.withColumn("segment_id", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return numbered.where("__on = 1").drop("__on", "__new", "__was", "__next")


def gap_sequence(df: DataFrame, keys: list[str], time: str, gap_hours: float, name: str = "sequence", slice_hours: float | None = None) -> DataFrame:
    """A number that grows by one wherever more than ``gap_hours`` lie between rows of a key. With ``slice_hours`` a key's
    rows are dealt over several tasks (see ``slices``), with equal rows."""
    fresh = F.coalesce(seconds_between("__before", time) > gap_hours * 3600, F.lit(True)).cast("int")
    if slice_hours:
        dealt = slices.along(slices.sliced(df, keys, time, slice_hours), [time], previous={"__before": F.col(time)})
        return slices.whole(slices.along(dealt.withColumn("__fresh", fresh), [time], running={name: F.col("__fresh")})).drop("__fresh", "__before")
    order = W.partitionBy(*keys).orderBy(time)
    marked = df.withColumn("__before", F.lag(time).over(order)).withColumn("__fresh", fresh)
    return marked.withColumn(name, F.sum("__fresh").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("__fresh", "__before")


def assign_session(events: DataFrame, keys: list[str], time: str, event_id: str, hours: float = 24.0) -> DataFrame:
    """``session_id``: the id of the first event of the chain in which no two neighbours are further apart than ``hours``."""
    chained = gap_sequence(events, keys, time, hours, "__chain")
    first = W.partitionBy(*keys, "__chain").orderBy(time, event_id).rowsBetween(W.unboundedPreceding, W.currentRow)
    return chained.withColumn("session_id", F.first(event_id).over(first)).drop("__chain")


def session_evolution(events: DataFrame, session: str, time: str, value: str) -> DataFrame:
    """Of each session: first and last value, minutes from its first event to its last, and whether the value's sign changed."""
    first, last = F.min_by(value, time), F.max_by(value, time)
    return events.groupBy(session).agg(first.alias("first_value"), last.alias("last_value"), (seconds_between(F.min(time), F.max(time)) / 60).alias("minutes"), F.count("*").alias("events"), (F.signum(first) != F.signum(last)).alias("regime_changed"))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key in ``order``."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_k(df, keys, order, 1).drop("rank")


def recent(df: DataFrame, keys: list[str], time: str, now: Column, hours: float, k: int, tiebreak: str) -> DataFrame:
    """The newest ``k`` rows of each key within ``hours`` of ``now``."""
    return top_k(df.where(F.col(time) >= now - F.make_dt_interval(hours=F.lit(int(hours)))), keys, [F.desc(time), F.desc(tiebreak)], k)


def first_known(df: DataFrame, keys: list[str], time: str, columns: list[str]) -> list[Column]:
    """For a groupBy: of each column the earliest value that is not null, whatever order rows arrive in."""
    return [F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(time))).alias(c) for c in columns]


def without_repeats(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key: the last in ``order``; deterministic, unlike dropDuplicates."""
    return latest_per_key(df, keys, order)


def any_flagged(df: DataFrame, keys: list[str], flag: Column) -> DataFrame:
    """Of each key whether any of its rows is flagged; a null flag is none."""
    return df.groupBy(*keys).agg(F.coalesce(F.bool_or(flag), F.lit(False)).alias("any_flagged"))


def longest_wait_first(df: DataFrame, wait: str, *tiebreak: str) -> DataFrame:
    """Longest wait first, unknown waits last; ties by ``tiebreak``, so that the order is the same in every run."""
    return df.orderBy(F.desc_nulls_last(wait), *tiebreak)


def by_priority(df: DataFrame, column: str, first: list, then: str, *tiebreak: str) -> DataFrame:
    """Rows whose ``column`` is in ``first``, in that order, before all others; within each the largest ``then`` first."""
    place = F.lit(len(first))
    for i, value in reversed(list(enumerate(first))):
        place = F.when(F.col(column) == value, i).otherwise(place)
    return df.orderBy(place, F.desc_nulls_last(then), *tiebreak)


def in_session_order(df: DataFrame, session: str, time: str, tiebreak: str) -> DataFrame:
    """A session's rows together, oldest first."""
    return df.orderBy(session, time, tiebreak)
