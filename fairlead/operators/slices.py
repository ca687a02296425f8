"""Ordered windows over very long series: by key and slice of time, with what earlier slices end in carried over.

A window by key alone puts a key's whole series into one task. Here it is dealt by (key, slice of time), so that one huge
track is many tasks. Each slice is summed up in one row (its last and first rows, its totals, its last known values); a
window over those few rows says what a slice begins with; and a join by (key, slice), which keeps the dealing of the
series, hands it to the slice's rows. The results are those of a window by key, whatever the slices.

A null key is a key like any other, as in windows. Rows without time come first, in a slice of their own. Rows of one time
need ``tiebreak`` columns for a defined order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY, SLICE = "__slice_key", "__slice"


def sliced(df: DataFrame, keys: list[str], time: str, hours: float) -> DataFrame:
    """``df`` with its slice, for ``along``; ``whole`` takes the slice off again."""
    number = F.floor(F.unix_timestamp(time) / F.lit(3600.0 * hours))
    return df.withColumns({KEY: F.struct(*keys), SLICE: F.coalesce(number, F.lit(-(1 << 62)))})


def whole(df: DataFrame) -> DataFrame:
    return df.drop(KEY, SLICE)


def along(df: DataFrame, order: list[str], previous: dict[str, Column] | None = None, following: dict[str, Column] | None = None, running: dict[str, Column] | None = None, latest: dict[str, Column] | None = None) -> DataFrame:
    """Columns over each key's series in ``order`` (its time first), of a sliced ``df``: of ``previous`` and ``following``
    the value of the row before and after; of ``running`` the sum so far; of ``latest`` the last value so far that is not
    null."""
    previous, following, running, latest = ({k: v for k, v in (x or {}).items()} for x in (previous, following, running, latest))
    place = F.struct(*order)
    boxed = lambda v: F.struct(v.alias("v"))  # noqa: E731  a null value is a value here
    ends = [F.max_by(boxed(v), place).alias(f"p_{n}") for n, v in previous.items()]
    ends += [F.min_by(boxed(v), place).alias(f"f_{n}") for n, v in following.items()]
    ends += [F.sum(v).alias(f"r_{n}") for n, v in running.items()]
    ends += [F.max_by(v, F.when(v.isNotNull(), place)).alias(f"l_{n}") for n, v in latest.items()]
    slices = W.partitionBy(KEY).orderBy(SLICE)
    before = slices.rowsBetween(W.unboundedPreceding, -1)
    carried = [F.lag(f"p_{n}").over(slices).alias(f"p_{n}") for n in previous] + [F.lead(f"f_{n}").over(slices).alias(f"f_{n}") for n in following]
    carried += [F.sum(f"r_{n}").over(before).alias(f"r_{n}") for n in running]
    carried += [F.last(f"l_{n}", ignorenulls=True).over(before).alias(f"l_{n}") for n in latest]
    carry = df.groupBy(KEY, SLICE).agg(*ends).select(F.col(KEY), F.col(SLICE), F.struct(*carried).alias("__carry"))

    rows = W.partitionBy(KEY, SLICE).orderBy(*order)
    so_far = rows.rowsBetween(W.unboundedPreceding, W.currentRow)
    held = lambda n: F.col(f"__carry.{n}")
    made = {n: F.coalesce(F.lag(boxed(v)).over(rows), held(f"p_{n}"))["v"] for n, v in previous.items()}
    made |= {n: F.coalesce(F.lead(boxed(v)).over(rows), held(f"f_{n}"))["v"] for n, v in following.items()}
    for n, v in running.items():
        inside = F.sum(v).over(so_far)
        made[n] = F.when(inside.isNull(), held(f"r_{n}")).otherwise(inside + F.coalesce(held(f"r_{n}"), F.lit(0)))
    made |= {n: F.coalesce(F.last(v, ignorenulls=True).over(so_far), held(f"l_{n}")) for n, v in latest.items()}
    # Both sides are dealt by (key, slice), whatever their sizes: the series must not be gathered by a broadcast's order.
    return df.join(carry.hint("merge"), [KEY, SLICE], "left").withColumns(made).drop("__carry").select(*df.columns, *made)
