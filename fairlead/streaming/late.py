"""Late rows as a side output.

Spark's windows drop rows older than the watermark without a word. ``tagged`` compares each row with the watermark that
its micro-batch runs under, before any window sees it, and says so in a column, so that a stream can send the late ones
to quarantine and give the others to its windows: every row is in one of the two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "late"
_SHARE = "__share"


def tagged(stream: DataFrame, event_time: str, lateness: str, shares: int | None = None, ready: bool = False) -> DataFrame:
    """``stream`` with ``late`` (boolean) and ``watermark``, the one a row was compared with (null before there is one).

    A row is late if its time is not after the watermark, or if it has none. Rows are dealt over ``shares`` tasks by their
    content (the session's number of shuffle partitions, if None) and pass one by one; nothing is kept of them. ``ready``:
    the stream has its watermark already. Other columns stay as they are; ``late`` and ``watermark`` must be new ones.
    """
    clash = {LATE, "watermark", _SHARE} & set(stream.columns)
    if clash:
        raise ValueError(f"columns already there: {sorted(clash)}")
    n = shares or int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (stream if ready else stream.withWatermark(event_time, lateness)).withColumn(_SHARE, F.pmod(F.xxhash64(*_hashable(stream)), F.lit(n)))
    fields = [T.StructField(f.name, f.dataType) for f in stream.schema]
    schema = T.StructType([*fields, T.StructField("watermark", T.LongType())])

    def compare(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at = state.getCurrentWatermarkMs()
        for rows in frames:
            rows = rows.drop(columns=_SHARE)
            rows["watermark"] = pd.array([at if at > 0 else None] * len(rows), "Int64")
            yield rows

    seen = dealt.groupBy(_SHARE).applyInPandasWithState(compare, schema, "none int", "append", GroupStateTimeout.NoTimeout)
    behind = F.unix_micros(event_time) <= 1000 * F.col("watermark")
    return seen.withColumns({LATE: F.coalesce(behind, F.col(event_time).isNull()), "watermark": F.timestamp_millis("watermark")})


def on_time(rows: DataFrame, event_time: str, lateness: str) -> DataFrame:
    """The rows of ``tagged`` that are not late, without its two columns and under a watermark again, for windows."""
    return rows.where(~F.col(LATE)).drop(LATE, "watermark").withWatermark(event_time, lateness)


def _hashable(df: DataFrame) -> list:
    return [F.to_json(F.struct(f.name)) if isinstance(f.dataType, (T.MapType, T.VariantType)) else F.col(f.name) for f in df.schema]


def quarantine_late(rows: DataFrame, kind: str) -> DataFrame:
    """Reject records (key, value) of the late rows of ``tagged``: the reason, the row's type, its content and the
    watermark it missed."""
    content = [c for c in rows.columns if c not in (LATE, "watermark")]
    body = F.struct(F.lit("late").alias("reason"), F.lit(kind).alias("message_type"), F.to_json(F.struct(*content)).alias("raw"), "watermark")
    key = F.col("mmsi").cast("string") if "mmsi" in content else F.lit(None).cast("string")
    return rows.where(LATE).select(key.alias("key"), F.to_json(body).alias("value"))


def to_both(stream: DataFrame, on_time: Callable[[DataFrame, int], None], late: Callable[[DataFrame, int], None]) -> list:
    """Two writers for ``sources.sinks.fan_out``: the rows on time without the two columns, and the late ones as tagged."""
    plain = [c for c in stream.columns if c not in (LATE, "watermark")]
    return [lambda batch, n: on_time(batch.where(~F.col(LATE)).select(*plain), n), lambda batch, n: late(batch.where(LATE), n)]
