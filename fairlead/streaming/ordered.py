"""The previous fix of a stream whose rows come out of order.

A vessel's rows wait in its state until the watermark has passed them, since only then can no earlier one come. They are
released in the order of their times, each with the one released before it, by the next rows or by an event-time timer,
whichever is first. So the stream gives the rows of ``operators.tracks.enrich_track`` on the same rows, however they are
shuffled within the lateness. What is kept of a vessel is its last fix and the rows of one lateness, in one state with the
other vessels of its share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fairlead.operators.tracks import movement

#: A vessel is forgotten so long (in event time) after its last fix.
STATE_DAYS = 30
#: Shares of vessels, by hash, that have a state together: a call of Python for each vessel costs more than its rows.
SHARES = 4096
_AT, _SHARE, _NEW = "__at", "__share", "__new"
_STATE = "latest binary, waiting binary"


def _packed(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(raw: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(raw).read_pandas()


def previous_in_order(positions: DataFrame, lateness: str = "1 minute", key: str = "mmsi", event_time: str = "event_time", ready: bool = False, shares: int = SHARES) -> DataFrame:
    """``positions`` with the previous fix of each one's vessel (prev_lat, prev_lon, prev_<event_time>), and distance,
    hours and implied speed as of ``enrich_track``. Fixes of one time are ordered by lat and lon. ``ready``: the stream has
    its watermark already. Rows older than the watermark are dropped by Spark (``late.tagged`` catches them first), and
    rows without time or vessel are left out, since no order holds them. ``shares`` stays the same for a stream's life."""
    base = positions if ready else positions.withWatermark(event_time, lateness)
    base = base.where(F.col(event_time).isNotNull() & F.col(key).isNotNull())
    base = base.withColumns({_AT: F.unix_micros(event_time), _SHARE: F.pmod(F.xxhash64(key), F.lit(shares)).cast("int")})
    order = [_AT, "lat", "lon"]
    prev = {"prev_lat": T.DoubleType(), "prev_lon": T.DoubleType(), "__prev_at": T.LongType()}
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in base.schema] + [T.StructField(n, t) for n, t in prev.items()])
    names = base.columns

    def release(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        latest, waiting = state.get if state.exists else (None, None)
        mark = max(state.getCurrentWatermarkMs(), 0)
        known = _unpacked(latest) if latest else None
        held = [_unpacked(waiting)] if waiting else []
        if not state.hasTimedOut:
            held += list(frames)
        rest = None
        if held:
            rows = pd.concat(held, ignore_index=True)[names]
            passed = rows[_AT] <= mark * 1000
            out, rest = rows[passed], rows[~passed]
            if len(out):
                both = pd.concat([known, out], ignore_index=True) if known is not None else out.reset_index(drop=True)
                new = np.arange(len(both)) >= len(both) - len(out)
                both = both.assign(**{_NEW: new}).sort_values([key, _NEW, *order], kind="stable", ignore_index=True)
                same = (both[key] == both[key].shift(1)).to_numpy()
                moved = both[["lat", "lon"]].shift(1)
                moved[~same] = np.nan
                moved.columns = ["prev_lat", "prev_lon"]
                at = both[_AT].to_numpy(np.int64)
                moved["__prev_at"] = pd.array(np.where(same, np.roll(at, 1), 0), "Int64")
                moved.loc[~same, "__prev_at"] = pd.NA
                fresh = both[_NEW].to_numpy(bool)
                known = both.loc[np.append(~same[1:], True), [key, "lat", "lon", _AT]]
                yield pd.concat([both.loc[fresh, names].astype(rows.dtypes), moved[fresh]], axis=1)
        if known is not None:
            known = known[known[_AT] // 1000 + STATE_DAYS * 86_400_000 > mark]
        kept = known is not None and len(known) > 0
        waits = rest is not None and len(rest) > 0
        if not kept and not waits:
            state.remove()
            return
        state.update((_packed(known) if kept else None, _packed(rest) if waits else None))
        wake = int(rest[_AT].min()) // 1000 if waits else int(known[_AT].max()) // 1000 + STATE_DAYS * 86_400_000
        state.setTimeoutTimestamp(max(wake, mark + 1))

    kept = base.groupBy(_SHARE).applyInPandasWithState(release, schema, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return movement(kept.withColumn(f"prev_{event_time}", F.timestamp_micros("__prev_at")).drop(_AT, _SHARE, "__prev_at"), event_time)
