"""Several sources under one watermark, and a rule for those that fall silent.

Each source has a watermark of its own and the stream follows the slowest, so that a source that lags loses nothing. One
that is silent would hold the others up for ever. The rule: when a source has brought nothing for ``idle_seconds`` while
others went on, it is taken to be as far as they are. That is told to the stream by a heartbeat, a row without content
that moves the silent source's watermark and goes no further. Heartbeats are files in a folder for each source, so they
are part of the stream's own progress: a stream that starts again reads the same ones. Spark keeps the sources' watermarks
while a stream runs; once started again, it waits until each source brings a row or a heartbeat.

Rows that a source brings after such a heartbeat, but from before it, are late (see ``late.tagged``).
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

_BEAT = "__beat"


def merged(spark: SparkSession, sources: dict[str, DataFrame], event_time: str, lateness: str, beats: str) -> DataFrame:
    """The union of ``sources``, streams by name, each with its own watermark on ``event_time``. ``beats`` is a folder all
    executors share, with a folder for each source's heartbeats; see ``beat`` and ``IdleRule``."""
    out = None
    for name, rows in sources.items():
        folder = f"{beats.rstrip('/')}/{name}"
        _make_folder(spark, folder)
        heart = spark.readStream.schema("at timestamp").json(folder)
        heart = heart.select(F.col("at").cast(rows.schema[event_time].dataType).alias(event_time), F.lit(True).alias(_BEAT))
        both = rows.withColumn(_BEAT, F.lit(False)).unionByName(heart, allowMissingColumns=True).withWatermark(event_time, lateness)
        out = both if out is None else out.unionByName(both)
    # Heartbeats must reach the watermarks, so no filter may be moved before them: this one names the time (heartbeats have
    # one, so that changes nothing), and its second half, which always holds, keeps later ones behind it.
    held = (~F.col(_BEAT) | F.col(event_time).isNull()) & (F.spark_partition_id() >= 0)
    return out.where(held).drop(_BEAT)


def _make_folder(spark: SparkSession, folder: str) -> None:
    spark.createDataFrame([], "at timestamp").coalesce(1).write.mode("append").json(folder)


def beat(spark: SparkSession, beats: str, source: str, at: datetime) -> None:
    """A heartbeat: from now on ``source`` counts as having reached ``at``."""
    row = spark.createDataFrame([(at,)], "at timestamp").coalesce(1)
    row.write.mode("append").json(f"{beats.rstrip('/')}/{source}")


class IdleRule:
    """Decides from a stream's progress reports which sources have fallen silent, and how far they are to be moved.

    ``names``: of the sources, as in ``merged``. ``paths``: a part of each one's description in the reports, such as its
    folder or topic, that no other has.
    """

    def __init__(self, paths: dict[str, str], idle_seconds: float, clock: Callable[[], float] = time.monotonic):
        self.paths, self.idle_seconds, self.clock = paths, idle_seconds, clock
        self.active = dict.fromkeys(paths, clock())
        self.moved: dict[str, str] = {}
        self.newest: str | None = None

    def observe(self, progress: dict) -> list[tuple[str, datetime]]:
        """The heartbeats that a report calls for: (source, how far the others are), each step forward once."""
        now, brought = self.clock(), False
        for source in progress.get("sources", []):
            name = next((n for n, part in self.paths.items() if part in source.get("description", "")), None)
            if name is not None and source.get("numInputRows", 0) > 0:
                self.active[name], brought = now, True
        newest = progress.get("eventTime", {}).get("max")
        if brought and newest and (self.newest is None or newest > self.newest):
            self.newest = newest
        if self.newest is None:
            return []
        silent = [n for n, at in self.active.items() if now - at >= self.idle_seconds]
        if len(silent) == len(self.active):
            return []  # nobody goes on, so nobody is held up
        silent = [n for n in silent if self.moved.get(n) != self.newest]
        self.moved |= dict.fromkeys(silent, self.newest)
        return [(n, datetime.fromisoformat(self.newest.replace("Z", "+00:00")).astimezone(UTC)) for n in silent]


class IdleWatch(StreamingQueryListener):
    """Gives the heartbeats of an ``IdleRule`` for one stream (by its query's name) as it reports its progress. Register
    it with ``spark.streams.addListener``."""

    def __init__(self, spark: SparkSession, query: str, beats: str, rule: IdleRule):
        self.spark, self.query, self.beats, self.rule = spark, query, beats, rule

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if event.progress.name == self.query:
            for source, at in self.rule.observe(json.loads(event.progress.json)):
                beat(self.spark, self.beats, source, at)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
