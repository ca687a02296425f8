"""Writers: partitioned files, tables, alerts, idempotent stores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.operators.joins import insert_ignore, upsert

from .tables import read_if_there

#: Takes a micro-batch and its number.
Writer = Callable[[DataFrame, int], None]


def daily_files(stream: DataFrame, path: str, checkpoint: str, day: str = "_dt"):
    """A stream into Parquet folders by day; takes what is there and stops."""
    return stream.writeStream.partitionBy(day).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact_day(spark: SparkSession, path: str, day_column: str, files: int = 1, days: list[str] | None = None) -> None:
    """Rewrites each day's folder (or those of ``days``) in place, into about ``files`` files. The new files are whole in
    ``<path>.compacted`` before a day is replaced, so a run that is cut short loses nothing and may be repeated."""
    rows = spark.read.parquet(path)
    if days is not None:
        rows = rows.where(F.col(day_column).cast("string").isin(*days))
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = [F.col(day_column)] + ([F.floor(F.rand(7) * files)] if files > 1 else [])
    rows.repartition(shuffles, *spread).write.mode("overwrite").partitionBy(day_column).parquet(path + ".compacted")
    again = spark.read.schema(rows.schema).parquet(path + ".compacted").repartition(shuffles, *spread)
    again.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(day_column).parquet(path)


class Ledger:
    """Which micro-batches each sink of a stream has taken, as files in a folder that all runs of the stream share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _entry(self, sink: str, number: int) -> str:
        return f"{self.folder}/sink={sink}/batch={number}"

    def has(self, sink: str, number: int) -> bool:
        taken = read_if_there(self.spark, self._entry(sink, number), "at timestamp")
        return taken is not None and not taken.isEmpty()

    def note(self, sink: str, number: int) -> None:
        self.spark.range(1).select(F.current_timestamp().alias("at")).coalesce(1).write.mode("overwrite").parquet(self._entry(sink, number))


def fan_out(stream: DataFrame, writers: list[Writer] | dict[str, Writer], checkpoint: str, ledger: str | None = None):
    """One micro-batch, computed once, to several writers; a writer that fails has the batch replayed.

    With ``ledger``, a folder all executors share, sinks that have taken a batch are passed over when it is replayed.
    Between a write and its entry a run may still end, so for exactly one copy of each row a writer should replace what it
    wrote of the same batch, as ``batch_files`` does. Sinks are known by their names in ``writers``, or their places.
    """
    named = writers if isinstance(writers, dict) else {str(i): w for i, w in enumerate(writers)}
    book = Ledger(stream.sparkSession, ledger) if ledger else None

    def write(batch: DataFrame, number: int) -> None:
        due = {n: w for n, w in named.items() if not (book and book.has(n, number))}
        batch.persist()
        try:
            for name, w in due.items():
                w(batch, number)
                if book:
                    book.note(name, number)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batch_files(path: str, day: str | None = None, select: Callable[[DataFrame], DataFrame] | None = None) -> Writer:
    """A writer into Parquet folders by micro-batch (and ``day``); a batch that is replayed replaces itself, even where it
    comes to hold fewer days. ``select`` picks the sink's rows."""

    def write(batch: DataFrame, number: int) -> None:
        rows = select(batch) if select else batch
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(day) if day else writer).parquet(f"{path.rstrip('/')}/batch={number}")

    return write


def deliver(payloads: DataFrame, send: Callable[[DataFrame], None] | None, table: str) -> None:
    """Alerts to a table, and to ``send`` if given; sending is the caller's business."""
    payloads.write.mode("append").saveAsTable(table)
    if send:
        send(payloads)


def debug_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def overwrite_table(df: DataFrame, table: str, path: str | None = None) -> None:
    writer = df.write.mode("overwrite").option("overwriteSchema", "true").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def append_stream(stream: DataFrame, table: str, checkpoint: str):
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).toTable(table)


def _recover(spark: SparkSession, table: str) -> None:
    """Ends a swap that was cut short: without the table, the rows it held come back under its name."""
    if not spark.catalog.tableExists(table) and spark.catalog.tableExists(f"{table}__previous"):
        spark.sql(f"ALTER TABLE {table}__previous RENAME TO {table}")
    spark.sql(f"DROP TABLE IF EXISTS {table}__previous")


def _swap(spark: SparkSession, df: DataFrame, table: str) -> None:
    # The new contents are complete before the old table steps aside, and it goes only once they stand in its place.
    df.write.mode("overwrite").format("parquet").saveAsTable(f"{table}__next")
    spark.sql(f"ALTER TABLE {table} RENAME TO {table}__previous")
    spark.sql(f"ALTER TABLE {table}__next RENAME TO {table}")
    spark.sql(f"DROP TABLE {table}__previous")


def upsert_table(updates: DataFrame, table: str, key: str) -> None:
    """Replaces rows by key and adds new ones; ``loaded_at`` is the time of the call. A call that was cut short leaves the
    old rows or the new ones, and the next call goes on from there."""
    spark, stamped = updates.sparkSession, updates.withColumn("loaded_at", F.current_timestamp())
    _recover(spark, table)
    if not spark.catalog.tableExists(table):
        stamped.dropDuplicates([key]).write.format("parquet").saveAsTable(table)
    else:
        _swap(spark, upsert(spark.table(table), stamped, key), table)


def insert_new(updates: DataFrame, table: str, key: str) -> int:
    """Adds rows with new keys only and says how many; the same batch again adds none."""
    spark = updates.sparkSession
    if not spark.catalog.tableExists(table):
        updates.limit(0).write.format("parquet").saveAsTable(table)
    fresh = insert_ignore(spark.table(table), updates, key).persist()
    try:
        n = fresh.count()
        if n:
            fresh.select(*spark.table(table).columns).write.mode("append").format("parquet").saveAsTable(table)
        return n
    finally:
        fresh.unpersist()


#: A batch of documents may span so many days for its stored keys to be looked up by day; beyond, all days are.
LOOKED_UP_DAYS = 400


def dated_documents(events: DataFrame, path: str, time: str = "emitted_at", key: str = "event_id", batch: str | None = None) -> None:
    """JSON under dt=<UTC day>/batch=<batch>/, one row for each key. Earlier batches stay as they are, and so do keys that
    they hold; a batch that is written again replaces itself. ``batch`` names it, or else a digest of its keys does.

    Keys are kept beside the documents, in ``_keys`` (Parquet by day and batch, which readers of the documents pass over),
    and only those of the batch's own days are read. A key's documents of another day are other documents."""
    spark, once = events.sparkSession, events.dropDuplicates([key]).withColumn("dt", F.to_date(time))
    if batch is None:
        seen = once.agg(F.count("*").alias("n"), F.sum(F.xxhash64(key).cast("decimal(38,0)")).alias("digest")).first()
        batch = f"{seen['n']}_{seen['digest'] or 0}".replace("-", "m")
    ledger = f"{path.rstrip('/')}/_keys"
    earlier = read_if_there(spark, ledger, f"`{key}` {events.schema[key].dataType.simpleString()}, dt date, batch string")
    if earlier is not None:
        once = once.join(stored_keys(earlier, once, batch), ["dt", key], "left_anti")
    placed = once.withColumn("batch", F.lit(batch)).persist()
    try:
        for rows, target, kind in ((placed, path, "json"), (placed.select(key, "dt", "batch"), ledger, "parquet")):
            rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("dt", "batch").format(kind).save(target)
    finally:
        placed.unpersist()


def stored_keys(earlier: DataFrame, batch_rows: DataFrame, batch: str) -> DataFrame:
    """(dt, key) of other batches, of the days of ``batch_rows`` only: the days are given to the scan, which opens no
    other folder."""
    days = [r[0] for r in batch_rows.select("dt").distinct().limit(LOOKED_UP_DAYS + 1).collect()]
    other = earlier.where(F.col("batch") != batch).drop("batch")
    if len(days) > LOOKED_UP_DAYS:
        return other
    return other.where(F.col("dt").isin(*[d for d in days if d is not None]) | (F.col("dt").isNull() if None in days else F.lit(False)))


def keyed(df: DataFrame, key: str = "mmsi", time: str = "event_time", parts: int | None = None) -> DataFrame:
    """A key's rows together and in time order, with a lineage id for each."""
    placed = df.repartition(parts, key) if parts else df.repartition(key)
    return placed.sortWithinPartitions(key, time).withColumn("correlation_id", F.expr("uuid()"))


def create_table(spark: SparkSession, name: str, columns: dict[str, tuple[str, str]], partition: str | None = None) -> None:
    """``columns``: name to (type, comment); an existing table stays as it is."""
    schema = name.rpartition(".")[0]
    if schema:
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema}")
    body = ", ".join("{} {} COMMENT '{}'".format(c, t, note.replace("'", "\\'")) for c, (t, note) in columns.items())
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({body}) USING parquet" + (f" PARTITIONED BY ({partition})" if partition else ""))


def publish(events: DataFrame, table: str, path: str) -> int:
    """Store first, and copy to documents only once the store has the rows; an error leaves the batch to be replayed, and
    both steps may be repeated."""
    n = insert_new(events, table, "event_id")
    dated_documents(events, path)
    return n
