"""Shared helpers: reading tables, cutting lineage in the shared folder, and packing texts for vectorised work."""

from __future__ import annotations

import uuid

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Multiplier of the polynomial word hash (odd, so it has an inverse modulo 2**64).
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
#: At most this many bytes of text are worked on at once in a Python task.
SLICE_BYTES = 500_000
#: Rows in a batch that Spark hands to Python. Its own 10,000 texts are tens of MB, which every task holds several times over,
#: in Python and outside the JVM's heap.
BATCH_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, which a cluster must name. A local session without it
    uses its warehouse, since its driver and executors are one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and (spark.sparkContext.master + "[").startswith("local["):
        base = spark.conf.get("spark.sql.warehouse.dir")
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/fairlead"


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*frames: DataFrame) -> None:
    """Delete tables of ``durable`` once everything made from them is stored itself, and let Spark drop old shuffles."""
    import gc

    for df in frames:
        jvm = df.sparkSession._jvm
        for file in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
    gc.collect()
    if frames:
        frames[0].sparkSession._jvm.System.gc()  # unreferenced shuffles go only when the driver's garbage is collected


def small_batches(spark: SparkSession) -> None:
    """From now on the session's batches for Python hold ``BATCH_ROWS`` rows at most, unless it has a number of its own."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows, None) is None:
        spark.conf.set(rows, str(BATCH_ROWS))


# Arrow types of the column types that operators return.
_ARROW = {
    "int": pa.int32(),
    "long": pa.int64(),
    "double": pa.float64(),
    "string": pa.string(),
    "binary": pa.binary(),
    "boolean": pa.bool_(),
    "array<int>": pa.list_(pa.int32()),
    "array<long>": pa.list_(pa.int64()),
    "array<struct<start:long,length:long,period:long>>": pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])),
    "array<struct<first:int,past:int,probability:double>>": pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32()), ("probability", pa.float64())])),
}


def as_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """An Arrow batch of ``rows`` under a schema like ``"doc_id long, text string"``; integers stay exact beside nulls."""
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields])


def with_columns(df: DataFrame, using: list, schema: str, work: Callable, keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with the columns of ``schema`` after its own. ``work`` gets the values of the ``using`` columns of a batch,
    a list each, and returns a list of values for each new column. Columns of ``df`` pass through as Arrow has them, so
    ids and other integers stay exact beside nulls; ``using`` may hold any expressions, whatever ``df``'s names are."""
    fields = [f.split() for f in schema.split(", ")]
    plain, given = keep or df.columns, [f"__given_{i}" for i in range(len(using))]
    while set(given) & set(plain):
        given = [f"_{g}" for g in given]
    full = StructType(df.select(*plain).schema.fields + StructType.fromDDL(schema).fields)
    width = len(plain)

    def run(batches):
        for batch in batches:
            made = work(*[batch.column(width + i).to_pylist() for i in range(len(given))])
            new = [pa.array(values, _ARROW[kind]) for values, (_, kind) in zip(made, fields)]
            names = [*batch.schema.names[:width], *[name for name, _ in fields]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *new], names=names)

    return df.select(*plain, *[c.alias(g) for c, g in zip(using, given)]).mapInArrow(run, full)


def whole_text(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def slices(texts, limit: int = SLICE_BYTES):
    """Yield (first, last, encoded) runs of consecutive texts of about ``limit`` bytes; a single text is never cut."""
    start, held, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        if held and size + len(raw) > limit:
            yield start, i, held
            start, held, size = i, [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield start, start + len(held), held


def text_slices(column: pa.Array, limit: int = SLICE_BYTES):
    """Yield (first, last, bytes, bounds) runs of consecutive texts of about ``limit`` bytes of an Arrow text column
    without nulls. The bytes are a view of the column; ``bounds`` are each text's ends in them. No text is cut."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + limit, "right")) - 1)
        last = min(last, n)
        yield first, last, whole[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
        first = last


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS and len(_POWERS[0]) > n:
        return _POWERS[0], _POWERS[1]
    size = max(n, SLICE_BYTES) + 1
    up, down = np.full(size, _BASE, np.uint64), np.full(size, _INV, np.uint64)
    up[0] = down[0] = 1
    np.cumprod(up, out=up)
    np.cumprod(down, out=down)
    if size == SLICE_BYTES + 1:  # those of a longer text go with it
        _POWERS[:] = [up, down]
    return up, down


def mix64(x: np.ndarray) -> np.ndarray:
    """Finishing steps of a 64-bit hash, vectorised."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SpanHash:
    """Hashes any byte spans of one buffer from one prefix sum."""

    def __init__(self, buffer: np.ndarray):
        up, self.down = _powers(len(buffer))
        self.sums = np.zeros(len(buffer) + 1, np.uint64)
        terms = self.sums[1:]
        terms[:] = buffer
        terms += np.uint64(1)
        terms *= up[: len(buffer)]
        np.cumsum(terms, out=terms)

    def of(self, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix64(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(salt * 0x632BE59BD9B4E019 & (1 << 64) - 1))


def spans(inside: np.ndarray, document: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of True in ``inside`` that stays within one document."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.empty(len(inside), bool)
    edge[0] = True
    edge[1:] = document[1:] != document[:-1]
    before = np.empty(len(inside), bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (edge | ~before))
    after = np.empty(len(inside), bool)
    after[-1] = False
    after[:-1] = inside[1:] & ~edge[1:]
    return start, np.flatnonzero(inside & ~after) + 1


def spans_within(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``spans``, for documents that end at ``bounds`` (as of ``text_slices``)."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(inside) + 1, bool)
    edge[bounds] = True
    begins = inside.copy()
    begins[1:] &= edge[1:-1] | ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= edge[1:-1] | ~inside[1:]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1
