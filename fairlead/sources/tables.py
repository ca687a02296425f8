"""A keyed table on plain files whose updates rewrite only the buckets they touch.

Rows lie in buckets by a hash of their key, and each version of a bucket in a folder of its own, which is never changed.
The manifest says which version of each bucket the table consists of. An update writes the buckets it touches as a new
version, and then the new manifest, one file that appears as a whole: before that, readers find the old table, and after it
the new one. A run that is cut short leaves files that no manifest names, and may be repeated.

One writer at a time; readers may come whenever they like. Folders of versions that no reader uses any more may be deleted
(``unused``).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fairlead.operators.joins import upsert

_MANIFEST = "version long, bucket int, written long, buckets int, keys array<string>, schema string"
_BUCKET = "__bucket"


def read_if_there(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame | None:
    """A Parquet table, or None where nothing is stored yet; other errors are the caller's."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


class BucketedTable:
    """The table at ``path`` with rows unique by ``keys``. ``buckets`` counts for a new table only."""

    def __init__(self, spark: SparkSession, path: str, keys: str | list[str], buckets: int = 256):
        self.spark, self.path = spark, path.rstrip("/")
        self.keys = [keys] if isinstance(keys, str) else list(keys)
        self.new_buckets = buckets

    def _state(self) -> list:
        """The newest manifest: a row for each bucket that has rows, so as many as there are buckets at most."""
        stored = read_if_there(self.spark, f"{self.path}/manifest", _MANIFEST)
        if stored is None:
            return []
        newest = stored.agg(F.max("version")).first()[0]
        found = stored.where(F.col("version") == newest).collect() if newest is not None else []
        if found and found[0].keys != self.keys:
            raise ValueError(f"the table's keys are {found[0].keys}")
        return found

    def _folder(self, written: int, bucket: int) -> str:
        return f"{self.path}/data/version={written}/{_BUCKET}={bucket}"

    def _read(self, entries: list) -> DataFrame:
        schema = StructType.fromJson(_json(entries[0].schema))
        return self.spark.read.schema(schema).parquet(*[self._folder(e.written, e.bucket) for e in entries])

    def exists(self) -> bool:
        return bool(self._state())

    def read(self) -> DataFrame:
        """The table as the newest manifest has it; later updates do not change what this frame reads."""
        state = self._state()
        if not state:
            raise ValueError(f"no table at {self.path}")
        return self._read(state)

    def upsert(self, updates: DataFrame) -> int:
        """Puts ``updates`` in place of rows with their keys, or beside the others; the last of equal updates by their
        columns. New columns are null in older rows. Rows with a null key are left out. Returns the buckets written."""
        state = self._state()
        n = state[0].buckets if state else self.new_buckets
        version = state[0].version + 1 if state else 1
        keyed = updates.where(F.col(self.keys[0]).isNotNull() if len(self.keys) == 1 else F.coalesce(*[F.col(k).cast("string") for k in self.keys]).isNotNull())
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(n)).cast("int")
        touched = {r[0] for r in keyed.select(bucket.alias("b")).distinct().collect()}
        if not touched:
            return 0
        old = [e for e in state if e.bucket in touched]
        base = self._read(old) if old else self._read(state[:1]).limit(0) if state else keyed.limit(0)
        for f in keyed.schema:
            if f.name not in base.columns:
                base = base.withColumn(f.name, F.lit(None).cast(f.dataType))
        merged = upsert(base, keyed, self.keys)
        schema = merged.schema
        # One task writes a bucket: its rows are dealt by the bucket, and a bucket has a file.
        merged.withColumn(_BUCKET, bucket).repartition(max(1, min(len(touched), n)), _BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{self.path}/data/version={version}")
        entries = [(version, e.bucket, e.written, n, self.keys, schema.json()) for e in state if e.bucket not in touched]
        entries += [(version, b, version, n, self.keys, schema.json()) for b in sorted(touched)]
        self.spark.createDataFrame(entries, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return len(touched)

    def unused(self) -> list[str]:
        """Folders of bucket versions that the newest manifest does not name."""
        stored = read_if_there(self.spark, f"{self.path}/manifest", _MANIFEST)
        if stored is None:
            return []
        live = {(e.written, e.bucket) for e in self._state()}
        known = stored.select("written", "bucket").distinct().collect()
        return [self._folder(r.written, r.bucket) for r in known if (r.written, r.bucket) not in live]


def _json(text: str) -> dict:
    import json

    return json.loads(text)
