"""File streams whose columns change over time.

The schema a stream reads by is kept in a log of versions. When the stream starts, files that came since the last version
widen it: new columns are added, and a column's type gives way to a wider one. While it runs, each micro-batch's files are
looked at before anything is written; one with columns that the log does not know widens the log and stops the stream
(one with a wider type stops it by itself, as Spark does not read it), whose batch is then taken again, whole, under the
new schema. So no file's columns are lost, and rows of earlier files have nulls in columns of later ones.

JSON files need no such stop: fields that the schema lacks, or whose values do not fit it, are kept as text in a column
of their own.
"""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import with_provenance
from .sinks import Writer
from .tables import read_if_there

RESCUED = "_rescued"
# Types in the order in which they give way to one another.
_WIDER = ["tinyint", "smallint", "int", "bigint", "double", "string"]
_LOG = "version long, schema string, at timestamp"


class SchemaChanged(Exception):
    """The stream's files have columns or types that its schema lacked; the log knows them now, so start it again."""


def wider(known: T.StructType, found: T.StructType) -> T.StructType:
    """``known`` with the columns of ``found`` added and its types widened where they must be."""
    fields = {f.name.lower(): f for f in known}
    for f in found:
        old = fields.get(f.name.lower())
        if old is None:
            fields[f.name.lower()] = T.StructField(f.name, f.dataType, True)
        elif old.dataType != f.dataType:
            fields[f.name.lower()] = T.StructField(old.name, _common(old.dataType, f.dataType, old.name), True)
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in fields.values()])


def _common(a: T.DataType, b: T.DataType, name: str) -> T.DataType:
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return wider(a, b)
    order = [_WIDER.index(x.simpleString()) if x.simpleString() in _WIDER[:-1] else None for x in (a, b)]
    if None in order:
        raise ValueError(f"column {name} is {a.simpleString()} in some files and {b.simpleString()} in others")
    return a if order[0] >= order[1] else b


class SchemaLog:
    """Versions of a stream's schema, in a folder all executors share. Later versions are never narrower."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _newest(self):
        stored = read_if_there(self.spark, self.folder, _LOG)
        return stored.orderBy(F.desc("version")).first() if stored is not None else None

    def current(self) -> T.StructType | None:
        newest = self._newest()
        return T.StructType.fromJson(json.loads(newest.schema)) if newest else None

    def widen(self, found: T.StructType, seen: datetime | None = None) -> bool:
        """Adds a version if ``found`` calls for one, and says whether it did."""
        newest = self._newest()
        known = T.StructType.fromJson(json.loads(newest.schema)) if newest else T.StructType([])
        schema = wider(known, found)
        if newest is not None and schema == known:
            return False
        row = (newest.version + 1 if newest else 1, schema.json(), seen or datetime.now())
        self.spark.createDataFrame([row], _LOG).coalesce(1).write.mode("append").parquet(self.folder)
        return True

    def look(self, path: str, glob: str = "*.parquet") -> T.StructType:
        """The schema to read ``path`` by, widened by the Parquet files that came since the newest version."""
        newest = self._newest()
        began = datetime.now()
        reader = self.spark.read.option("mergeSchema", "false").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
        if newest is not None:
            reader = reader.option("modifiedAfter", newest.at.strftime("%Y-%m-%dT%H:%M:%S"))
        try:
            files = [r[0] for r in reader.format("binaryFile").load(path).select("path").collect()]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            files = []
        if files:
            self.widen(schema_of(self.spark, files), began)
        schema = self.current()
        if schema is None:
            raise ValueError(f"no files at {path}, and no schema in {self.folder}")
        return schema


def schema_of(spark: SparkSession, files: list[str]) -> T.StructType:
    """The widened schema of Parquet files, by their footers."""
    try:
        return T.StructType([T.StructField(f.name, f.dataType, True) for f in spark.read.option("mergeSchema", "true").parquet(*files).schema])
    except Exception:  # types that Spark does not merge by itself are widened file by file
        schema = T.StructType([])
        for file in files:
            schema = wider(schema, spark.read.parquet(file).schema)
        return schema


def evolving_files(spark: SparkSession, path: str, log: SchemaLog, glob: str = "*.parquet", most_per_batch: int | None = None) -> DataFrame:
    """Parquet files as a stream under the log's schema, with provenance. Write it by ``fan_out`` with ``guarded`` writers."""
    reader = spark.readStream.schema(log.look(path, glob)).option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    if most_per_batch:
        reader = reader.option("maxFilesPerTrigger", most_per_batch)
    return with_provenance(reader.parquet(path))


def guarded(writer: Writer, log: SchemaLog) -> Writer:
    """``writer``, kept from batches of ``evolving_files`` whose files say more than the stream's schema: the log is widened
    and ``SchemaChanged`` raised, before anything of the batch is written. A batch has as many files as the stream takes
    at once."""

    def write(batch: DataFrame, number: int) -> None:
        files = [r[0] for r in batch.select("source_file").distinct().collect()]
        if files:
            found, given = schema_of(batch.sparkSession, files), batch.schema
            plain = T.StructType([f for f in given if f.name not in ("source_file", "partition_date")])
            if wider(plain, found) != wider(plain, plain):
                log.widen(found)
                raise SchemaChanged(f"batch {number} has columns beyond the stream's: start it again")
        writer(batch, number)

    return write


def evolving_json(lines: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """JSON lines (a table or stream with a text ``column``) under ``schema``, with ``_rescued``: the fields it lacks, and
    those whose values do not fit it, as JSON text; null if there are none. A line that is no object is rescued whole."""
    made = lines.withColumn("__o", F.from_json(column, schema)).withColumn("__m", F.from_json(column, "map<string,string>"))
    known = F.array(*[F.lit(f.name) for f in schema])
    fits = F.create_map(*[x for f in schema for x in (F.lit(f.name), F.col(f"__o.`{f.name}`").isNotNull())])
    extra = F.map_filter("__m", lambda k, v: ~F.array_contains(known, k) | (v.isNotNull() & ~F.coalesce(F.element_at(fits, k), F.lit(False))))
    rescued = F.when(F.col("__m").isNull(), F.col(column)).when(F.size(extra) > 0, F.to_json(extra))
    return made.select(*[F.col(f"__o.`{f.name}`").alias(f.name) for f in schema], rescued.alias(RESCUED))
