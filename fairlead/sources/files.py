"""Readers: broker topics, incremental files, documents that hold several objects, reference tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlead.operators import slices


def topic(spark: SparkSession, servers: str, name: str, starting: str = "earliest", most_per_batch: int | None = None) -> DataFrame:
    """A broker topic as a stream, with its metadata; needs the broker connector on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", name).option("startingOffsets", starting).option("includeHeaders", "true")
    if most_per_batch:
        reader = reader.option("maxOffsetsPerTrigger", most_per_batch)
    return topic_columns(reader.load())


def topic_columns(df: DataFrame) -> DataFrame:
    """Value and metadata under the technical names; the lineage id comes from the header ``correlation_id``."""
    return df.select("key", "value", F.col("timestamp").alias("_ingestion_time"), F.col("partition").cast("long").alias("_partition"), F.col("offset").alias("_offset"), header("headers", "correlation_id").alias("correlation_id"))


def header(headers: str, name: str) -> Column:
    """The last value of a header, as text; null where there is none."""
    return F.get(F.reverse(F.filter(headers, lambda h: h["key"] == name)), F.lit(0))["value"].cast("string")


def raw_text(df: DataFrame) -> DataFrame:
    """Malformed messages as they came, with their time."""
    return df.select(F.col("value").cast("string").alias("raw_payload"), F.col("_ingestion_time").alias("ts"))


def new_files(spark: SparkSession, path: str, schema: T.StructType, glob: str = "*.parquet", most_per_batch: int | None = None) -> DataFrame:
    """Parquet files as a stream, each read once under its query's checkpoint, with provenance."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    if most_per_batch:
        reader = reader.option("maxFilesPerTrigger", most_per_batch)
    return with_provenance(reader.parquet(path))


def all_files(spark: SparkSession, path: str, glob: str = "*.parquet") -> DataFrame:
    """The same as a table; columns that later files add are null in earlier ones."""
    return with_provenance(spark.read.option("mergeSchema", "true").option("pathGlobFilter", glob).parquet(path))


def with_provenance(df: DataFrame) -> DataFrame:
    """source_file, and partition_date from its ``_dt=`` folder."""
    day = F.regexp_extract("source_file", r"_dt=(\d{4}-\d{2}-\d{2})", 1)
    return df.withColumn("source_file", F.col("_metadata.file_path")).withColumn("partition_date", F.when(day != "", F.to_date(day)))


def require_tables(spark: SparkSession, *names: str) -> list[DataFrame]:
    missing = [n for n in names if not spark.catalog.tableExists(n)]
    if missing:
        raise RuntimeError("missing tables: " + ", ".join(missing))
    return [spark.table(n) for n in names]


def joined_objects(spark: SparkSession, path: str, schema: T.StructType | str, first: int = 0, most: int | None = None) -> DataFrame:
    """Files of JSON objects that simply follow one another, as rows ``file``, ``idx`` and ``o`` in their order of each file.

    A file is read in splits, as pieces that end at closing braces, so no task holds a file, however long. What a piece
    does follows from the state before it: its quotes change whether one is within a string, and its braces outside of
    strings change the depth. Both add up along the file, split by split (``slices.along``); where the depth comes back to
    zero an object ends. Its pieces, as many as it has closing braces, are put together again.

    White space between objects and after the last one is left out. An object that does not fit ``schema`` is null, as
    ``from_json`` has it. Empty files have no rows.
    """
    read = spark.read.option("lineSep", "}").text(path)
    at = {"file": F.col("_metadata.file_path"), "split": F.col("_metadata.file_block_start"), "place": F.monotonically_increasing_id()}
    pieces = read.select(F.col("value").alias("piece"), *[c.alias(n) for n, c in at.items()])
    pieces = pieces.withColumns({slices.KEY: F.struct("file"), slices.SLICE: F.col("split")})

    bare = F.regexp_replace("piece", r"\\(?s:.)", "")  # without escaped characters, quotes are all ends of strings
    parts = F.split(bare, '"')
    every_second = lambda odd: F.array_join(F.filter(parts, lambda _, i: i % 2 == odd), "")
    braces = lambda odd: F.length(every_second(odd)) - F.length(F.translate(every_second(odd), "{", ""))
    counted = pieces.withColumns({"quotes": F.size(parts) - 1, "opens": braces(0), "opens_quoted": braces(1)})
    counted = slices.along(counted, ["place"], running={"quotes_so_far": F.col("quotes")})
    began_quoted = (F.col("quotes_so_far") - F.col("quotes")) % 2 == 1
    closes = (F.col("quotes_so_far") % 2 == 0).cast("int")
    deeper = F.when(began_quoted, F.col("opens_quoted")).otherwise(F.col("opens")) - closes
    placed = slices.along(counted.withColumn("deeper", deeper), ["place"], running={"depth": F.col("deeper")})
    # What follows the last object ends at no brace, so it alone seems to go below zero.
    ends = ((F.col("depth") == 0) & (F.col("quotes_so_far") % 2 == 0)).cast("int")
    placed = slices.along(placed.where("depth >= 0").withColumn("ends", ends), ["place"], running={"ended": F.col("ends")})
    placed = slices.whole(placed).withColumn("idx", (F.col("ended") - F.col("ends")).cast("int")).where(F.col("idx") >= first)
    if most is not None:
        placed = placed.where(F.col("idx") < first + most)
    whole = placed.groupBy("file", "idx").agg(F.max("ends").alias("whole"), F.array_sort(F.collect_list(F.struct("split", "place", "piece"))).alias("pieces"))
    body = F.concat(F.array_join(F.transform("pieces", lambda p: p["piece"]), "}"), F.lit("}"))
    return whole.where("whole = 1").select("file", "idx", F.from_json(body, schema).alias("o"))


def newer_than(df: DataFrame, time: str, seen: Column | None, initial: int = 50) -> DataFrame:
    """Rows newer than the last seen, oldest first; without one, the newest ``initial`` rows."""
    if seen is None:
        return df.orderBy(F.desc(time)).limit(initial)
    return df.where(F.col(time) > seen).orderBy(time)


def sea_ports(locations: DataFrame) -> DataFrame:
    """locode, name, lat, lon of UN/LOCODE rows with a location, a port function and readable decimal coordinates."""
    pair = F.split(F.regexp_replace("CoordinatesDecimal", r'"|\s', ""), ",")
    out = locations.where((F.trim(F.coalesce("Location", F.lit(""))) != "") & F.startswith(F.trim("Function"), F.lit("1")))
    number = lambda i: F.round(F.get(pair, F.lit(i)).try_cast("double"), 6)
    out = out.select(F.concat(F.trim("Country"), F.trim("Location")).alias("locode"), F.trim("Name").alias("name"), number(0).alias("lat"), number(1).alias("lon"))
    return out.where("lat is not null and lon is not null")


def register_csv(spark: SparkSession, path: str, look_in: int = 15) -> DataFrame:
    """A register whose headings stand below title lines: the first of ``look_in`` lines that names the IMO number."""
    lines = [r[0] for r in spark.read.text(path).limit(look_in).collect()]
    at = next((i for i, line in enumerate(lines) if "imo" in line.lower()), 0)
    raw = spark.read.option("header", "false").csv(path)
    head = [c or f"_{i}" for i, c in enumerate(spark.read.option("header", "false").csv(spark.sparkContext.parallelize([lines[at]], 1)).first())]
    names = raw.columns
    # Lines up to the headings are known by their text.
    skipped = spark.read.option("header", "false").schema(raw.schema).csv(spark.sparkContext.parallelize(lines[: at + 1], 1))
    key = F.to_json(F.struct(*names))
    return raw.withColumn("__key", key).join(F.broadcast(skipped.select(key.alias("__key")).distinct()), "__key", "left_anti").select(*[F.col(c).alias(h) for c, h in zip(names, head)])
