"""Contracts of vessel messages: schemas, validation with reasons, and the split into valid and rejected rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlead.functions.geo import in_any_box
from fairlead.functions.text import iso_utc, strip_padding, vendor_time

# Primitive types of a contract and their column types; anything else is a string.
_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "bytes": T.BinaryType()}
#: Columns that the transport adds to a contract's own.
TECHNICAL = T.StructType(
    [
        T.StructField("correlation_id", T.StringType()), T.StructField("_ingestion_time", T.TimestampType()), T.StructField("_partition", T.LongType()), T.StructField("_offset", T.LongType()),
        T.StructField("_processing_time", T.TimestampType()), T.StructField("_schema_version", T.LongType()), T.StructField("_dt", T.StringType()),
    ]
)

ENVELOPE = (
    "MessageType string, MetaData struct<MMSI: bigint, time_utc: string>, Message struct<"
    "PositionReport: struct<UserID: bigint, Latitude: double, Longitude: double, Sog: double, Cog: double, TrueHeading: int, NavigationalStatus: int>, "
    "ShipStaticData: struct<UserID: bigint, ImoNumber: bigint, Name: string, CallSign: string, Type: int, Dimension: struct<A: int, B: int, C: int, D: int>, MaximumStaticDraught: double, Destination: string, Eta: struct<Month: int, Day: int, Hour: int, Minute: int>>>"
)


def column_type(kind) -> T.DataType:
    """Of a union the first member that is not null; a union of nulls, or an unknown type, is a string."""
    if isinstance(kind, list):
        kind = next((k for k in kind if k != "null"), "string")
    return _TYPES.get(kind, T.StringType()) if isinstance(kind, str) else T.StringType()


def contract_schema(contract: dict, technical: bool = False) -> T.StructType:
    """Column schema of an Avro record contract (as parsed JSON)."""
    fields = [T.StructField(f["name"], column_type(f["type"]), True) for f in contract["fields"]]
    return T.StructType(fields + (list(TECHNICAL) if technical else []))


def computed_once(df: DataFrame, *columns: Column) -> DataFrame:
    """``df.select(*columns)`` whose expressions are not copied into later filters and fields: they pass through a
    generator of one row, which the optimizer does not push expressions across."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def parse_messages(raw: DataFrame, column: str = "value") -> DataFrame:
    """``raw`` text kept, and its parsed envelope as ``m``; text that does not parse has a null envelope. Each message is
    parsed once, however many fields are read later."""
    text = F.col(column).cast("string")
    return computed_once(raw, text.alias("raw"), F.from_json(text, ENVELOPE).alias("m"))


def route(messages: DataFrame, kind: str) -> DataFrame:
    """Messages of one type; other types are left out without a word."""
    return messages.where(F.col("m.MessageType") == kind)


def marked(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Each row with ``reasons``: the rules that do not hold; a null test does not hold."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()]), lambda x: x.isNotNull())
    return computed_once(df, *df.columns, failed.alias("reasons"))


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) of marked rows; the rejected keep their reasons."""
    return rows.where(F.size("reasons") == 0).drop("reasons"), rows.where(F.size("reasons") > 0)


def quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): a row is rejected, with ``reasons``, by each rule that does not hold. To read the input once for
    both, write or count the rows of ``marked`` instead."""
    return split(marked(df, rules))


def checked_positions(messages: DataFrame) -> DataFrame:
    """Position contract, all rows with their ``raw`` text and ``reasons``. The envelope's vessel number counts before the
    report's."""
    r = F.col("m.Message.PositionReport")
    mmsi = F.when(F.col("m.MetaData.MMSI") != 0, F.col("m.MetaData.MMSI"))
    out = computed_once(
        route(messages, "PositionReport"),
        F.col("raw"),
        F.coalesce(mmsi, r["UserID"], F.lit(0).cast("long")).alias("mmsi"),
        vendor_time(F.col("m.MetaData.time_utc")).alias("timestamp"),
        r["Latitude"].alias("lat"),
        r["Longitude"].alias("lon"),
        r["Sog"].alias("speed"),
        r["Cog"].alias("cog"),
        r["TrueHeading"].alias("heading"),
        r["NavigationalStatus"].alias("nav_status"),
    )
    rules = {
        "mmsi": F.col("mmsi") > 0,
        "timestamp": F.col("timestamp").isNotNull(),
        "lat": F.col("lat").between(-90, 90),
        "lon": F.col("lon").between(-180, 180),
        "speed": F.col("speed") >= 0,
    }
    return marked(out.withColumn("timestamp", iso_utc("timestamp")), rules)


def positions(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) of the position contract."""
    good, bad = split(checked_positions(messages))
    return good.drop("raw"), bad


def static_data(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Static and voyage contract. The report's vessel number counts before the envelope's; zero stands for unknown."""
    d = F.col("m.Message.ShipStaticData")
    known = lambda c: F.nullif(c, F.lit(0))
    added = lambda a, b: F.nullif(F.coalesce(d["Dimension"][a], F.lit(0)) + F.coalesce(d["Dimension"][b], F.lit(0)), F.lit(0))
    eta = F.when(d["Eta"].isNotNull(), F.to_json(F.struct(*[d["Eta"][k].alias(k) for k in ("Day", "Hour", "Minute", "Month")])))
    out = route(messages, "ShipStaticData").select(
        "raw", F.coalesce(known(d["UserID"]), F.col("m.MetaData.MMSI"), F.lit(0).cast("long")).alias("mmsi"), known(d["ImoNumber"]).alias("imo"), strip_padding(d["Name"]).alias("name"), strip_padding(d["CallSign"]).alias("callsign"), d["Type"].alias("ship_type"),
        added("A", "B").alias("length_m"), added("C", "D").alias("beam_m"), F.round(d["MaximumStaticDraught"], 2).alias("draught_m"), strip_padding(d["Destination"]).alias("destination"), eta.alias("eta"),
    )
    good, bad = quarantine(out, {"mmsi": F.col("mmsi") > 0})
    return good.drop("raw"), bad


def decoded(rows: DataFrame, contract: dict, column: str = "value") -> DataFrame:
    """Topic values (JSON text) as the contract's columns, beside the rows' own other columns, which give way to them where
    names clash; all rows, with their text as ``raw`` and as ``reasons`` the fields that the contract wants and the value
    lacks (``value`` itself, where it is no object). ``split`` parts them; each value is parsed once.

    A field's default in the contract fills it where the value does not name it."""
    schema = contract_schema(contract)
    names = [f.name for f in schema]
    beside = [c for c in rows.columns if c != column and c not in (*names, "raw", "reasons")]
    text = F.col(column).cast("string")
    parsed = computed_once(rows, *[F.col(c) for c in beside], text.alias("raw"), F.from_json(text, schema).alias("o"), F.json_object_keys(text).alias("named"))
    default = {f["name"]: f.get("default") for f in contract["fields"]}
    value = lambda n: F.col(f"o.`{n}`") if default[n] is None else F.when(F.array_contains("named", n), F.col(f"o.`{n}`")).otherwise(F.lit(default[n]).cast(schema[n].dataType))
    out = parsed.select(*beside, "raw", F.col("named").isNotNull().alias("__object"), *[value(n).alias(n) for n in names])
    wanted = {f["name"]: F.col(f"`{f['name']}`").isNotNull() | ~F.col("__object") for f in contract["fields"] if f["type"] != "null" and not (isinstance(f["type"], list) and "null" in f["type"])}
    return marked(out, {"value": F.col("__object")} | wanted).drop("__object")


def reject_value(kind: str) -> Column:
    return F.to_json(F.struct(F.concat_ws(",", "reasons").alias("reason"), F.lit(kind).alias("message_type"), "raw"))


def reject_records(rejected: DataFrame, kind: str) -> DataFrame:
    """key and JSON value of each rejected message: its reason, its type and its text."""
    return rejected.select(F.when(F.col("mmsi") > 0, F.col("mmsi").cast("string")).alias("key"), reject_value(kind).alias("value"))


def message_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy(F.coalesce("m.MessageType", F.lit("unreadable")).alias("message_type")).agg(F.count("*").alias("messages"))


def select_area(df: DataFrame, boxes, vessels: list[int] | None = None) -> DataFrame:
    """Positions in any of the boxes and, if given, of at most fifty vessels."""
    if vessels and len(vessels) > 50:
        raise ValueError("at most 50 vessels")
    out = df.where(in_any_box("lat", "lon", boxes))
    return out.where(F.col("mmsi").isin(*vessels)) if vessels else out


def with_technical(df: DataFrame, version: int, time: str = "timestamp") -> DataFrame:
    """Processing time, contract version and day of a row."""
    return df.withColumns({"_processing_time": F.current_timestamp(), "_schema_version": F.lit(version).cast("long"), "_dt": F.substring(F.col(time).cast("string"), 1, 10)})
