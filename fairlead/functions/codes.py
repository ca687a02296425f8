"""Code lists of vessel messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Navigation status codes.
NAV_STATUS = {
    0: "under way using engine", 1: "at anchor", 2: "not under command", 3: "restricted manoeuvrability", 4: "constrained by draught", 5: "moored", 6: "aground", 7: "engaged in fishing", 8: "under way sailing",
    9: "reserved for HSC", 10: "reserved for WIG", 11: "towing astern", 12: "pushing ahead", 13: "reserved", 14: "AIS-SART", 15: "undefined",
}
# Ship type categories by first and last code; anything else is reserved.
SHIP_CATEGORIES = [
    (0, 0, "No disponible"), (20, 29, "WIG"), (30, 30, "Pesca"), (31, 32, "Remolque"), (33, 33, "Dragado / operaciones submarinas"), (34, 34, "Operaciones de buceo"), (35, 35, "Operaciones militares"), (36, 36, "Vela"), (37, 37, "Recreo"),
    (40, 49, "Alta velocidad"), (50, 50, "Practico"), (51, 51, "Salvamento y rescate"), (52, 52, "Remolcador"), (53, 53, "Servicio portuario"), (54, 54, "Anticontaminacion"), (55, 55, "Fuerzas del orden"), (58, 58, "Transporte medico"), (59, 59, "No combatiente"),
    (60, 69, "Pasaje"), (70, 79, "Carga"), (80, 89, "Tanque"), (90, 99, "Otros"),
]
RESERVED = "Reservado"
# Last digit of a cargo or tanker code and its hazard category.
HAZARD = {1: "A", 2: "B", 3: "C", 4: "D"}
# Vessel length bands, lower bound inclusive; the last band includes its upper bound.
LENGTH_BANDS = [(0, 100, "0-100"), (100, 200, "100-200"), (200, 300, "200-300"), (300, 600, "300-600")]
# Values that stand for 'not available'.
NO_HEADING, NO_COURSE, NO_STATUS = 511, 360, 15


def ship_category(code) -> Column:
    code = F.col(code) if isinstance(code, str) else code
    out = None
    for low, high, name in SHIP_CATEGORIES:
        test = code.between(low, high)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(RESERVED)


def length_band(metres) -> Column:
    m = F.col(metres) if isinstance(metres, str) else metres
    out = None
    for low, high, name in LENGTH_BANDS:
        test = ((m > low) if low == 0 else (m >= low)) & ((m <= high) if high == 600 else (m < high))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("OTHER")


def nav_status_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(NAV_STATUS.items()), "nav_status int, meaning string")


def ship_type_table(spark: SparkSession) -> DataFrame:
    """Codes 0 to 99 with category and hazard letter, from the ranges above."""
    code = F.col("ship_type")
    digit = code % 10
    hazard = F.when(code.between(70, 89) & digit.between(1, 4), F.element_at(F.array(*[F.lit(HAZARD[i]) for i in range(1, 5)]), F.greatest(digit, F.lit(1))))
    return spark.range(100).select(F.col("id").cast("int").alias("ship_type")).select("ship_type", ship_category(code).alias("category"), hazard.alias("hazard"))
