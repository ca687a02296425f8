"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed by cell (source, language, topic). Raking scales the cells until their sums by source, by
language and by topic agree with the targets; a document's weight is its cell's raked mass over its own. Documents are
then sampled by calibrated probabilities, weight times a factor that meets the token budget, cut at 1; the draw is a
hash of the doc_id, so every run and every retry picks the same ones.

Targets name the categories; any other value, and null, is the category 'other'. A target without documents is left
out and the rest share its part; a category that has documents but no target keeps its own share. Cells are therefore
no more than the product of the targets' sizes plus one each. Null and empty texts have no tokens: their weight is their
cell's (1 in a cell without tokens). Rows with one doc_id share one draw; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, whole_text

OTHER = "other"
#: Cells that the targets may make.
MAX_CELLS = 200_000
ROUNDS, TOLERANCE = 200, 1e-9
_WORD = r"\S+"
_STEPS = 1 << 40

#: Production targets, as shares of tokens.
TARGETS = {
    "source": {f"src{i}": 0.05 for i in range(20)},
    "lang": {"en": 0.45, "de": 0.2, "fr": 0.2, "es": 0.15},
    "topic": {"none": 0.6} | {str(i): 0.04 for i in range(10)},
}
#: Share of all tokens that the sample may hold.
BUDGET = 0.6


def rake(cells: np.ndarray, codes: np.ndarray, targets: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Scaled masses of the cells. ``codes``: each cell's category by margin; ``targets``: shares by margin, NaN where a
    category keeps its own share."""
    total = cells.sum()
    if not total:
        return cells.astype(float).copy()
    goals = []
    for code, target in zip(codes.T, targets):
        own = np.bincount(code, cells, minlength=len(target)) / total
        free = np.isnan(target)
        goal = np.where(own > 0, np.where(free, 0, np.nan_to_num(target)), 0)
        kept = own[free].sum()
        goal *= (1 - kept) / goal.sum() if goal.sum() else 0
        goal = np.where(free, own, goal)
        goals.append(goal / goal.sum() * total)
    x = cells.astype(float).copy()
    for _ in range(rounds):
        off = 0.0
        for code, goal in zip(codes.T, goals):
            now = np.bincount(code, x, minlength=len(goal))
            factor = np.where(now > 0, goal / np.where(now > 0, now, 1), 1)
            off = max(off, np.abs(factor - 1)[now > 0].max(initial=0))
            x *= factor[code]
        if off < tolerance:
            break
    return x


def calibrate(mass: np.ndarray, weight: np.ndarray, budget: float) -> float:
    """The factor f with sum(mass * min(1, f * weight)) = budget * sum(mass), or where all are taken if none has."""
    want, low, high = budget * mass.sum(), 0.0, 1.0
    if not want:
        return 0.0
    while (mass * np.minimum(1, high * weight)).sum() < want * (1 - 1e-12) and high < 1e18:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if (mass * np.minimum(1, mid * weight)).sum() < want else (low, mid)
    return high


def mix(documents: DataFrame, targets: dict[str, dict[str, float]] = TARGETS, budget: float = BUDGET, seed: int = 17) -> DataFrame:
    """``documents`` with n_tokens (as ``with_tokens`` adds it, where it is not there yet), mix_weight, mix_probability and
    mix_kept. The targets' names are columns of it."""
    spark, names = documents.sparkSession, list(targets)
    size = 1
    for t in targets.values():
        size *= len(t) + 1
    if size > MAX_CELLS:
        raise ValueError(f"the targets make {size} cells, more than {MAX_CELLS}")

    def category(name):
        return F.when(F.col(name).cast("string").isin(*targets[name]), F.col(name).cast("string")).otherwise(F.lit(OTHER)).alias(f"cell_{name}")

    counted = documents if "n_tokens" in documents.columns else with_tokens(documents)
    cells = [f"cell_{n}" for n in names]
    rows = counted.select(*map(category, names), "n_tokens").groupBy(*cells).agg(F.sum("n_tokens").alias("mass")).orderBy(*cells).collect()  # at most MAX_CELLS rows
    levels = [[*t, OTHER] if OTHER not in t else [*t] for t in targets.values()]
    codes = np.array([[level.index(r[c]) for level, c in zip(levels, cells)] for r in rows]).reshape(len(rows), len(names))
    shares = [np.array([t.get(x, np.nan) for x in level], float) for t, level in zip(targets.values(), levels)]
    mass = np.array([r["mass"] for r in rows], float)
    raked = rake(mass, codes, shares)
    weight = np.divide(raked, mass, out=np.ones_like(raked), where=mass > 0)
    factor = calibrate(mass, weight, budget)
    # From Arrow: a frame made of a local list would start Python workers of another kind on the executors.
    known = {c: pa.array([r[c] for r in rows], pa.string()) for c in cells}
    known |= {"mix_weight": pa.array(weight, pa.float64()), "mix_probability": pa.array(np.minimum(1.0, factor * weight), pa.float64())}
    known = spark.createDataFrame(pa.table(known))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long")), F.lit(_STEPS)) / F.lit(float(_STEPS))
    joined = counted.withColumns({c: category(n) for c, n in zip(cells, names)}).join(F.broadcast(known), cells, "left")
    return joined.drop(*cells).withColumn("mix_kept", draw < F.col("mix_probability"))


def with_tokens(documents: DataFrame) -> DataFrame:
    """``documents`` with n_tokens. Counted before any join, texts need not move for a sum of tokens."""
    return documents.withColumn("n_tokens", F.regexp_count(whole_text(), F.lit(_WORD)).cast("long"))


def with_topic(documents: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic of a document: the label of the vector with its id, or 'none'."""
    topics = table(spark, sf_dir, "embeddings").where("vec_id is not null").groupBy(F.col("vec_id").cast("long").alias("doc_id")).agg(F.min("label").cast("string").alias("topic"))
    return documents.join(topics, "doc_id", "left").withColumn("topic", F.coalesce("topic", F.lit("none")))


def op5_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")
    documents = with_tokens(documents).drop("text")
    return mix(with_topic(documents, spark, sf_dir)).select("doc_id", "source", "lang", "topic", "n_tokens", "mix_weight", "mix_probability", "mix_kept")
