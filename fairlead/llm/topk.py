"""Exact top-k inner products with a pivot-distance index.

Vectors of integers are lifted by one coordinate so that all have one norm; then the largest inner product is the
smallest distance. Every vector is keyed by its nearest pivot and its distance from it, and each pivot's vectors are cut
by distance into annuli, stored as blocks of vectors. A query meets annuli in rounds, nearest first: by the triangle
inequality no vector of an annulus is nearer than the annulus's distance from the query's own ring, so once a query has
k answers nearer than that, the annulus and all beyond it are left out.

Candidates are rows: a row that repeats another's id and vector is a candidate of its own, and comes out again. Rows with
the query's id are its own and are never its candidates; rows that repeat a query's id and vector ask once. Equal vectors
are one entry with its smallest ids, and equal queries are answered once. Where lengths differ, missing components count
as zero. Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows without id. Ties
go to the smaller id; with fewer than k candidates all are returned; without any there are no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, table

#: Pivots grow with the square root of the number of vectors, an eighth of it, and their annuli with the vectors of a pivot,
#: one for so many; both stay between bounds, which bound the directory on the driver too. Pivots are fitted on a sample
#: of so many vectors for each.
PIVOTS, ANNULI, IN_ANNULUS, SAMPLE_A_PIVOT = (8, 1024), (4, 16), 128, 256
#: Vectors in a stored block, and queries that meet it at once.
BLOCK_VECTORS, BLOCK_QUERIES = 512, 256
#: Annuli met by a query in the rounds before the last, which meets all that its bound leaves.
ROUNDS = (2, 24)
#: Fills the id rows of vectors with fewer copies; no id of a row.
NO_ID = -(1 << 63)
#: Slack for rounding in distances, against scores that are exact integers.
SLACK = 1e-6
#: Integer types that stored vectors may have, narrowest first.
_KINDS = ("<i2", "<i4", "<i8")


def quantised(column: str = "embedding", scale: int = 256):
    """floor(scale * x) of each component as double; null where any is null or not finite."""
    xs = F.col(column).cast("array<double>")
    bad = F.exists(xs, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when((F.size(xs) > 0) & ~F.coalesce(bad, F.lit(False)), F.transform(xs, lambda x: F.floor(x * scale).cast("long")))


def choose_pivots(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Centres of the sample, from evenly spread starting rows."""
    x = sample.astype(np.float64)
    centres = x[np.linspace(0, len(x) - 1, min(count, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = ((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)).argmin(1)
        for j in range(len(centres)):
            if (near == j).any():
                centres[j] = x[near == j].mean(0)
    return np.unique(centres, axis=0)


def as_vector(numbers: np.ndarray) -> bytes:
    """Bytes of an integer vector or of rows of them, in the narrowest type that holds all; the first byte names it."""
    most = int(np.abs(numbers).max(initial=0))
    kind = 0 if most < 1 << 15 else 1 if most < 1 << 31 else 2
    return bytes([kind]) + numbers.astype(_KINDS[kind]).tobytes()


def of_vector(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, _KINDS[raw[0]], offset=1)


def stacked(raws) -> np.ndarray:
    """Vectors as rows of long integers, shorter ones filled up with zeros."""
    rows = [of_vector(r) for r in raws]
    if len({r.size for r in rows}) == 1:
        return np.stack(rows).astype(np.int64)
    out = np.zeros((len(rows), max(r.size for r in rows)), np.int64)
    for i, r in enumerate(rows):
        out[i, : r.size] = r
    return out


def fitted(x: np.ndarray, width: int) -> np.ndarray:
    """``x`` with columns of zeros up to ``width``."""
    return x if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products; by floating point where every sum fits into it."""
    width = min(q.shape[1], x.shape[1])  # what one side lacks is zero
    q, x = q[:, :width], x[:, :width]
    if np.abs(q).max() * np.abs(x).max() * width < 1 << 52:
        return np.rint(q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return q @ x.T


def distances(x: np.ndarray, lift: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances of the vectors ``x`` with last coordinate ``lift`` from ``centres``, whose last column is theirs."""
    width = max(x.shape[1], centres.shape[1] - 1)
    x, c = fitted(x, width).astype(np.float64), fitted(centres[:, :-1], width)
    squares = (x * x).sum(1) + lift * lift
    return np.sqrt(np.maximum(squares[:, None] - 2 * (x @ c.T + np.outer(lift, centres[:, -1])) + (centres * centres).sum(1), 0))


def bound_of(scores, ids, k: int) -> float:
    """The score by which k of the best rows are found whichever one id is left out, or minus infinity."""
    met: dict[int, int] = {}
    for i, (score, vec_id) in enumerate(zip(scores, ids), 1):
        met[vec_id] = met.get(vec_id, 0) + 1
        if i - max(met.values()) >= k:
            return float(score)
    return -math.inf


class PivotIndex:
    """The index over ``vectors`` (vec_id long, v array<long>)."""

    def __init__(self, vectors: DataFrame, k: int, pivots: int | None = None, annuli: int | None = None):
        self.spark, self.k = vectors.sparkSession, k
        # 2 k rows hold k that are not of a certain id, if no id counts more than k times.
        self.held = held = 2 * k

        def packed(batches):
            for batch in batches:
                lists = batch.column("v")
                numbers, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy().cumsum()[:-1]
                made = [as_vector(x) for x in np.split(numbers, ends)] if len(lists) else []
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(made, pa.binary())], names=["vec_id", "v"])

        usable = vectors.where("v is not null and vec_id is not null").select("vec_id", "v")
        self.valid = durable(usable.mapInArrow(packed, "vec_id long, v binary"), "vectors")
        # Copies are counted before they meet, and of a hot vector each task passes on its smallest ids only.
        counted = self.valid.groupBy("v", "vec_id").agg(F.count("*").alias("copies"))
        fewest = counted.withColumn("place", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("place") <= k + 1)
        repeated = F.array_repeat("vec_id", F.least("copies", F.lit(k)).cast("int"))
        listed = fewest.groupBy("v").agg(F.slice(F.array_sort(F.flatten(F.collect_list(repeated))), 1, held).alias("ids"))
        self.entries = durable(listed.withColumn("entry", F.monotonically_increasing_id()), "entries")
        self.count = self.entries.count()
        if self.count:
            pivots = pivots or min(max(math.isqrt(self.count) // 8, PIVOTS[0]), PIVOTS[1])
            self._place(pivots, annuli or min(max(self.count // (pivots * IN_ANNULUS), ANNULI[0]), ANNULI[1]))

    def _place(self, pivots: int, annuli: int) -> None:
        held = self.held
        sample = self.entries.select("entry", "v").orderBy(F.xxhash64("v"), "entry").limit(SAMPLE_A_PIVOT * pivots).collect()
        sample = stacked([r["v"] for r in sample])

        def norms(batches):
            for pdf in batches:
                yield pd.DataFrame({"n": [(stacked(pdf["v"]).astype(np.float64) ** 2).sum(1).max()]})

        self.top = top = float(self.entries.select("v").mapInPandas(norms, "n double").agg(F.max("n")).first()[0])
        lifted = lambda x: np.sqrt(np.maximum(top - (x.astype(np.float64) ** 2).sum(1), 0))
        self.pivots = centres = choose_pivots(np.c_[sample.astype(np.float64), lifted(sample)], pivots)

        def place(batches):
            for pdf in batches:
                near, away = np.zeros(len(pdf), np.int32), np.zeros(len(pdf))
                for a in range(0, len(pdf), 1024):
                    x = stacked(pdf["v"].iloc[a : a + 1024])
                    d = distances(x, lifted(x), centres)
                    near[a : a + 1024], away[a : a + 1024] = d.argmin(1), d.min(1)
                yield pdf.assign(pivot=near, away=away)

        placed = durable(self.entries.mapInPandas(place, "v binary, ids array<long>, entry long, pivot int, away double"), "placed")
        cuts = placed.groupBy("pivot").agg(F.percentile_approx("away", [i / annuli for i in range(1, annuli)], 1000).alias("cuts"))
        ringed = placed.join(F.broadcast(cuts), "pivot")  # a row for each pivot
        ringed = durable(ringed.withColumn("annulus", F.size(F.filter("cuts", lambda c: c < F.col("away")))).drop("cuts"), "ringed")
        # Blocks: an annulus of any size is dealt over as many of them as it fills.
        counts = ringed.groupBy("pivot", "annulus").agg(F.count("*").alias("rows"), F.min("away").alias("inner"), F.max("away").alias("outer"))
        rows = [tuple(r) for r in counts.orderBy("pivot", "annulus").collect()]  # at most pivots x annuli rows
        self.directory = [(p, a, -(-n // BLOCK_VECTORS), inner, outer) for p, a, n, inner, outer in rows]
        self.parts = F.broadcast(self.spark.createDataFrame([d[:3] for d in self.directory], "pivot int, annulus int, parts long"))
        dealt = ringed.join(self.parts, ["pivot", "annulus"]).withColumn("part", F.pmod(F.xxhash64("entry"), F.col("parts")))

        def block(pdf: pd.DataFrame) -> pd.DataFrame:
            ids = np.full((len(pdf), held), NO_ID, np.int64)
            for i, x in enumerate(pdf["ids"]):
                ids[i, : len(x)] = x
            one = pdf.iloc[:1][["pivot", "annulus", "part"]]
            return one.assign(vectors=as_vector(stacked(pdf["v"])), ids=ids.tobytes())

        # About BLOCK_VECTORS rows meet in a group, since an annulus is dealt over as many as it needs.
        grouped = dealt.select("pivot", "annulus", "part", "v", "ids").groupBy("pivot", "annulus", "part")
        self.blocks = durable(grouped.applyInPandas(block, "pivot int, annulus int, part long, vectors binary, ids binary"), "annuli")

    def _visits(self, state: DataFrame, met: int, most: int | None) -> DataFrame:
        """(entry, v, bound, pivot, annulus): the annuli that each query vector meets next, nearest first."""
        k, top, centres = self.k, self.top, self.pivots
        ring, annulus, _, inner, outer = (np.array(x) for x in zip(*self.directory))

        def plan(batches):
            for pdf in batches:
                if not len(pdf):
                    continue
                x = stacked(pdf["v"]).astype(np.float64)
                length = np.sqrt((x * x).sum(1))
                scale = np.where(length > 0, math.sqrt(top) / np.maximum(length, 1e-300), 0.0)
                # A longer query of the same direction has the same order.
                d = distances(x * scale[:, None], np.zeros(len(x)), centres)[:, ring]
                least = np.maximum(np.maximum(inner - d, d - outer), 0)
                order = np.argsort(least, axis=1, kind="stable")[:, met : None if most is None else met + most]
                bounds = np.array([bound_of([h["score"] for h in hits], [h["vec_id"] for h in hits], k) if hits is not None else -math.inf for hits in pdf["hits"]])
                known = np.isfinite(bounds) & (scale > 0)
                far = np.full(len(x), np.inf)
                far[known] = np.sqrt(np.maximum(2 * top - 2 * bounds[known] * scale[known], 0)) * (1 + SLACK) + SLACK
                asker, at = np.nonzero(np.take_along_axis(least, order, 1) <= far[:, None])
                where = order[asker, at]
                rows = pdf.iloc[asker][["entry", "v"]]
                yield rows.assign(bound=bounds[asker], pivot=ring[where].astype(np.int32), annulus=annulus[where].astype(np.int32))

        return state.select("entry", "v", "hits").mapInPandas(plan, "entry long, v binary, bound double, pivot int, annulus int")

    def _hits(self, visits: DataFrame, groups: int) -> DataFrame:
        """(entry, score, vec_id) of blocks met: each query's best rows of each block, and perhaps some more."""
        held = self.held

        def chunk(pdf: pd.DataFrame) -> pd.DataFrame:
            one = pdf.iloc[:1][["pivot", "annulus"]]
            askers, bounds = pdf["entry"].to_numpy(np.int64).tobytes(), pdf["bound"].to_numpy(np.float64).tobytes()
            return one.assign(askers=askers, wanted=as_vector(stacked(pdf["v"])), bounds=bounds)

        # About BLOCK_QUERIES queries meet in a group, and each group meets each block of the annulus on its own.
        dealt = visits.withColumn("chunk", F.pmod(F.xxhash64("entry"), F.lit(groups))).groupBy("pivot", "annulus", "chunk")
        chunks = dealt.applyInPandas(chunk, "pivot int, annulus int, askers binary, wanted binary, bounds binary").join(self.parts, ["pivot", "annulus"])
        chunks = chunks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))

        def meet(batches):
            for pdf in batches:
                for askers, wanted, bounds, vectors, ids in zip(pdf["askers"], pdf["wanted"], pdf["bounds"], pdf["vectors"], pdf["ids"]):
                    askers, ids = np.frombuffer(askers, np.int64), np.frombuffer(ids, np.int64).reshape(-1, held)
                    rows = lambda raw, n: of_vector(raw).reshape(n, -1).astype(np.int64)
                    score = _products(rows(wanted, len(askers)), rows(vectors, len(ids)))
                    chosen = score >= np.frombuffer(bounds)[:, None]
                    listed = [np.unique(i[i != NO_ID]) for i in ids] if (ids[:, 1] != NO_ID).any() else [ids[:, 0]]
                    once = np.concatenate(listed)
                    if len(ids) > held and len(np.unique(once)) == len(once):  # no id has two vectors here
                        chosen &= score >= np.partition(score, len(ids) - held, axis=1)[:, [len(ids) - held]]
                    asker, at = np.nonzero(chosen)
                    i, j = np.nonzero(ids[at] != NO_ID)
                    if len(i):
                        yield pd.DataFrame({"entry": askers[asker[i]], "score": score[asker[i], at[i]], "vec_id": ids[at[i], j]})

        met = chunks.join(self.blocks, ["pivot", "annulus", "part"])
        return met.select("askers", "wanted", "bounds", "vectors", "ids").mapInPandas(meet, "entry long, score long, vec_id long")

    def search(self, queries: DataFrame) -> DataFrame:
        """(entry, hits): for each distinct query vector its best (score, vec_id), enough for k whichever id is left out."""
        k, held = self.k, self.held
        asked = self.valid.join(queries.select("vec_id").distinct(), "vec_id", "left_semi").distinct()
        self.asked = durable(asked.join(self.entries.select("v", "entry"), "v").select("vec_id", "entry", "v"), "asked")
        vectors = durable(self.asked.groupBy("entry").agg(F.first("v").alias("v")), "query-vectors")
        groups = max(1, -(-vectors.count() // BLOCK_QUERIES))
        hits_type = "array<struct<score:bigint,vec_id:bigint>>"
        best, met = None, 0
        for most in (*ROUNDS, None):
            state = vectors.withColumn("hits", F.lit(None).cast(hits_type)) if best is None else vectors.join(best, "entry", "left")
            hits = self._hits(self._visits(state, met, most), groups)
            if best is not None:
                hits = hits.unionByName(best.select("entry", F.explode("hits").alias("h")).select("entry", "h.score", "h.vec_id"))
            # One shuffle by entry serves both ranks: at most k rows of an id, then the best of all.
            dealt = hits.repartition("entry")
            of_id = F.row_number().over(W.partitionBy("entry", "vec_id").orderBy(F.desc("score")))
            dealt = dealt.withColumn("place", of_id).where(F.col("place") <= k)
            rank = F.row_number().over(W.partitionBy("entry").orderBy(F.desc("score"), "vec_id"))
            ranked = dealt.withColumn("rank", rank).where(F.col("rank") <= held)
            listed = F.array_sort(F.collect_list(F.struct("rank", "score", "vec_id")))
            best = ranked.groupBy("entry").agg(F.transform(listed, lambda h: F.struct(h["score"].alias("score"), h["vec_id"].alias("vec_id"))).alias("hits"))
            best = durable(best, "best")
            met += most or 0
        return best

    def top_k(self, queries: DataFrame) -> DataFrame:
        """query_id, rank, vec_id, score for the rows of ``queries`` (vec_id)."""
        if not self.count:
            return self.spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        best = self.search(queries)
        hits = self.asked.select(F.col("vec_id").alias("query_id"), "entry").join(best, "entry").select("query_id", F.explode("hits").alias("h"))
        hits = hits.select("query_id", "h.score", "h.vec_id").where("vec_id <> query_id")
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return hits.withColumn("rank", rank).where(F.col("rank") <= self.k).select("query_id", "rank", "vec_id", "score")


def op1_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), quantised().alias("v"))
    return PivotIndex(vectors, k=5).top_k(vectors.where(F.col("vec_id") % 50 == 0))


OP1_SQL = """
WITH rows AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, v FROM rows) q JOIN rows c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
