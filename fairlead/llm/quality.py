"""Quality by nearest-neighbour voting over latent-semantic vectors.

A document's terms are surface terms: pairs and triples of character-class runs (how words, capitals, figures, breaks
and signs follow one another) and how often words repeat. Term counts are damped, weighted by inverse document
frequency over the whole corpus and normalised. Latent directions are the leading singular vectors of a bounded sample
of labelled documents; that sample's vectors, with their labels, are broadcast, and every document is compared with all
of them by exact blocked cosine products. The nearest neighbours vote with weights that grow with similarity.

Empty and null texts have no terms: they get the share of label 1 in the sample, as does everything when there are no
labels at all (0.5 then). Among neighbours of equal similarity at the last place, any may vote. Rows with equal doc_ids are scored
each on its own text, and so are repeated rows; texts of any length count whole. Other columns pass through as they are,
but for one named as the score is, which the score replaces. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SpanHash, slices, small_batches, spans, table, whole_text, with_columns

#: Bound of the labelled sample that the neighbours come from, and of the latent directions.
MAX_SAMPLE = 4096
DIRECTIONS = 48
NEIGHBOURS = 15
#: Documents in one block of products.
BLOCK_ROWS = 256

# Character classes. 0 letter, 1 capital, 2 figure, 3 blank, 4 line break, 5 full stop, 6 comma and colon,
# 7 exclamation and question, 8 bars, brackets and slashes, 9 other signs, 10 quotes and hyphens.
_CLASSES = 11
_CLASS_OF = np.full(256, 9, np.uint8)
_CLASS_OF[128:] = 0
_CLASS_OF[ord("a") : ord("z") + 1] = 0
_CLASS_OF[ord("A") : ord("Z") + 1] = 1
_CLASS_OF[ord("0") : ord("9") + 1] = 2
for _k, _signs in ((3, b" \t"), (4, b"\n\r"), (5, b"."), (6, b",;:"), (7, b"!?"), (8, b"|()[]{}<>/\\=+"), (10, b"'\"-")):
    _CLASS_OF[list(_signs)] = _k
_LENGTHS = np.array([2, 3, 6])  # run lengths 1, 2, 3-5, 6 and more
_RUNS = _CLASSES * (len(_LENGTHS) + 1)
_TRIPLES = _RUNS * _RUNS
_REPEATS = _TRIPLES + _CLASSES**3
#: Steps of the share of repeated words, each a term of its own.
REPEAT_STEPS = 10
TERMS = _REPEATS + 2 * (REPEAT_STEPS + 1)


def term_counts(encoded: list[bytes]) -> np.ndarray:
    """Documents by terms, dense; the caller bounds the number of documents."""
    n = len(encoded)
    lengths = np.fromiter((len(x) for x in encoded), np.int64, n)
    out = np.zeros(n * TERMS, np.float32)
    buffer = np.frombuffer(b"".join(encoded), np.uint8)
    if not len(buffer):
        return out.reshape(n, TERMS)
    doc = np.repeat(np.arange(n), lengths)
    kind = _CLASS_OF[buffer]
    first = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | (doc[1:] != doc[:-1])])
    k, d = kind[first].astype(np.int64), doc[first]
    run = k * (len(_LENGTHS) + 1) + np.searchsorted(_LENGTHS, np.diff(first, append=len(kind)), "right")
    same = d[1:] == d[:-1]
    keys = [(d[1:] * TERMS + run[:-1] * _RUNS + run[1:])[same]]
    if len(d) > 2:
        keys.append((d[2:] * TERMS + _TRIPLES + (k[:-2] * _CLASSES + k[1:-1]) * _CLASSES + k[2:])[d[2:] == d[:-2]])
    out += np.bincount(np.concatenate(keys), minlength=len(out)).astype(np.float32)
    start, end = spans((kind != 3) & (kind != 4), doc)
    if len(start) > 1:
        word, owner = SpanHash(buffer).of(start, end), doc[start]
        words = np.bincount(owner, minlength=n)
        for step in (1, 2):
            again = owner[step:][(word[step:] == word[:-step]) & (owner[step:] == owner[:-step])]
            share = np.bincount(again, minlength=n) / np.maximum(words, 1)
            level = np.ceil(share * REPEAT_STEPS).astype(np.int64)
            has = words > step
            out[(np.arange(n) * TERMS + _REPEATS + (step - 1) * (REPEAT_STEPS + 1) + level)[has]] = 30 * has[has]
    return out.reshape(n, TERMS)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)
    return x


def _blocks(texts):
    for first, last, encoded in slices(texts):
        for at in range(0, last - first, BLOCK_ROWS):
            yield first + at, term_counts(encoded[at : at + BLOCK_ROWS])


def document_frequency(documents: DataFrame) -> tuple[np.ndarray, int]:
    """How many of all documents have each term (a fixed number of terms), and how many documents there are."""

    def run(batches):
        found, n = np.zeros(TERMS, np.int64), 0
        for pdf in batches:
            for _, counts in _blocks(pdf["text"]):
                found += (counts > 0).sum(axis=0)
                n += len(counts)
        yield pd.DataFrame({"term": np.r_[np.arange(TERMS)[found > 0], -1], "n": np.r_[found[found > 0], n]})

    rows = documents.select(whole_text().alias("text")).mapInPandas(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out, total = np.zeros(TERMS, np.int64), 0
    for term, n in rows:
        if term < 0:
            total = n
        else:
            out[term] = n
    return out, total


def leading_directions(x: np.ndarray, count: int, rounds: int = 6) -> np.ndarray:
    """Leading right singular vectors by subspace iteration from a fixed start."""
    count = min(count, *x.shape)
    q = np.linalg.qr(np.random.default_rng(7).standard_normal((x.shape[1], count)))[0]
    for _ in range(rounds):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    u, _, _ = np.linalg.svd((x @ q).T @ (x @ q))
    return (q @ u).astype(np.float32)


def latent(x: np.ndarray, directions: np.ndarray) -> np.ndarray:
    z = x @ directions
    return z / np.maximum(np.sqrt((z * z).sum(axis=1, keepdims=True)), 1e-12)


def votes(z: np.ndarray, known: np.ndarray, label: np.ndarray, neighbours: int, sharpness: float = 8.0) -> np.ndarray:
    """Similarity-weighted share of label 1 among the nearest of ``known``."""
    products = z @ known.T
    k = min(neighbours, known.shape[0])
    near = np.argpartition(-products, k - 1, axis=1)[:, :k] if k < known.shape[0] else np.tile(np.arange(k), (len(z), 1))
    weight = np.maximum(np.take_along_axis(products, near, 1), 1e-6).astype(np.float64) ** sharpness
    return (weight * label[near]).sum(axis=1) / weight.sum(axis=1)


def learn(documents: DataFrame, labels: DataFrame, idf: np.ndarray, max_sample: int = MAX_SAMPLE, directions: int = DIRECTIONS):
    """(directions, sample vectors, sample labels), from at most ``max_sample`` labelled documents; None without any."""
    spark = documents.sparkSession
    chosen = (
        labels.where("doc_id is not null and label is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("label").cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_sample)
    )
    rows = documents.join(F.broadcast(chosen), "doc_id").select("doc_id", whole_text().alias("text"), "label")

    def run(batches):
        for pdf in batches:
            for at, counts in _blocks(pdf["text"]):
                part = pdf.iloc[at : at + len(counts)]
                yield pd.DataFrame({"doc_id": part["doc_id"].values, "label": part["label"].values, "x": [row.tobytes() for row in weighted(counts, idf).astype(np.float16)]})

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id").head(max_sample)  # equal doc_ids could exceed the bound
        x = np.frombuffer(b"".join(pdf["x"]), np.float16).reshape(len(pdf), TERMS).astype(np.float32)
        v = leading_directions(x, directions)
        return pd.DataFrame({"directions": [v.tobytes()], "known": [latent(x, v).tobytes()], "label": [pdf["label"].to_numpy(np.float64).tobytes()], "count": [v.shape[1]]})

    # One group, of at most `max_sample` rows.
    got = rows.mapInPandas(run, "doc_id long, label double, x binary").groupBy(F.lit("sample").alias("of")).applyInPandas(fit, "directions binary, known binary, label binary, count int").collect()
    if not got:
        return None
    v = np.frombuffer(got[0]["directions"], np.float32).reshape(TERMS, got[0]["count"])
    return v, np.frombuffer(got[0]["known"], np.float32).reshape(-1, got[0]["count"]), np.frombuffer(got[0]["label"], np.float64)


def score_quality(documents: DataFrame, labels: DataFrame, score: str = "score", neighbours: int = NEIGHBOURS, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """``documents`` with a column ``score``. ``labels``: doc_id and label (0 or 1), only those that may be learnt from."""
    spark = documents.sparkSession
    small_batches(spark)
    found, total = document_frequency(documents)
    idf = np.log((1 + total) / (1 + found)).astype(np.float32) + np.float32(0.1)
    model = learn(documents, labels, idf, max_sample)
    shared = spark.sparkContext.broadcast((idf, model))
    plain = [c for c in documents.columns if c != score]

    def work(texts):
        idf, model = shared.value
        out = np.full(len(texts), 0.5 if model is None else model[2].mean())
        if model is not None:
            v, known, label = model
            for at, counts in _blocks(texts):
                has = counts.any(axis=1)
                if has.any():
                    out[at + np.flatnonzero(has)] = votes(latent(weighted(counts[has], idf), v), known, label, neighbours)
        return (np.clip(out, 0.0, 1.0),)

    return with_columns(documents, [whole_text()], f"{score} double", work, keep=plain)


def op4_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    labels = table(spark, sf_dir, "labels").where(fold != 2).select("doc_id", F.col("quality").alias("label"))
    scored = score_quality(documents, labels)
    return scored.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
