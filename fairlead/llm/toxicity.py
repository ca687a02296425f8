"""Toxicity by multiple-instance learning: sentence probabilities joined by noisy-or, trained from document labels.

Only documents carry labels. A sentence's logit is a bias plus the weights of its words' terms (the word and its
4-, 5- and 6-byte beginnings, hashed); a document is toxic unless every sentence is clean, so its probability is
1 - prod(1 - p). Training maximises the likelihood of the document labels over a bounded labelled sample; scoring covers
every sentence of every document and names the offending ones.

Null and empty texts have no sentences and score 0. Where the sample has no toxic or no clean document, no sentence can be
told from another, and every score is 0. Repeated rows are scored each on its own; texts of any length count whole; other
columns play no part. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SpanHash, slices, spans, table, whole_text, with_columns

#: Bound of the labelled sample that the weights are learnt from.
MAX_SAMPLE = 8192
#: Hashed terms.
TERMS = 1 << 20
#: A term must be in so many toxic documents of the sample, and so many times likelier there, to get a weight.
LEAST_TOXIC, LEAST_LIFT = 3, 8.0
PREFIXES = (4, 5, 6)
CLEAN_LOGIT = -14.0

_LETTER = np.zeros(256, bool)
_LETTER[128:] = True
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[ord("0") : ord("9") + 1] = True
_BREAK = np.zeros(256, bool)
_BREAK[list(b".!?\n")] = True


def sentence_terms(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice: term matrix (words by kinds, -1 where a word is too short), each word's sentence, each sentence's
    document, and the sentences' bounds in bytes of the slice."""
    buffer = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.fromiter((len(x) for x in texts), np.int64, len(texts))
    doc = np.repeat(np.arange(len(texts)), lengths)
    s_start, s_end = spans(~_BREAK[buffer], doc)
    start, end = spans(_LETTER[buffer], doc)
    size, kinds = end - start, []
    hashed = SpanHash(buffer)
    for salt, k in enumerate((0, *PREFIXES)):
        long = size >= max(k, 1)
        stop = np.where(long, start + k, end) if k else end
        term = (hashed.of(start, stop, salt + 1) >> np.uint64(44)).astype(np.int64)
        kinds.append(np.where(long, term, -1))
    sentence = np.searchsorted(s_start, start, "right") - 1
    return np.stack(kinds, axis=1) if len(start) else np.zeros((0, 4), np.int64), sentence, doc[s_start], s_start, s_end


def lowered(texts):
    return [t.lower() if t else "" for t in texts]


def fit_noisy_or(doc, sentence, term, label, terms: int, rounds: int = 300, rate: float = 0.3, ridge: float = 1e-3):
    """Weights of ``terms`` terms and the bias. ``sentence``, ``term``: pairs; ``doc``: each sentence's document."""
    n, total = len(label), max(len(doc), 1)
    w, bias = np.zeros(terms), -6.0
    moments = [np.zeros(terms + 1), np.zeros(terms + 1)]
    for step in range(1, rounds + 1):
        z = bias + np.bincount(sentence, w[term], minlength=len(doc))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.bincount(doc, np.logaddexp(0, np.clip(z, -30, 30)), minlength=n)  # -log of P(no toxic sentence)
        slope = np.where(label > 0, -1 / np.expm1(np.maximum(clean, 1e-9)), 1.0)
        g = np.clip(slope, -1e6, 1)[doc] * p / n
        grad = np.r_[np.bincount(term, g[sentence], minlength=terms) + ridge * w / n, g.sum()]
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.999 * moments[1] + 0.001 * grad**2
        move = rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-9)
        w, bias = w - move[:-1], min(bias - move[-1], -6.0)
    return w, bias


def learn(documents: DataFrame, labels: DataFrame, max_sample: int = MAX_SAMPLE):
    """(terms, weights, bias) from at most ``max_sample`` labelled documents; None where nothing can be learnt."""
    chosen = (
        labels.where("doc_id is not null and label is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("label").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_sample)
    )
    rows = documents.join(F.broadcast(chosen), "doc_id").select("doc_id", whole_text().alias("text"), "label")

    def presence(batches):
        for pdf in batches:
            got = []
            for first, last, encoded in slices(lowered(pdf["text"])):
                terms, sentence, owner, _, _ = sentence_terms(encoded)
                at = np.repeat(owner[sentence], terms.shape[1]) if len(terms) else np.zeros(0, np.int64)
                flat = terms.ravel()
                pairs = np.unique(at[flat >= 0] * TERMS + flat[flat >= 0])
                y = pdf["label"].to_numpy()[first:last]
                got.append((pairs % TERMS, y[pairs // TERMS]))
            if got:
                t, y = (np.concatenate(x) for x in zip(*got))
                yield pd.DataFrame({"term": t, "toxic": y, "clean": 1 - y}).groupby("term", as_index=False).sum()

    counted = documents.sparkSession.sparkContext
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return None
    lift = ((F.col("toxic") + 0.5) / (sizes[1] + 1)) / ((F.col("clean") + 0.5) / (sizes[0] + 1))
    found = (
        rows.mapInPandas(presence, "term long, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where((F.col("toxic") >= LEAST_TOXIC) & (lift >= LEAST_LIFT)).orderBy("term").select("term").collect()
    )  # at most TERMS rows
    if not found:
        return None
    terms = np.array([r[0] for r in found])
    shared = counted.broadcast(terms)

    def instances(batches):
        terms = shared.value
        number = np.full(TERMS, -1, np.int64)
        number[terms] = np.arange(len(terms))
        for pdf in batches:
            for first, last, encoded in slices(lowered(pdf["text"])):
                t, sentence, owner, _, _ = sentence_terms(encoded)
                at = np.repeat(sentence, t.shape[1]) if len(t) else np.zeros(0, np.int64)
                k = number[t.ravel()] if len(t) else np.zeros(0, np.int64)
                k[t.ravel() < 0] = -1
                at, k = at[k >= 0], k[k >= 0]
                base = np.searchsorted(owner, np.arange(last - first))
                for i in range(last - first):
                    lo, hi = base[i], base[i + 1] if i + 1 < last - first else len(owner)
                    own = (at >= lo) & (at < hi) if len(at) else np.zeros(0, bool)
                    yield pd.DataFrame({"doc_id": [int(pdf["doc_id"].iloc[first + i])], "label": [int(pdf["label"].iloc[first + i])], "sentences": [int(hi - lo)], "at": [(at[own] - lo).astype(np.int32)], "term": [k[own].astype(np.int32)]})

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id").head(max_sample)
        base = np.r_[0, np.cumsum(pdf["sentences"])].astype(np.int64)
        doc = np.repeat(np.arange(len(pdf)), pdf["sentences"])
        at = np.concatenate([b + np.asarray(x, np.int64) for b, x in zip(base, pdf["at"])] or [np.zeros(0, np.int64)])
        term = np.concatenate([np.asarray(x, np.int64) for x in pdf["term"]])
        w, bias = fit_noisy_or(doc, at, term, pdf["label"].to_numpy(), len(terms))
        return pd.DataFrame({"w": [w.tobytes()], "bias": [bias]})

    # One group, of at most `max_sample` rows.
    got = rows.mapInPandas(instances, "doc_id long, label int, sentences int, at array<int>, term array<int>").groupBy(F.lit("sample").alias("of")).applyInPandas(fit, "w binary, bias double").collect()[0]
    return terms, np.frombuffer(got["w"]), got["bias"]


def score_toxicity(documents: DataFrame, labels: DataFrame, max_sample: int = MAX_SAMPLE, locate_from: float = 0.5) -> DataFrame:
    """doc_id, score, n_sentences, and ``offending``: spans (code points) and probabilities of sentences from
    ``locate_from`` on. ``labels``: doc_id and label (0 or 1), only those that may be learnt from."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(learn(documents, labels, max_sample))
    schema = "score double, n_sentences int, offending array<struct<first:int,past:int,probability:double>>"

    def work(texts):
        model = shared.value
        weight = np.zeros(TERMS + 1)
        if model is not None:
            weight[model[0]] = model[1]
        # Case is folded by characters that keep their length, so spans hold for the text as it came.
        low = ["".join(c if len(c.lower()) != 1 else c.lower() for c in t) if t and len(t.lower()) != len(t) else (t or "").lower() for t in texts]
        score, count = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        offending: list[list] = [[] for _ in texts]
        for first, last, encoded in slices(low):
            terms, sentence, owner, s_start, s_end = sentence_terms(encoded)
            count[first:last] = np.bincount(owner, minlength=last - first)
            if model is None or not len(owner):
                continue
            z = np.bincount(sentence, weight[terms].sum(axis=1), minlength=len(owner)) + model[2]
            clean = np.bincount(owner, np.logaddexp(0, np.where(z <= model[2], CLEAN_LOGIT, z)), minlength=last - first)
            score[first:last] = -np.expm1(-clean)
            offset = np.r_[0, np.cumsum([len(x) for x in encoded])]
            for s in np.flatnonzero(z >= np.log(locate_from / (1 - locate_from))):
                i = owner[s]
                raw, a, b = encoded[i], s_start[s] - offset[i], s_end[s] - offset[i]
                begin = len(raw[:a].decode("utf-8", "surrogatepass"))
                offending[first + i].append({"first": begin, "past": begin + len(raw[a:b].decode("utf-8", "surrogatepass")), "probability": float(1 / (1 + np.exp(-z[s])))})
        return np.clip(score, 0, 1), count, offending

    plain = documents.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return with_columns(plain, [F.col("text")], schema, work, keep=["doc_id"])


def op7_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    labels = table(spark, sf_dir, "labels").where(fold != 1).select("doc_id", F.col("toxic").alias("label"))
    scored = score_toxicity(documents, labels)
    return scored.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_sentences", F.size("offending").alias("n_offending"))
