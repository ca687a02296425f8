"""Corpus pipeline: quality, near-duplicates, decontamination, mixing, token files.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.llm.bitplanes import token_files
from fairlead.llm.common import durable, table, whole_text
from fairlead.llm.decontamination import document_key, hits
from fairlead.llm.jaccard import jaccard_components
from fairlead.llm.mixing import mix, with_tokens, with_topic
from fairlead.llm.quality import score_quality

#: Documents below this quality score go.
KEEP_FROM = 0.7


def _fresh(docs: DataFrame, name: str) -> str:
    """``name``, or with underscores before it what no column of ``docs`` is called."""
    while name.lower() in (c.lower() for c in docs.columns):
        name = f"_{name}"
    return name


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; empty ones get the sample's share of good labels. Other columns pass through."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    score = _fresh(docs, "__quality")
    return score_quality(docs, labels, score=score).where(F.col(score) >= KEEP_FROM).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id. A document is a doc_id with a text:
    of rows that repeat both one stays, and texts that share a doc_id are judged apart. Rows without doc_id or words stay."""
    groups = durable(jaccard_components(docs, words=5, num=80, den=100), "groups")
    named = groups.select(F.col("doc_id").alias("__near_id"), F.col("text_key").alias("__near_key"), "first", "n_shingles")
    dropped = durable(named.where("not first").select("__near_id", "__near_key").distinct(), "near-copies")
    text_key = _fresh(docs, "__text_key")
    keyed = docs.withColumn(text_key, F.xxhash64(whole_text()))
    same = (F.col("doc_id").cast("long") == F.col("__near_id")) & (F.col(text_key) == F.col("__near_key"))
    kept = keyed.join(dropped, same, "left_anti")
    rows = named.where("first and n_shingles > 0 and __near_id is not null").groupBy("__near_id", "__near_key").count()
    repeated = durable(rows.where("count > 1").select("__near_id", "__near_key"), "repeated")
    if not repeated.isEmpty():
        once = kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", text_key])
        kept = kept.join(repeated, same, "left_anti").unionByName(once)
    return kept.select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage by the contamination rule. Each row is judged by its own text, whether it
    shares its doc_id or has none; rows that repeat both go or stay together. Null and empty texts stay, an empty table
    stays empty, and other columns, whatever their names, pass through."""
    key = _fresh(docs, "document_key")
    found = hits(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("document_key").alias(key)).distinct()
    return docs.withColumn(key, document_key()).join(durable(found, "contaminated"), key, "left_anti").select(*docs.columns)


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents whose tokens follow the target weights. Rows travel as one value, so a column of theirs
    may have any name; null texts have no tokens, and null languages and sources are a category of their own."""
    rows = with_tokens(docs.select(F.struct("*").alias("__doc"), "doc_id", "text", "lang", "source")).drop("text")
    return mix(with_topic(rows, spark, sf_dir)).where("mix_kept").select("__doc.*")


def token_id_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the token files hold: doc_id, start, n_tokens, ids_crc32."""
    return token_files(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mixing_to_targets),
    ("token-ID / binary output", token_id_output),
]

#: SQL cannot express the classifier's latent vectors or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = durable(docs, f"stage{i}")
    return docs
