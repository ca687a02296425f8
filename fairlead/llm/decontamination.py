"""Benchmark decontamination over a distributed positional inverted index, in DataFrame operations only.

A window is a run of consecutive words of a test item. The index holds, for the test terms that can tell windows
apart, the documents and positions where they stand (a posting for each), written to the shared folder. For a window,
the lists of its two rarest indexed terms, by postings in the whole corpus, are shifted by the terms' places in the
window and intersected; what is left is compared word by word with the document. Proximity matches let the two lists
differ by a number of words.

Texts are lower-cased in A-Z only. Null and empty texts have no words, an item without words no windows; repeated items
count under their item_id once, and an item without id is left out. Documents are told apart by doc_id and text, so rows
that share a doc_id are judged each by its own text, rows without doc_id like any other, and repeated rows come out alike.
Columns other than doc_id and text play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, table, whole_text

#: Words of a window.
WINDOW = 13
#: Indexed terms of each window: those in the fewest test items.
INDEXED = 3
#: A table of at most so many bytes may be broadcast, counting its values and ROW_BYTES for each row; larger ones are
#: joined by a shuffle.
BROADCAST_BYTES = 64_000_000
ROW_BYTES = 100

# The capitals that are folded, and what is no word.
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text):
    return F.regexp_extract_all(F.translate(text, _CAPITALS, _SMALL), F.lit(_WORD), F.lit(0))


def document_key(doc_id: str = "doc_id", text: str = "text"):
    """What a document is known by: a hash of its doc_id and text."""
    return F.xxhash64(F.col(doc_id).cast("long"), whole_text(text))


def _small(df: DataFrame) -> DataFrame:
    """``df`` (stored), marked for broadcast if it is small in bytes."""
    held = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))) + ROW_BYTES)).first()[0] or 0
    return F.broadcast(df) if held <= BROADCAST_BYTES else df


class PositionalIndex:
    """Postings of the test terms of ``items`` in ``documents``, and matches of the items' windows."""

    def __init__(self, documents: DataFrame, items: DataFrame, window: int = WINDOW, indexed: int = INDEXED):
        self.window = window
        self.documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).withColumn("key", document_key())
        tokens = items.where("item_id is not null").select("item_id", words_of(whole_text()).alias("words")).where(F.size("words") > 0).distinct()
        length = F.least(F.size("words"), F.lit(window))
        starts = tokens.select("item_id", "words", length.alias("length"), F.explode(F.sequence(F.lit(0), F.size("words") - length)).alias("at"))
        windows = starts.select("item_id", F.slice("words", F.col("at") + 1, F.col("length")).alias("phrase")).distinct()
        self.windows = durable(windows.withColumn("window_id", F.xxhash64("item_id", "phrase")), "windows")
        places = self.windows.select("window_id", F.posexplode("phrase").alias("place", "term"))
        spread = self.windows.select("item_id", F.explode("phrase").alias("term")).distinct().groupBy("term").agg(F.count("*").alias("items"))
        rank = F.row_number().over(W.partitionBy("window_id").orderBy("items", F.desc(F.length("term")), "term", "place"))
        self.places = durable(places.join(spread, "term").withColumn("rank", rank).where(F.col("rank") <= indexed).select("window_id", "place", "term"), "places")
        terms = durable(self.places.select("term").distinct(), "terms")
        postings = self.documents.select("key", F.posexplode(words_of(F.col("text"))).alias("pos", "term")).join(_small(terms), "term")
        self.postings = durable(postings, "postings")

    def _rarest(self) -> DataFrame:
        """The two rarest indexed places of each window (one, for a window of one word)."""
        frequency = self.postings.groupBy("term").agg(F.count("*").alias("df"))
        rank = F.row_number().over(W.partitionBy("window_id").orderBy("df", "term", "place"))
        listed = self.places.join(frequency, "term").withColumn("rank", rank)
        # A window whose indexed terms are not all in the corpus is not in it either.
        full = self.places.groupBy("window_id").agg(F.count("*").alias("needed"))
        found = listed.groupBy("window_id").agg(F.count("*").alias("found"), F.max(F.when(F.col("rank") == 1, F.struct("term", "place"))).alias("first"), F.max(F.when(F.col("rank") == 2, F.struct("term", "place"))).alias("second"))
        return durable(found.join(full, "window_id").where("found = needed").select("window_id", "first", F.coalesce("second", "first").alias("second")), "rarest")

    def aligned(self, slop: int = 0) -> DataFrame:
        """(window_id, key, start): where both rarest terms of a window stand as it has them, give or take ``slop``."""
        rarest = self._rarest()

        def shifted(which):
            chosen = rarest.select("window_id", F.col(f"{which}.term").alias("term"), F.col(f"{which}.place").alias("place"))
            return self.postings.join(_small(chosen), "term").select("window_id", "key", (F.col("pos") - F.col("place")).alias("start"))

        first, second = shifted("first"), shifted("second")
        if not slop:
            return first.join(second, ["window_id", "key", "start"], "left_semi").where("start >= 0").distinct()
        second = second.withColumnRenamed("start", "other")
        return first.join(second, ["window_id", "key"]).where(F.abs(F.col("start") - F.col("other")) <= slop).select("window_id", "key", "start").distinct()

    def phrase_matches(self) -> DataFrame:
        """(key, item_id, start, length): every exact occurrence of a window."""
        candidates = durable(self.aligned().join(_small(self.windows), "window_id").select("key", "item_id", "start", "phrase"), "candidates")
        keys = durable(candidates.select("key").distinct(), "candidate-keys")
        texts = self.documents.join(_small(keys), "key", "left_semi").dropDuplicates(["key"]).select("key", words_of(F.col("text")).alias("words"))
        # Word by word: the window starts at 0 or later, and a slice past the end is shorter.
        same = F.slice("words", F.col("start") + 1, F.size("phrase")) == F.col("phrase")
        return candidates.join(durable(texts, "candidate-words"), "key").where(same).select("key", "item_id", "start", F.size("phrase").alias("length"))

    def proximity_matches(self, slop: int) -> DataFrame:
        """(key, item_id, start) where a window's two rarest terms stand within ``slop`` words of their distance in it."""
        return self.aligned(slop).join(self.windows.select("window_id", "item_id"), "window_id").select("key", "item_id", "start").distinct()


def hits(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """For each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and its ``document_key``."""
    index = PositionalIndex(documents, items, window)
    matches = durable(index.phrase_matches(), "matches")
    n_hit = matches.select("key", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("pos")).distinct().groupBy("key").agg(F.count("*").alias("n_hit"))
    named = matches.select("key", F.col("item_id").cast("string").alias("item")).distinct().groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    found = durable(n_hit.join(named, "key"), "found")
    counted = index.documents.select("doc_id", "key", F.regexp_count("text", F.lit(_WORD_ANY_CASE)).cast("long").alias("n_words"))
    out = counted.join(_small(found), "key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items_here = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items_here).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items_here).cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.col("key").alias("document_key"),
    )


def op10_positional_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("document_key")


_WORDS_SQL = rf"regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}'), '{_WORD}')"
OP10_SQL = f"""
WITH item AS (SELECT DISTINCT item_id, {_WORDS_SQL} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (SELECT DISTINCT item_id, list_slice(w, s + 1, s + least(len(w), {WINDOW})) AS p FROM (SELECT item_id, w, unnest(range(len(w) - least(len(w), {WINDOW}) + 1)) AS s FROM item WHERE len(w) > 0)),
doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS w FROM documents),
grams AS (SELECT r, k, l, list_slice(w, k + 1, k + l) AS p FROM (SELECT r, w, l, unnest(range(len(w) - l + 1)) AS k FROM doc CROSS JOIN (SELECT DISTINCT len(p) AS l FROM windows))),
met AS (SELECT DISTINCT r, k, l, item_id FROM grams JOIN windows USING (p)),
hit AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(k, k + l)) AS pos FROM met) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM met) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""
