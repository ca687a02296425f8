"""Line dedup over content-defined chunks of lines.

A chunk starts at every line with text and ends where it first holds two lines with text and ``least_chars`` bytes; the
same is done backwards from every line, so the bounds follow from the lines alone, whatever comes before or after. Chunks
overlap: together they cover every line of every run of several lines that occurs more than once, however short the run
and wherever it stands. A prefix sum hashes them all at once. Repeated chunks of the whole corpus keep their first
occurrence (smallest doc_id, then place in the text); the lines of the others are removed once their bytes agree with the
first's. Within one document an occurrence that overlaps the first one stays, so a run of equal lines keeps one chunk.

Lines without text count towards no chunk, but go with a chunk that they stand in. A line that is repeated on its own, and
a run of fewer than ``least_chars`` bytes, stay. As chunks overlap, the first place of one may lose a line to another
chunk that stood earlier still; the earliest place of each line is never removed.

Null and empty texts have no chunks. Rows that repeat a doc_id and its text are one document and come out alike; rows
without doc_id come last. A document may end up empty; its row stays.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SpanHash, as_batch, durable, slices, table, whole_text

LEAST_LINES, LEAST_CHARS = 2, 20
#: Bits of the sieve for repeated chunks (exact joins follow it).
SIEVE_BITS = 1 << 24


def chunks_of(texts, least_lines: int = LEAST_LINES, least_chars: int = LEAST_CHARS):
    """Yield (position, chunk hashes, first and last line of each chunk, byte bounds of the lines, text's bytes) of each text."""
    for first, _, encoded in slices(texts):
        buffer = np.frombuffer(b"".join(encoded), np.uint8)
        hashed = SpanHash(buffer)
        base = 0
        for i, raw in enumerate(encoded):
            n = len(raw)
            part = buffer[base : base + n]
            ends = np.r_[np.flatnonzero(part == 10), n]  # a line ends before its break
            starts = np.r_[0, ends[:-1] + 1]
            full = np.flatnonzero(np.logical_or.reduceat(np.append(part > 32, False), starts))  # lines with text
            a, b, place = starts[full], ends[full], np.arange(len(full))
            stop = np.maximum(place + least_lines - 1, np.searchsorted(b, a + least_chars))
            start = np.minimum(place - least_lines + 1, np.searchsorted(a, b - least_chars, "right") - 1)
            ahead, behind = stop < len(full), start >= 0
            size = len(full) + 1
            head, tail = np.divmod(np.unique(np.r_[(place * size + stop)[ahead], (start * size + place)[behind]]), size)
            yield first + i, hashed.of(a[head] + base, b[tail] + base, 3), np.c_[full[head], full[tail]], np.c_[starts, ends], raw
            base += n


def dedup_lines(documents: DataFrame, least_lines: int = LEAST_LINES, least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc_id, text without repeated chunks, n_chunks, n_removed (chunks), chars_removed; a row for each document."""
    spark = documents.sparkSession
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))

    def summaries(batches):
        for pdf in batches:
            found = [h.view(np.int64) for _, h, *_ in chunks_of(pdf["text"], least_lines, least_chars)]
            yield pd.DataFrame({"chunk": np.concatenate(found) if found else np.zeros(0, np.int64)})

    met = source.select("text").mapInPandas(summaries, "chunk long")
    repeated = durable(met.groupBy("chunk").agg(F.count("*").alias("rows")).where("rows > 1").select("chunk"), "repeated")

    # A bitmap of fixed size tells a task which chunks may be repeated, so that only their bytes are sent on.
    slot = F.pmod(F.col("chunk"), F.lit(SIEVE_BITS))
    cells = repeated.select(slot.alias("slot")).selectExpr("slot div 64 AS cell", "shiftleft(1L, cast(slot % 64 AS int)) AS bit").groupBy("cell").agg(F.bit_or("bit").alias("bits")).collect()
    held = np.zeros(SIEVE_BITS // 64, np.int64)
    for cell, bits in cells:
        held[cell] = bits
    shared = spark.sparkContext.broadcast(held)

    def bodies(batches):
        held = shared.value
        for batch in batches:
            docs, keys, out = batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), []
            for i, h, lines, span, raw in chunks_of(batch.column("text").to_pylist(), least_lines, least_chars):
                at = (h % np.uint64(SIEVE_BITS)).astype(np.int64)
                maybe = (held[at // 64] >> (at % 64)) & 1 == 1
                for j in np.flatnonzero(maybe):
                    a, b = lines[j]
                    out.append((docs[i], keys[i], int(a), int(b), int(h[j].view(np.int64)), raw[span[a, 0] : span[b, 1]]))
            yield as_batch(out, body_schema)

    body_schema = "doc_id long, key long, start int, stop int, chunk long, body binary"
    found = durable(source.select("doc_id", "key", "text").mapInArrow(bodies, body_schema), "bodies")
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "key", "start", "stop", "body")
    firsts = found.groupBy("chunk").agg(F.min(order).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    firsts = durable(firsts.select("chunk", F.col("first.key").alias("first_key"), F.col("first.stop").alias("first_stop"), F.col("first.body").alias("first_body")), "firsts")
    again = found.join(firsts, "chunk").where((F.col("body") == F.col("first_body")) & ~((F.col("key") == F.col("first_key")) & (F.col("start") <= F.col("first_stop"))))
    removed = durable(again.groupBy("key").agg(F.collect_set(F.struct("start", "stop")).alias("gone")), "removed")

    schema = "doc_id long, text string, n_chunks long, n_removed long, chars_removed long"

    def rebuilt(batches):
        for batch in batches:
            rows = []
            docs, gone_of = batch.column("doc_id").to_pylist(), batch.column("gone").to_pylist()
            for i, h, _, span, raw in chunks_of(batch.column("text").to_pylist(), least_lines, least_chars):
                gone = [] if gone_of[i] is None else gone_of[i]
                kept = raw
                if len(gone):
                    stays = np.ones(len(span), bool)
                    for g in gone:
                        stays[g["start"] : g["stop"] + 1] = False
                    kept = b"\n".join(raw[a:b] for a, b in span[stays])
                text = kept.decode("utf-8", "surrogatepass")
                rows.append((docs[i], text, len(h), len(gone), len(raw.decode("utf-8", "surrogatepass")) - len(text) if len(gone) else 0))
            yield as_batch(rows, schema)

    # Texts are dealt out at any size, so that the disk needed is in proportion to the input.
    return source.join(removed.hint("merge"), "key", "left").select("doc_id", "text", "gone").mapInArrow(rebuilt, schema)


def op8_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))
