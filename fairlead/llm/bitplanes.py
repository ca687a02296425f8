"""Token-id files with bit-plane shuffling.

Documents are put in ascending ``doc_id`` order by a range shuffle, every whole text becomes ids plus an end id, and
the id stream of each range is cut into fixed-size blocks. A block's ids are transposed into bit planes (or byte
planes); each plane is compressed with zstandard on its own. One row of the file is one block: its planes and the index
entry that says where it starts and which documents have ids in it. Rows are Parquet rows written by Spark, so a task
that runs again replaces its own output, and any store that Spark writes to will do.

Null texts are empty (only the end id); null doc_ids sort first; equal doc_ids are ordered by a hash of their text, then
by text, so a doc_id with very many rows is dealt over several ranges too; rows that repeat both are encoded each. No
documents give no blocks. A text that holds an added token's string, such as an end mark, gets that token's id, as the
library gives it. Columns other than doc_id and text play no part.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_batch, durable, table, whole_text, work_folder

BLOCK_IDS = 65_536
#: Entries that a Python worker keeps of the words it has encoded; later ones are encoded anew each time.
CACHE_WORDS = 250_000
BLOCKS = (
    "part int, seq int, start long, n_ids int, mode string, plane_bytes array<int>, planes binary, "
    "first_doc long, doc_ids array<long>, doc_ids_in_block array<int>, continues boolean, ends boolean"
)

# The split pattern of the byte-level vocabulary, with classes of the standard module for the letters and
# digits that it shares with the original; texts with any other character take the tokenizer's own split.
_WORD = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_UNUSUAL = re.compile(r"[^\t\n\r -~\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧‰-⁞₠-₿]")
_USUAL_LATIN = bytes(c for c in range(256) if not _UNUSUAL.match(chr(c)))
_LOOSE = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ")


def _unusual(text: str) -> bool:
    try:
        return bool(text.encode("latin-1").translate(None, _USUAL_LATIN))
    except UnicodeEncodeError:
        return bool(_UNUSUAL.search(text))


def _loose_space(text: str) -> bool:
    """A blank beside other white space, or at an end: words are not simply parted at blanks then."""
    return text[:1] == " " or text[-1:] == " " or any(x in text for x in _LOOSE)


class WordEncoder:
    """Encodes whole texts with a ``tokenizers`` file, each distinct word once as far as the cache reaches.

    The byte-level vocabulary's own rule first splits a text into words and never merges across them, so the ids of a
    text are the ids that the library's model gives its words, in order. Texts with characters whose class the standard
    module sees otherwise, texts that hold an added token's string, and other kinds of tokenizer are encoded whole.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = isinstance(self.tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel) and self.tokenizer.normalizer is None
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        # The vocabulary writes a byte as the character of its number where that is visible, else as one from 256 on.
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in shown]
        self.letters = [chr(256 + hidden.index(b)) if b in hidden else chr(b) for b in range(256)]
        self.limit = cache_words
        self.words: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        written = "".join(map(self.letters.__getitem__, word.encode()))
        got = array("I", [t.id for t in self.model.tokenize(written)]).tobytes()
        if len(self.words) < self.limit:
            self.words[word] = got
        return got

    def _unit(self, unit: str) -> bytes:
        known, ids = self.words.get, b""
        for word in _WORD.findall(unit):
            ids += known(word) or self._word(word)
        return ids

    def _by_word(self, text: str) -> bool:
        return self.by_word and not _unusual(text) and not any(x in text for x in self.added)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out: list[bytes | None] = [None] * len(texts)
        whole, units = [], self.units
        for i, text in enumerate(texts):
            if not self._by_word(text):
                whole.append(i)
                continue
            if _loose_space(text):
                parts = _WORD.findall(text)
            else:  # every space here stands between two visible characters, and a word begins with it
                parts = text.replace(" ", "\0 ").split("\0")
            ids = list(map(units.get, parts))
            if None in ids:
                fresh: dict[str, bytes] = {}
                for at, known in enumerate(ids):
                    if known is None:
                        part = parts[at]
                        ids[at] = fresh.get(part) or fresh.setdefault(part, self._unit(part))
                if len(units) < self.limit:
                    units.update(fresh)
            out[i] = b"".join(ids)
        if whole:
            for i, e in zip(whole, self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)):
                out[i] = array("I", e.ids).tobytes()
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def shuffle_planes(ids: np.ndarray, mode: str = "bit", level: int = 3) -> tuple[list[int], bytes]:
    """Planes of a block, lowest first, each compressed; planes above the largest id's top bit are left out."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=level).compress
    octets = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    top = int(ids.max()).bit_length() if len(ids) else 0
    planes = []
    for k in range((top + 7) // 8):
        column = octets[:, k]
        if mode == "byte":
            planes.append(squeeze(column.tobytes()))
        else:
            planes += [squeeze(np.packbits((column >> b) & 1, bitorder="little").tobytes()) for b in range(min(8, top - 8 * k))]
    return [len(p) for p in planes], b"".join(planes)


def restore_ids(n: int, mode: str, sizes, data: bytes) -> np.ndarray:
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    ids, at = np.zeros(n, np.uint32), 0
    for k, size in enumerate(sizes):
        raw = np.frombuffer(expand(data[at : at + size]), np.uint8)
        at += size
        if mode == "byte":
            ids |= raw.astype(np.uint32) << np.uint32(8 * k)
        else:
            ids |= np.unpackbits(raw, count=n, bitorder="little").astype(np.uint32) << np.uint32(k)
    return ids


def encode_blocks(documents: DataFrame, tokenizer_path: str, end_id: int = 2, block_ids: int = BLOCK_IDS, mode: str = "bit") -> DataFrame:
    """Block rows (schema ``BLOCKS``) of all documents, in ascending doc_id order over parts and within them."""
    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(parts, "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie", "text")
        .select("doc_id", "text")
    )
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        part, enc = TaskContext.get().partitionId(), encoder(tokenizer_path)
        seq = start = done = 0
        held = bytearray()
        lengths: list[int] = []  # ids of each document that are in `held`
        names: list[int | None] = []
        cut = False  # the first document in `held` has ids in an earlier block

        def block(n: int, last: bool):
            nonlocal seq, start, done, cut
            ids = np.frombuffer(bytes(held[: 4 * n]), dtype="<u4")
            del held[: 4 * n]
            in_block, left = [], n
            while left:
                in_block.append(min(left, lengths[len(in_block)]))
                left -= in_block[-1]
            k = len(in_block)
            whole = in_block[-1] == lengths[k - 1]
            sizes, data = shuffle_planes(ids, mode)
            row = (part, seq, start, n, mode, sizes, data, done, names[:k], in_block, cut, whole)
            gone = k if whole else k - 1
            if not whole:
                lengths[k - 1] -= in_block[-1]
            del names[:gone], lengths[:gone]
            seq, start, done, cut = seq + 1, start + n, done + gone, not whole
            return row

        for batch in batches:
            texts, keys = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for at in range(0, len(texts), 200):
                rows = []
                for key, raw in zip(keys[at : at + 200], enc.encode(texts[at : at + 200])):
                    held += raw + end
                    names.append(key)
                    lengths.append(len(raw) // 4 + 1)
                    while len(held) >= 4 * block_ids:
                        rows.append(block(block_ids, False))
                if rows:
                    yield as_batch(rows, BLOCKS)
        if held:
            yield as_batch([block(len(held) // 4, True)], BLOCKS)

    return ordered.mapInArrow(run, BLOCKS)


def write_token_files(documents: DataFrame, path: str, tokenizer_path: str, **options) -> None:
    # Planes are compressed already, so Parquet leaves them as they are.
    encode_blocks(documents, tokenizer_path, **options).write.option("compression", "uncompressed").parquet(path)


def chunk_index(spark: SparkSession, path: str) -> DataFrame:
    """A row for each block without its planes: part, seq, start (over all parts), n_ids."""
    from pyspark.sql import Window as W

    blocks = spark.read.schema(BLOCKS).parquet(path)
    # One row for each part: as many as the shuffle has partitions, whatever the data's size.
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    earlier = F.sum("ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    before = sizes.select("part", F.coalesce(earlier, F.lit(0)).alias("before"))
    index = blocks.select("part", "seq", "start", "n_ids", "plane_bytes", "doc_ids").join(F.broadcast(before), "part")
    return index.withColumn("start", F.col("start") + F.col("before")).drop("before")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Every block's ids: part, seq, ids array<int>."""

    def run(batches):
        for pdf in batches:
            ids = [restore_ids(n, m, s, d).astype(np.int32) for n, m, s, d in zip(pdf["n_ids"], pdf["mode"], pdf["plane_bytes"], pdf["planes"])]
            yield pd.DataFrame({"part": pdf["part"], "seq": pdf["seq"], "ids": ids})

    return spark.read.schema(BLOCKS).parquet(path).select("part", "seq", "n_ids", "mode", "plane_bytes", "planes").mapInPandas(run, "part int, seq int, ids array<int>")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """From the files alone, for each document: doc_id, start, n_tokens, ids_crc32."""
    from pyspark.sql import Window as W

    blocks = spark.read.schema(BLOCKS).parquet(path)
    schema = "part int, doc_no long, seq int, doc_id long, start long, n_tokens long, ids_crc32 long, piece binary"

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                raw = restore_ids(r["n_ids"], r["mode"], r["plane_bytes"], r["planes"]).astype("<u4").tobytes()
                at, rows, last = 0, [], len(r["doc_ids"]) - 1
                for j, (key, n) in enumerate(zip(r["doc_ids"], r["doc_ids_in_block"])):
                    body = raw[4 * at : 4 * (at + n)]
                    part_only = (j == 0 and r["continues"]) or (j == last and not r["ends"])
                    crc, piece = (None, body) if part_only else (zlib.crc32(body), None)
                    rows.append((r["part"], r["first_doc"] + j, r["seq"], key, r["start"] + at, n, crc, piece))
                    at += n
                yield as_batch(rows, schema)

    @F.pandas_udf("long")
    def joined_crc(pieces: pd.Series) -> pd.Series:
        return pd.Series([zlib.crc32(b"".join(x["piece"] for x in sorted(ps, key=lambda x: x["seq"]))) for ps in pieces])

    found = durable(blocks.mapInArrow(run, schema), "pieces")  # blocks are opened once
    whole = found.where("piece is null").select("part", "doc_id", "start", "n_tokens", "ids_crc32")
    # A document that lies across blocks: its pieces meet, and are no longer than its own text.
    cut = (
        found.where("piece is not null")
        .groupBy("part", "doc_no")
        .agg(
            F.min("doc_id").alias("doc_id"),
            F.min("start").alias("start"),
            F.sum("n_tokens").alias("n_tokens"),
            F.collect_list(F.struct("seq", "piece")).alias("pieces"),
        )
        .select("part", "doc_id", "start", "n_tokens", joined_crc("pieces").alias("ids_crc32"))
    )
    # One row for each part: as many as the shuffle has partitions, whatever the data's size.
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    earlier = F.sum("ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    before = sizes.select("part", F.coalesce(earlier, F.lit(0)).alias("before"))
    rows = whole.unionByName(cut).join(F.broadcast(before), "part")
    return rows.select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_files(documents: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Write all documents to token files in the shared folder and return what they hold, read back."""
    import public_tokenizers

    spark = documents.sparkSession
    path = f"{work_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(documents, path, tokenizer_path or public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(spark, path)


def op3_bitplane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"))
