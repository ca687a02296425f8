"""N-gram Jaccard self-join with set-relation skipping.

Every document becomes a set of hashed word shingles (64 bits). Identical sets collapse into classes, so copies never
meet as pairs. Two kinds of skipping keep the rest exact without comparing all pairs:

* Lists by position. The first end of each set, in one global order, is indexed with its position. A list's entries are
  held in blocks of one size band; a block is met only by size bands that can still reach the threshold from its best
  position. Shingles that many documents share go last in the order, so they seldom reach an index.
* Answers from a similar set. Sets with an equal minimum hash are compared with the first of them; one that is similar
  enough hangs on that hub at a known distance. Hubs are compared with hubs, and by the triangle inequality of the
  Jaccard distance a hub's answer settles its members' answers, but for pairs that it leaves open, which are compared one
  by one.

What comes out is the smallest doc_id that each document reaches by links. Null texts and texts without words are empty
and linked with nothing; null doc_ids keep their rows and take no part. A document is a doc_id with a set: rows that
repeat both are one document and come out alike, and texts that share a doc_id but not their set are documents of their
own. Ties between hubs go to the smaller doc_id. Texts of any length are taken whole. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SpanHash, as_batch, durable, mix64, release, small_batches, spans_within, table, text_slices, whole_text
from .components import smallest_reachable

#: Minimum hashes by which hubs are found.
HUB_KEYS = 6
#: A shingle in COMMON_FROM documents goes last in the order; where more than MOST_COMMON shingles could be in so many, the
#: number grows with the corpus instead. One in a single document is no one's link. Both kinds are known by bitmaps of
#: fixed size over COMMON_BITS leading hash bits, from counts over the whole corpus; a bit that is set for another's sake
#: only adds or moves work, since results are exact under any order.
COMMON_FROM, MOST_COMMON, COMMON_BITS = 12, 8_000_000, 27
#: Shingles that a task counts before it passes the counts on.
COUNTED_AT_ONCE = 500_000
#: Bits for each wanted document of the sieve that a scan uses before the exact join, and most bits of it.
SIEVE_SHARE, SIEVE_BITS = 16, 1 << 27
#: A table of at most so many rows may be broadcast (16 bytes a row), and pairs with the keys of their sets (150 bytes).
BROADCAST_ROWS, BROADCAST_PAIRS = 500_000, 200_000
#: Sets are first compared on the shingles in the first HEAD / 16 of the hash range; the sizes of the rest bound what
#: that can add.
HEAD = 6
#: Partners that a hub is compared with first, those that it meets on most lists.
LIKELIEST = 6
#: Pairs of one set that meet it in one group; sets with more are dealt over several.
PAIRS_TOGETHER = 64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def shingle_sets(texts, words: int):
    """Yield (position, sorted distinct 64-bit shingle hashes) of each text of an Arrow column."""
    factors = mix64(np.arange(101, 101 + words, dtype=np.uint64)) | np.uint64(1)
    for first, last, raw, bounds in text_slices(texts):
        buffer = _LOWER[raw]
        start, end = spans_within(~_SPACE[buffer], bounds)
        word = SpanHash(buffer).of(start, end)
        edge = np.searchsorted(start, bounds)
        rolled = np.zeros(max(len(word) - words + 1, 0), np.uint64)
        for i in range(words):
            rolled += word[i : i + len(rolled)] * factors[i]
        rolled = mix64(rolled)
        for i in range(last - first):
            a, b = edge[i], edge[i + 1]
            if b - a >= words:
                yield first + i, np.unique(rolled[a : b - words + 1])
            elif b > a:
                yield first + i, mix64((word[a:b] * factors[: b - a]).sum(keepdims=True) + np.uint64(b - a))
            else:
                yield first + i, np.zeros(0, np.uint64)


def signature_of(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def prefix_length(n, num: int, den: int):
    return n - -(-num * n // den) + 1


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _bitmap(hashes: DataFrame, bits: int, column: str) -> np.ndarray:
    """Bits of the ``column`` (slots from 0) that occur, as 64-bit cells; at most bits / 64 rows reach the driver."""
    cells = hashes.selectExpr(f"{column} div 64 AS cell", f"shiftleft(1L, cast({column} % 64 AS int)) AS bit").groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy()
    return out


def _sieve_bits(rows: int) -> int:
    bits = 1 << 16
    while bits < min(SIEVE_BITS, SIEVE_SHARE * rows):
        bits *= 2
    return bits


def _has(cells: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (cells[slot >> 6] >> (slot & 63)) & 1 == 1


class JaccardJoin:
    """A join at ``num/den`` similarity on sets of ``words``-word shingles of one table of documents."""

    def __init__(self, documents: DataFrame, words: int, num: int, den: int):
        self.spark = documents.sparkSession
        self.documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
        self.words, self.num, self.den = words, num, den
        small_batches(self.spark)

    def _summaries(self) -> DataFrame:
        """One pass: a row for each document with its size, signature and minimum hashes, and rows (n = -1) with counts of
        shingles by ranges of their hash."""
        words = self.words
        salts = mix64(np.arange(1, HUB_KEYS + 1, dtype=np.uint64))
        self.depth = depth = max(8, (4 * int(self.spark.conf.get("spark.sql.shuffle.partitions"))).bit_length())
        ranges = 1 << depth
        schema = "doc_id long, text_key long, n long, signature binary, keys array<long>, range int, steps binary, counts binary"

        def counts(met):
            # 36 leading bits do for an order; ascending values are kept as differences, by byte, to pack well.
            value, n = np.unique(np.concatenate(met) >> np.uint64(28), return_counts=True)
            edge = np.searchsorted(value, np.arange(ranges + 1, dtype=np.uint64) << np.uint64(36 - depth))
            rows = []
            for k in np.flatnonzero(np.diff(edge)).tolist():
                v, c = value[edge[k] : edge[k + 1]], n[edge[k] : edge[k + 1]]
                step = np.diff(v, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                rows.append((None, None, -1, None, None, k, step.T.tobytes(), np.minimum(c, 255).astype(np.uint8).tobytes()))
            return as_batch(rows, schema)

        def run(batches):
            met, size = [], 0
            for batch in batches:
                rows, ids, keys = [], batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist()
                for i, s in shingle_sets(batch.column("text"), words):
                    least = [int(mix64(s ^ salt).min().view(np.int64)) for salt in salts] if len(s) else []
                    rows.append((ids[i], keys[i], len(s), signature_of(s), least, None, None, None))
                    met.append(s)
                    size += len(s)
                    if size > COUNTED_AT_ONCE:
                        yield counts(met)
                        met, size = [], 0
                yield as_batch(rows, schema)
            if met:
                yield counts(met)

        return durable(self.documents.withColumn("text_key", F.xxhash64("text")).mapInArrow(run, schema), "summaries")

    def _common(self, seen: DataFrame):
        """Bitmaps of counted shingles that go last in the order, and that are in two documents or more; each range of
        hashes is summed on its own."""
        depth = self.depth
        size, low = (1 << (COMMON_BITS - depth)) // 8, np.uint64(36 - COMMON_BITS)
        total = seen.where("n > 0").agg(F.sum("n")).first()[0] or 0
        least = max(COMMON_FROM, -(-total // MOST_COMMON))

        def mark(pdf: pd.DataFrame) -> pd.DataFrame:
            values = []
            for x in pdf["steps"]:
                step = np.zeros((len(x) // 5, 8), np.uint8)
                step[:, :5] = np.frombuffer(x, np.uint8).reshape(5, -1).T
                values.append(np.cumsum(step.view("<u8").ravel(), dtype=np.uint64))
            value, back = np.unique(np.concatenate(values), return_inverse=True)
            met = np.bincount(back, np.concatenate([np.frombuffer(x, np.uint8) for x in pdf["counts"]]))
            k = int(pdf["range"].iloc[0])
            at = (value >> low).astype(np.int64) - k * size * 8

            def packed(chosen):
                bits = np.zeros(size * 8, np.uint8)
                bits[at[chosen]] = 1
                return zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)

            return pd.DataFrame({"range": [k], "common": [packed(met >= least)], "shared": [packed(met > 1)]})

        counted = seen.where("n < 0").select("range", "steps", "counts")
        common, shared = (np.zeros((1 << COMMON_BITS) // 8, np.uint8) for _ in range(2))
        # As many rows as ranges, and bitmaps of fixed size in all: 32 MB at most, packed.
        for k, a, b in counted.groupBy("range").applyInPandas(mark, "range int, common binary, shared binary").collect():
            common[k * size : (k + 1) * size] = np.frombuffer(zlib.decompress(a), np.uint8)
            shared[k * size : (k + 1) * size] = np.frombuffer(zlib.decompress(b), np.uint8)
        return self.spark.sparkContext.broadcast((common, shared))

    def _sieve(self, slots: DataFrame, bits: int):
        """Broadcast bits of the ``slot``s."""
        return self.spark.sparkContext.broadcast(_bitmap(slots, bits, "slot"))

    def _sets_of(self, wanted: DataFrame, label: str) -> DataFrame:
        """(rep, signature, n, head, tail) of the sets of ``wanted`` (rep), one row for each, and of a few others that the
        sieve lets pass. ``head``: the members with the smallest hashes. The sets stay where the scan made them; only of
        keys that rows repeat are they dealt by key."""
        bits = _sieve_bits(wanted.count())
        slot = lambda column: F.pmod(F.xxhash64(column), F.lit(bits)).alias("slot")
        sieve, words = self._sieve(wanted.select(slot("rep")), bits), self.words
        schema, top = "rep long, signature binary, n long, head binary, tail binary", np.uint64(HEAD << 60)

        def run(batches):
            cells = sieve.value
            for batch in batches:
                kept = batch.filter(_has(cells, batch.column("slot").to_numpy()))
                rows, ids = [], kept.column("doc_id").to_pylist()
                for i, s in shingle_sets(kept.column("text"), words):
                    cut = np.searchsorted(s, top)
                    rows.append((ids[i], signature_of(s), len(s), s[:cut].tobytes(), s[cut:].tobytes()))
                    if len(rows) == 500:
                        yield as_batch(rows, schema)
                        rows = []
                yield as_batch(rows, schema)

        scanned = self.documents.where("doc_id is not null").withColumn("slot", slot("doc_id"))
        found = durable(scanned.mapInArrow(run, schema).where("n > 0"), f"{label}-sets")
        sieve.destroy()
        if not self.repeats:
            return found
        key = ["rep", "signature"]
        repeated = durable(found.groupBy(*key).count().where("count > 1").select(*key), f"{label}-repeated")
        once = found.join(repeated, key, "left_semi").dropDuplicates(key)
        sets = durable(found.join(repeated, key, "left_anti").unionByName(once), f"{label}-sets")
        release(found)
        return sets

    def _hot(self, pairs: DataFrame, rows: int, label: str) -> DataFrame:
        """(side, node, rep, signature, parts): sets that very many of the ``rows`` pairs want, fewer than
        2 x BROADCAST_ROWS, and over how many copies to deal them."""
        together = max(PAIRS_TOGETHER, -(-rows // BROADCAST_ROWS))
        end = lambda side: F.struct(F.lit(side).alias("side"), F.col(side).alias("node"), F.col(f"rep_{side}").alias("rep"), F.col(f"signature_{side}").alias("signature"))
        counted = pairs.select(F.explode(F.array(end("a"), end("b"))).alias("end")).groupBy("end").agg(F.ceil(F.count("*") / together).alias("parts"))
        return durable(counted.where("parts > 1").select("end.*", "parts"), f"{label}-hot")

    def _counted(self, pairs: DataFrame, sets: DataFrame, members: str, hot: dict[str, DataFrame], few: bool) -> DataFrame:
        """``pairs`` (a, b, floor, common, and rep and signature of both) with the common ``members`` of both sets added to
        ``common``, and met_a, met_b (members), size_a, size_b. ``hot``: by side, sets that are copied and their pairs dealt
        over the copies. Where pairs are ``few``, only the sets of one side move, to those of the other."""
        schema = "a long, b long, floor double, common long, rep_a long, signature_a binary, rep_b long, signature_b binary, met_a long, met_b long, size_a long, size_b long"
        same = ["rep_a", "signature_a", "rep_b", "signature_b"]
        met = pairs
        for side in ("a", "b"):
            own, part, alone = [f"rep_{side}", f"signature_{side}"], f"part_{side}", few and side == "a"
            held = sets.select(F.col("rep").alias(own[0]), F.col("signature").alias(own[1]), F.col("n").alias(f"size_{side}"), F.col(members).alias(f"set_{side}"))
            if few and not alone:
                held = held.join(F.broadcast(pairs.select(*own).distinct()), own, "left_semi")
            if side in hot and not alone:
                parts = hot[side].select(F.col("node").alias(side), F.col("rep").alias(own[0]), F.col("signature").alias(own[1]), "parts")
                last = F.coalesce("parts", F.lit(1)).cast("long") - 1
                met = met.join(F.broadcast(parts.select(side, "parts")), side, "left").withColumn(part, F.pmod(F.xxhash64("a", "b"), last + 1)).drop("parts")
                held = held.join(F.broadcast(parts.drop(side)), own, "left").withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), last))).drop("parts")
                own = [*own, part]
            met = (F.broadcast(met) if alone else met).join(held, own)

        def run(batches):
            for batch in batches:
                rows = []
                keys = zip(*[batch.column(c).to_pylist() for c in same])
                for a, b, floor, known, n, m, x, y in zip(*[batch.column(c) for c in ("a", "b", "floor", "common", "size_a", "size_b", "set_a", "set_b")]):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    at = np.searchsorted(y, x)
                    at[at == len(y)] = 0
                    common = int((y[at] == x).sum()) if len(x) and len(y) else 0
                    rows.append((a.as_py(), b.as_py(), floor.as_py(), known.as_py() + common, *next(keys), len(x), len(y), n.as_py(), m.as_py()))
                yield as_batch(rows, schema)

        return met.select("a", "b", "floor", "common", *same, "size_a", "size_b", "set_a", "set_b").mapInArrow(run, schema)

    def _compared(self, pairs: DataFrame, label: str) -> DataFrame:
        """(a, b, common, size_a, size_b) of the stored pairs (a, b, floor) whose similarity is ``floor`` or more, and
        perhaps of some others, counted on whole sets. The heads of the sets rule out most of the rest first. The keys of
        the sets are joined once, and hot sets sought once, for both counts: the driver keeps what each plan costs it."""
        rows = pairs.count()
        if not rows:
            # Without rows; a frame made of a local list would start Python workers of another kind on the executors, and
            # divisions of literals would be worked out beforehand.
            return pairs.select("a", "b", *[F.col("a").alias(c) for c in ("common", "size_a", "size_b")])
        of = lambda side: self.classes.select(F.col("node").alias(side), F.col("rep").alias(f"rep_{side}"), F.col("signature").alias(f"signature_{side}"))
        keyed = pairs.select("a", "b", "floor", F.lit(0).cast("long").alias("common")).join(of("a"), "a").join(of("b"), "b")
        columns = ["a", "b", "floor", "common", "rep_a", "signature_a", "rep_b", "signature_b"]
        keyed = durable(keyed.select(*columns), f"{label}-keyed")
        sets = self._sets_of(keyed.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).distinct(), label)
        dealt = self._hot(keyed, rows, label)
        hot = {r.side: dealt.where(F.col("side") == r.side) for r in dealt.select("side").distinct().collect()}
        few = rows <= BROADCAST_PAIRS
        most = F.col("common") + F.least(F.col("size_a") - F.col("met_a"), F.col("size_b") - F.col("met_b"))
        could = most >= (F.col("floor") - 1e-9) * (F.col("size_a") + F.col("size_b") - most)
        likely = durable(self._counted(keyed, sets, "head", hot, few).where(could).select(*columns), f"{label}-likely")
        few = few or likely.count() <= BROADCAST_PAIRS
        compared = durable(self._counted(likely, sets, "tail", hot, few).select("a", "b", "common", "size_a", "size_b"), f"{label}-compared")
        release(keyed, sets, dealt, likely)
        return compared

    def _linked(self):
        return F.col("common") * self.den >= self.num * (F.col("size_a") + F.col("size_b") - F.col("common"))

    def _prefixes(self, bitmaps) -> DataFrame:
        """(rep, signature, places, prefix): the shingles of each set that can hold its first common one with a partner,
        and their positions, without shingles known to be in one document only."""
        words, num, den = self.words, self.num, self.den
        schema = "rep long, signature binary, places array<int>, prefix array<long>"

        def run(batches):
            common, shared = bitmaps.value
            for batch in batches:
                rows, ids = [], batch.column("doc_id").to_pylist()
                for i, s in shingle_sets(batch.column("text"), words):
                    if len(s):
                        at = (s >> np.uint64(64 - COMMON_BITS)).astype(np.int64)
                        byte, bit = at >> 3, (at & 7).astype(np.uint8)
                        late = (common[byte] >> bit) & 1 == 1
                        several = (shared[byte] >> bit) & 1 == 1
                        order = np.concatenate([np.flatnonzero(~late), np.flatnonzero(late)])[: prefix_length(len(s), num, den)]
                        met = np.flatnonzero(several[order])
                        rows.append((ids[i], signature_of(s), met.astype(np.int32), _signed(s[order[met]])))
                yield as_batch(rows, schema)

        return self.documents.where("doc_id is not null").mapInArrow(run, schema)

    def _band(self, size):
        return F.floor(F.log(size.cast("double")) / F.lit(float(np.log(1.05)))).cast("int")

    def _could_meet(self, n1, p1, n2, p2):
        return F.least(n1 - p1, n2 - p2) * (self.num + self.den) >= self.num * (n1 + n2)

    def _hubs(self) -> tuple[DataFrame, DataFrame]:
        """(node, n, hub, away) of each set, and the compared pairs that hang on hubs."""
        num, den = self.num, self.den
        # Each set against the one that shares most minimum hashes with it, half of them at least; whatever this passes
        # over is found by the index.
        keyed = self.classes.select("node", "rep", "n", F.posexplode("keys").alias("which", "key"))
        heads = keyed.groupBy("which", "key").agg(F.min(F.struct("rep", "node", "n")).alias("head"), F.count("*").alias("rows")).where("rows > 1")
        near = keyed.join(heads, ["which", "key"]).where(F.col("node") != F.col("head.node"))
        near = near.where(F.least("n", "head.n") * den >= F.greatest("n", "head.n") * num)
        near = near.groupBy("node", "head.node", "head.rep").agg(F.count("*").alias("equal")).toDF("a", "b", "rep_b", "equal")
        stars = near.where(F.col("equal") * 2 >= HUB_KEYS).groupBy("a").agg(F.max_by("b", F.struct("equal", -F.col("rep_b"), -F.col("b"))).alias("b"))
        stars = durable(stars.withColumn("floor", F.lit(num / den)), "stars")
        starred = self._compared(stars, "hub").where(self._linked())
        nearest = starred.select(F.col("a").alias("node"), F.col("b").alias("hub"), self._distance().alias("away"))
        hubs = self.classes.join(nearest, "node", "left")
        hubs = hubs.select("node", "rep", "signature", "n", F.coalesce("hub", "node").alias("hub"), F.coalesce("away", F.lit(0.0)).alias("away"))
        return durable(hubs, "hubs"), starred

    def _distance(self):
        return 1 - F.col("common") / (F.col("size_a") + F.col("size_b") - F.col("common"))

    def _lists(self, hubs: DataFrame, bitmaps) -> DataFrame:
        """(node, n, hub, away, pos, shingle): the positional index, common shingles last, of lists with two hubs at least
        and a few others."""
        prefixes = self._prefixes(bitmaps).join(hubs, ["rep", "signature"]).dropDuplicates(["node"])
        prefixes = durable(prefixes.select("node", "n", "hub", "away", "places", "prefix"), "prefixes")
        entries = prefixes.select("node", "n", "hub", "away", F.explode(F.arrays_zip("places", "prefix")).alias("e"))
        entries = entries.select("node", "n", "hub", "away", F.col("e.places").alias("pos"), F.col("e.prefix").alias("shingle"))
        # A list within one hub says nothing new; a sieve of the others drops it. The few that it lets pass do no harm.
        met = entries.groupBy("shingle").agg(F.min("hub").alias("low"), F.max("hub").alias("high")).where("low < high").select("shingle")
        met = durable(met, "shared")
        bits = _sieve_bits(met.count())
        sieve = self._sieve(met.select(F.col("shingle").bitwiseAND(F.lit(bits - 1)).alias("slot")), bits)

        def run(batches):
            cells = sieve.value
            for batch in batches:
                pos, prefix = batch.column("places"), batch.column("prefix")
                shingle, length = prefix.flatten(), np.diff(prefix.offsets.to_numpy())
                kept = np.flatnonzero(_has(cells, shingle.to_numpy() & (bits - 1)))
                row = pa.array(np.repeat(np.arange(len(length)), length)[kept])
                columns = [batch.column(c).take(row) for c in ("node", "n", "hub", "away")]
                yield pa.RecordBatch.from_arrays([*columns, pos.flatten().take(pa.array(kept)), shingle.take(pa.array(kept))], names=["node", "n", "hub", "away", "pos", "shingle"])

        lists = durable(prefixes.mapInArrow(run, "node long, n long, hub long, away double, pos int, shingle long"), "lists")
        sieve.destroy()
        release(prefixes, met)
        return lists

    def _meetings(self, lists: DataFrame) -> DataFrame:
        """(shingle, a, b): hubs whose blocks on a list can reach the threshold."""
        num, den = self.num, self.den
        blocks = lists.withColumn("band", self._band(F.col("n"))).groupBy("shingle", "hub", "band")
        blocks = blocks.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("pos")).alias("left"))
        blocks = durable(blocks, "blocks")
        # The larger set looks for partners from num/den of its size up to what its best position allows.
        reach = F.least(F.col("most"), F.floor(F.col("left") * (num + den) / num).cast("long") - F.col("least"))
        seek = blocks.withColumn("lo", F.ceil(F.col("least") * num / den).cast("long")).withColumn("hi", reach).where("hi >= lo")
        bands = F.explode(F.sequence(self._band(F.col("lo")), self._band(F.col("hi"))))
        seek = seek.select("shingle", F.col("hub").alias("a"), F.col("least").alias("least_a"), F.col("left").alias("left_a"), bands.alias("band"))
        hit = blocks.select("shingle", "band", F.col("hub").alias("b"), F.col("least").alias("least_b"), F.col("left").alias("left_b"))
        fits = F.least("left_a", "left_b") * (num + den) >= num * (F.col("least_a") + F.col("least_b"))
        met = seek.join(hit, ["shingle", "band"]).where((F.col("a") != F.col("b")) & fits)
        met = durable(met.select("shingle", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "met")
        release(blocks)
        return met

    def _between(self, hubs: DataFrame, met: DataFrame, starred: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs of hubs on common lists, compared, and what reaches what by the links found. A hub is first
        compared with those that it meets on most lists; pairs that the links found so far join already are left out,
        since neither they nor pairs of their members can tell anything new."""
        radius = hubs.groupBy("hub").agg(F.max("away").alias("radius")).where("radius > 0")
        of = lambda side: radius.select(F.col("hub").alias(side), F.col("radius").alias(f"radius_{side}"))
        pairs = met.groupBy("a", "b").agg(F.count("*").alias("lists")).join(of("a"), "a", "left").join(of("b"), "b", "left")
        # Farther apart than by their radii and the threshold, hubs and their members have no link.
        floor = F.lit(self.num / self.den) - F.coalesce("radius_a", F.lit(0.0)) - F.coalesce("radius_b", F.lit(0.0))
        pairs = durable(pairs.select("a", "b", floor.alias("floor"), "lists"), "candidates")
        ends = pairs.select(F.col("a").alias("node"), "*").unionByName(pairs.select(F.col("b").alias("node"), "*"))
        rank = F.row_number().over(W.partitionBy("node").orderBy(F.desc("lists"), "a", "b"))
        best = durable(ends.withColumn("rank", rank).where(F.col("rank") <= LIKELIEST).select("a", "b", "floor").distinct(), "likeliest")
        first = self._compared(best, "likeliest")
        reached = durable(smallest_reachable(starred.select("a", "b").unionByName(first.where(self._linked()).select("a", "b"))), "reached")
        rest = self._apart(pairs.join(best, ["a", "b"], "left_anti").select("a", "b", "floor"), reached)
        more = self._compared(durable(rest, "rest"), "between")
        return first.unionByName(more), self._extended(reached, more.where(self._linked()))

    def _extended(self, reached: DataFrame, links: DataFrame) -> DataFrame:
        """``reached`` (node, component) with ``links`` (a, b) added: what they join are components, few beside the nodes."""
        of = lambda side: reached.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
        ends = links.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
        ends = durable(ends.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).where("a <> b").distinct(), "joined")
        if ends.isEmpty():
            return reached
        grown = durable(smallest_reachable(ends).select(F.col("node").alias("part"), F.col("component").alias("whole")), "grown")
        known = reached.join(grown, reached["component"] == grown["part"], "left").select("node", F.coalesce("whole", "component").alias("component"))
        new = grown.join(reached, grown["part"] == reached["node"], "left_anti").select(F.col("part").alias("node"), F.col("whole").alias("component"))
        return durable(known.unionByName(new), "reached")

    def _apart(self, pairs: DataFrame, reached: DataFrame) -> DataFrame:
        """Pairs whose ends are not known to reach one another."""
        of = lambda side: reached.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
        joined = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
        return joined.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).drop("of_a", "of_b")

    def _open(self, hubs: DataFrame, lists: DataFrame, met: DataFrame, between: DataFrame, reached: DataFrame) -> DataFrame:
        """Pairs (a, b) of members whose hubs leave them open: d(x, y) >= d(hubs) - d(x, hub) - d(y, hub)."""
        num, den = self.num, self.den
        limit = 1 - num / den + 1e-9
        radius = hubs.groupBy("hub").agg(F.max("away").alias("radius"))
        of = lambda side: radius.select(F.col("hub").alias(side), F.col("radius").alias(f"radius_{side}"))
        unsettled = self._apart(between.where(~self._linked()).select("a", "b", self._distance().alias("gap")), reached)
        # A hub without members has no radius, so its partner's members must come that much nearer themselves.
        far = F.col("gap") - F.col("radius_a") - F.col("radius_b") > limit
        unsettled = unsettled.join(of("a"), "a").join(of("b"), "b").where((F.greatest("radius_a", "radius_b") > 0) & ~far)
        side = lambda hub, x: lists.select(
            "shingle", F.col("hub").alias(hub), F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("pos").alias(f"p{x}"), F.col("away").alias(f"d{x}")
        )
        # Only lists that both hubs are on, and of each only the members near enough to the other hub.
        left = met.join(unsettled, ["a", "b"]).join(side("a", "x"), ["shingle", "a"]).where(F.col("gap") - F.col("dx") <= limit + F.col("radius_b"))
        near = F.col("gap") - F.col("dx") - F.col("dy") <= limit
        sized = F.least("nx", "ny") * den >= F.greatest("nx", "ny") * num
        could = self._could_meet(F.col("nx"), F.col("px"), F.col("ny"), F.col("py"))
        members = left.join(side("b", "y"), ["shingle", "b"]).where(near & sized & could)
        members = members.where((F.col("x") != F.col("a")) | (F.col("y") != F.col("b"))).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        return members.withColumn("floor", F.lit(num / den))

    def run(self) -> DataFrame:
        """A row for each document: doc_id, text_key (xxhash64 of the text), n_shingles, class_id (smallest doc_id with
        the same set), component_id, and first: whether it is the first document of its component."""
        seen = self._summaries()
        classes = seen.where("n > 0 and doc_id is not null").groupBy("signature")
        classes = classes.agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"))
        self.classes = durable(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
        self.repeats = not seen.where("n > 0 and doc_id is not null").groupBy("doc_id", "signature").count().where("count > 1").isEmpty()
        hubs, starred = self._hubs()
        bitmaps = self._common(seen)
        # The counts of shingles take more room than all else, and nothing after the bitmaps needs them.
        documents = durable(seen.where("n >= 0").select("doc_id", "text_key", "n", "signature"), "documents")
        release(seen)
        lists = self._lists(hubs, bitmaps)
        bitmaps.destroy()
        met = self._meetings(lists)
        between, reached = self._between(hubs, met, starred)
        members = durable(self._open(hubs, lists, met, between, reached), "members")
        reached = self._extended(reached, self._compared(members, "open").where(self._linked()))
        of_class = self.classes.join(reached, "node", "left").select("signature", "rep", F.coalesce("component", "node").alias("component"))
        of_class = durable(of_class, "components")
        # The first document of a component: the smallest doc_id, then the smallest signature.
        heads = of_class.groupBy("component").agg(F.min(F.struct("rep", "signature")).alias("head"))
        named = durable(of_class.join(heads, "component").select("signature", "rep", "head"), "named")
        release(self.classes, hubs, lists, met, members, of_class)
        rows = documents.withColumnRenamed("n", "n_shingles").join(named, "signature", "left")
        known = lambda column: F.when(F.col("doc_id").isNotNull(), F.coalesce(column, F.col("doc_id")))
        first = (F.col("doc_id") == F.col("head.rep")) & (F.col("signature") == F.col("head.signature"))
        return rows.select(
            "doc_id", "text_key", "n_shingles", known(F.col("rep")).alias("class_id"), known(F.col("head.rep")).alias("component_id"),
            (F.col("doc_id").isNull() | F.col("head").isNull() | first).alias("first"),
        )


def jaccard_components(documents: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    return JaccardJoin(documents, words, num, den).run()


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = jaccard_components(table(spark, sf_dir, "documents"), words=4, num=85, den=100)
    return joined.select("doc_id", "n_shingles", "component_id", "class_id")
