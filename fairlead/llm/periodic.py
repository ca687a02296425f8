"""Periodic runs of words, found by seeds on diagonals.

A run of period q and length l repeats each of its words q places on, over l - q places in a row: a stretch on the
diagonal of lag q. Runs have at least LEAST_TURNS periods and LEAST_WORDS words, so that stretch has a guaranteed length,
which grows with the lag. Lags are taken by octaves [2^s, 2^(s+1)), and each octave indexes the k-grams of the length that
every run of its lags guarantees (3 * 2^s, and 5 for lag 1). A k-gram is longer than the lags of its octave, so within a
run its next occurrence lies exactly one period on (two occurrences nearer than that would give the run a smaller period),
and it is enough to look at neighbouring occurrences of the same document: they are as many as there are words, however
often a gram occurs. A pair of them whose distance lies in the octave is a seed. Seeds are extended to both sides by
comparing words; a table of each lag's furthest covered place leaves out seeds within a stretch that is known.

Grams are numbered exactly, by doubling: the numbers of two halves, paired and numbered again. Only places whose gram
occurs twice in its document go on to longer grams, so plain text costs little more than its words. Texts are worked on
in slices; no text is cut, and one of n words takes about n log n steps, whatever it repeats.

A null text has no words and no runs, like an empty one. Repeated rows come out alike, a null doc_id stays null, no
documents give no rows, and columns that are not named play no part. The collapsed text of a document without runs is
its words joined by one space.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, table, whole_text, with_columns

LEAST_WORDS, LEAST_TURNS = 6, 4
#: Words compared at first when a seed is extended; the reach doubles as long as they agree.
REACH = 16


def _numbered(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1]


def _recurring(ids: np.ndarray) -> np.ndarray:
    """Whether each id occurs more than once."""
    return np.bincount(ids)[ids] > 1 if len(ids) else np.zeros(0, bool)


class Grams:
    """Numbers of the grams of each length at the places where they may recur. ``words``: numbers that differ between
    documents, so that grams of two documents, or across them, never agree."""

    def __init__(self, words: np.ndarray):
        self.size = len(words)
        first = _numbered(words)
        at = np.flatnonzero(_recurring(first))
        self.levels = [(at, first[at])]  # grams of 1, 2, 4, ... words

    def _pair(self, left, right, shift: int) -> tuple[np.ndarray, np.ndarray]:
        """Grams made of a left one and the right one ``shift`` places on."""
        at, ids = left
        to = np.full(self.size + 1, -1)
        to[right[0]] = right[1]
        follow = to[np.minimum(at + shift, self.size)]
        at, ids, follow = at[follow >= 0], ids[follow >= 0], follow[follow >= 0]
        made = _numbered(ids * (self.size + 1) + follow)
        again = _recurring(made)
        return at[again], made[again]

    def _doubled(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.levels) <= level:
            self.levels.append(self._pair(self.levels[-1], self.levels[-1], 1 << len(self.levels) - 1))
        return self.levels[level]

    def of_octave(self, s: int) -> tuple[int, np.ndarray, np.ndarray]:
        """Length, places and numbers of the grams that lags from 2^s on guarantee."""
        if s == 0:
            return 5, *self._pair(self._doubled(2), self._doubled(0), 4)
        return 3 << s, *self._pair(self._doubled(s + 1), self._doubled(s), 2 << s)


def _reach(words: np.ndarray, a: int, b: int, room: int, step: int) -> int:
    """How many words from ``a`` and ``b`` on agree, at most ``room``; ``step`` -1 looks backwards from before them."""
    done, size = 0, REACH
    while done < room:
        n = min(size, room - done)
        if step > 0:
            differ = words[a + done : a + done + n] != words[b + done : b + done + n]
        else:
            differ = (words[a - done - n : a - done] != words[b - done - n : b - done])[::-1]
        if differ.any():
            return done + int(differ.argmax())
        done, size = done + n, size * 2
    return done


def find_runs(words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in ``words``, by place and period. Documents end at ``bounds`` (from 0 on), and
    words of different documents have different numbers."""
    found, grams = [], Grams(words)
    longest = int(np.diff(bounds).max()) if len(bounds) > 1 else 0
    s = 0
    while max(LEAST_WORDS, LEAST_TURNS << s) <= longest:
        _, at, ids = grams.of_octave(s)
        if not len(at):
            break  # no longer gram recurs
        order = np.argsort(ids, kind="stable")
        at, ids = at[order], ids[order]
        lag = np.diff(at)
        seed = np.flatnonzero((np.diff(ids) == 0) & (lag >= 1 << s) & (lag < 2 << s))
        start, lag = at[seed], lag[seed]
        order = np.lexsort((start, lag))
        start, lag = start[order], lag[order]
        # of seeds one place apart on one lag the first is enough: they lie in one stretch
        fresh = np.ones(len(start), bool)
        fresh[1:] = (np.diff(lag) != 0) | (np.diff(start) != 1)
        covered: dict[int, int] = {}
        for i, q in zip(start[fresh].tolist(), lag[fresh].tolist()):
            if i < covered.get(q, 0):
                continue
            document = int(np.searchsorted(bounds, i, "right"))
            first, past = int(bounds[document - 1]), int(bounds[document])
            a = i - _reach(words, i, i + q, i - first, -1)
            b = i + _reach(words, i, i + q, past - i - q, 1)  # words of [a, b) agree with those q on
            covered[q] = b
            if b - a + q >= max(LEAST_WORDS, LEAST_TURNS * q):
                found.append((a, b - a + q, q))
        s += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(n: int, doc_id: int | None) -> np.ndarray | None:
    """Which word each place holds once repeats are planted by the doc_id's checksum; None where nothing changes."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    place, p = np.arange(n), 1 + (n - a) // (3 + g % 8)
    place[a:] = a + (place[a:] - a) % p
    return place


def _slice_runs(texts: list[bytes], doc_ids: list | None):
    """Of each text its words as they stand (after planting) and its runs, counted from its own first word."""
    seen: dict[bytes, int] = {}
    held, numbers, bounds = [], [], [0]
    for i, raw in enumerate(texts):
        own = raw.split()  # at ASCII white space
        order = planted(len(own), doc_ids[i]) if doc_ids else None
        ids = np.fromiter((seen.setdefault(w, len(seen)) for w in own), np.int64, len(own))
        if order is not None:
            own, ids = [own[j] for j in order.tolist()], ids[order]
        held.append(own)
        numbers.append(ids)
        bounds.append(bounds[-1] + len(own))
    words = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
    documents = np.repeat(np.arange(len(texts)), np.diff(bounds))
    edges = np.array(bounds)
    of: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, period in find_runs(words * max(len(texts), 1) + documents, edges):
        document = int(documents[start])
        of[document].append((start - bounds[document], length, period))
    return zip(held, of)


def _slices(texts: list[str]):
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > SLICE_BYTES:
            yield first, i
            first, size = i, 0
        size += len(t)
    if texts:
        yield first, len(texts)


RUNS = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def periodic_runs(documents: DataFrame, text: str = "text", keep: list[str] | None = None, plant: str | None = None) -> DataFrame:
    """The columns ``keep`` (all, if None), ``n_words``, ``runs`` by start and period, and ``collapsed``, the text with one
    period of each run. ``plant`` names the id column by which repeats are planted first (none, if None)."""
    planting = F.lit(None).cast("long") if plant is None else F.col(plant).cast("long")

    def work(texts, ids):
        counts, runs, collapsed = [], [], []
        for first, past in _slices(texts):
            for own, found in _slice_runs([t.encode() for t in texts[first:past]], ids[first:past] if plant else None):
                stays = np.ones(len(own), bool)
                for start, length, period in found:
                    stays[start + period : start + length] = False
                counts.append(len(own))
                runs.append([{"start": a, "length": n, "period": q} for a, n, q in found])
                kept = own if stays.all() else [own[i] for i in np.flatnonzero(stays).tolist()]
                collapsed.append(b" ".join(kept).decode())
        return counts, runs, collapsed

    return with_columns(documents, [whole_text(text), planting], RUNS, work, keep)


def strongest(runs):
    """Of an array of runs (by start and period) the one of the greatest exact length / period, the first on ties."""
    more = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.reduce(runs, none, lambda best, r: F.when(more(best, r), r).otherwise(best))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), keep=["doc_id"], plant="doc_id").withColumn("best", strongest(F.col("runs")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
