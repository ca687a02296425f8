"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np

from fairlead.llm import periodic


def brute_runs(words):
    """All maximal stretches of each lag, kept where no smaller period fits."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(6, 4 * q) and not any(words[i : i + size - p] == words[i + p : i + size] for p in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(rng, size):
    words = []
    while len(words) < size:
        kind = rng.random()
        if kind < 0.4:
            words += [rng.randrange(2)] * rng.randrange(1, 9)
        elif kind < 0.7:
            block = [rng.randrange(3) for _ in range(rng.randrange(1, 9))]
            words += (block * rng.randrange(1, 7))[: rng.randrange(1, 50)]
        else:
            words.append(rng.randrange(5))
    return words


def test_random_words():
    rng, seen = random.Random(3), 0
    for _ in range(600):
        texts = [random_words(rng, rng.randrange(80)) for _ in range(rng.randrange(1, 4))]
        flat = np.array([w * len(texts) + d for d, t in enumerate(texts) for w in t], np.int64)
        bounds = np.r_[0, np.cumsum([len(t) for t in texts])]
        want = [(int(bounds[d]) + a, n, q) for d, t in enumerate(texts) for a, n, q in brute_runs(t)]
        assert periodic.find_runs(flat, bounds) == want
        seen += len(want)
    assert seen > 500


def test_one_word_very_often_and_long_periods():
    one = np.zeros(300_000, np.int64)
    assert periodic.find_runs(one, np.array([0, len(one)])) == [(0, 300_000, 1)]
    long = np.arange(40_000) % 9_999
    assert periodic.find_runs(long, np.array([0, len(long)])) == [(0, 40_000, 9_999)]


def want_row(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    dropped = {i for a, size, q in runs for i in range(a + q, a + size)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    milli = best[1] * 1000 // best[2] if runs else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *best, milli, sha("".join(f"{a},{size},{q}\n" for a, size, q in runs)), sha(kept))


def query(spark, frame, tmp_path):
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    return periodic.op13_periodic_runs(spark, str(tmp_path))


def test_documents(spark, tmp_path):
    texts = ["", None, "a " * 5, "a\t" * 6, "x a b\na b a b a b y", "é z " * 9, "a b c " * 4 + "a b", "a a a a a a b b b b b b", "same same " * 3, "same same " * 3]
    rows = [(i, texts[i % len(texts)], 7, "n") for i in range(60)] + [(None, "k l " * 7, 7, "n")] * 2
    frame = spark.createDataFrame(rows, "doc_id long, text string, best long, runs string")
    got = sorted(map(tuple, query(spark, frame, tmp_path).collect()), key=str)
    assert got == sorted((want_row(i, t) for i, t, *_ in rows), key=str)
    assert query(spark, frame.limit(0), tmp_path / "none").count() == 0


def test_whole_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: tuple(r) for r in periodic.op13_periodic_runs(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert got == {r.doc_id: want_row(r.doc_id, r.text) for r in docs}
    assert sum(r[1] for r in got.values()) > 10
