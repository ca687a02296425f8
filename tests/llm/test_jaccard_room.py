"""What the shingle join leaves behind, and the forms of its joins for many pairs and repeated rows."""

import random
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fairlead.llm import jaccard
from fairlead.llm.common import BATCH_ROWS, work_folder
from fairlead.llm.mixing import mix
from fairlead.llm.quality import score_quality


def _rows(seed):
    """Families of near texts, copies, and rows that repeat doc_id and text."""
    rng = random.Random(seed)
    rows = []
    for family in range(25):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(5, 90))]
        for k in range(rng.randrange(1, 6)):
            words = list(base)
            for _ in range(k):
                words[rng.randrange(len(words))] = f"v{rng.randrange(400)}"
            rows.append((len(rows) * 7 % 1009, " ".join(words)))
    return rows + rows[::3] + [(i + 5000, text) for i, text in rows[::4]]


def _brute(rows, words, num, den):
    sets = {}
    for i, text in rows:
        w = text.split()
        sets[i] = frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) or frozenset([tuple(w)])
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((i, len(sets[i]), find(i)) for i, _ in rows)


@pytest.mark.parametrize("few", [200_000, 0])
def test_repeated_rows_and_many_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(jaccard, "BROADCAST_PAIRS", few)
    rows = _rows(few + 1)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = jaccard.jaccard_components(d, 4, 80, 100).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == _brute(rows, 4, 80, 100)


def test_only_what_the_answer_reads_stays(spark):
    """Counts of shingles, sets, prefixes and lists, each of the size of the texts, are gone when the join returns."""
    shared = Path(work_folder(spark).removeprefix("file://"))
    before = {p.name for p in shared.glob("*")}
    out = jaccard.jaccard_components(spark.createDataFrame(_rows(3), "doc_id long, text string"), 4, 80, 100)
    left = {p.name.rsplit("-", 1)[0] for p in shared.glob("*") if p.name not in before}
    assert not left & {"summaries", "classes", "hub-sets", "likeliest-sets", "prefixes", "shared", "lists", "met", "blocks"}
    assert out.count() == len(_rows(3))


def test_batches_of_texts_are_small(spark):
    """A task holds its batch of texts several times over; a session's own number of rows stays as it is."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    few = spark.createDataFrame([(1, "a text of some words"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, label int")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    before = spark.conf.get(key, None)
    try:
        for use in (lambda: jaccard.jaccard_components(few, 4, 80, 100), lambda: score_quality(few, labels)):
            spark.conf.unset(key)
            use()
            met = [r.n for r in spark.range(0, 2500, 1, 1).mapInArrow(sizes, "n long").collect()]
            assert sum(met) == 2500 and max(met) <= BATCH_ROWS
            spark.conf.set(key, "77")
            use()
            assert spark.conf.get(key) == "77"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_small_frames_need_no_python_on_executors(spark):
    """Neither the outcome of no pairs nor the table of cells is an RDD that Python workers make."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    none = docs.select(*[F.col("doc_id").cast("long").alias(c) for c in ("a", "b")], F.lit(0.8).alias("floor")).where("false")
    compared = jaccard.JaccardJoin(docs, 4, 80, 100)._compared(none, "none")
    assert compared.dtypes == [(c, "bigint") for c in ("a", "b", "common", "size_a", "size_b")] and not compared.count()
    mixed = mix(docs.withColumn("topic", F.lit("none")))
    assert mixed.where("mix_kept").count() and not mix(docs.withColumn("topic", F.lit("none")).limit(0)).count()
    for made in (compared, mixed):
        assert "LogicalRDD" not in made._jdf.queryExecution().logical().toString()
