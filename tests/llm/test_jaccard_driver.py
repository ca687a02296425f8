"""What the shingle join costs the driver: the jobs it starts and the broadcasts it holds."""

import random

import pytest
from pyspark import SparkContext

from fairlead.llm import jaccard


@pytest.fixture(scope="module")
def near(spark, tmp_path_factory):
    """Families of near texts, with near ones among the families, stored so that reading them is one job."""
    rng = random.Random(5)
    rows, core = [], [f"c{rng.randrange(300)}" for _ in range(60)]
    for family in range(20):
        base = core[:50] + [f"w{rng.randrange(300)}" for _ in range(8)] if family % 2 else [f"w{rng.randrange(300)}" for _ in range(60)]
        for k in range(4):
            words = list(base)
            words[rng.randrange(60) % len(words)] = f"v{k}"
            rows.append((len(rows), " ".join(words)))
    path = str(tmp_path_factory.mktemp("near") / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    return spark.read.parquet(path)


def test_few_jobs(spark, near):
    """Every job, plan and broadcast leaves its mark on the driver's memory, however small the table is."""
    context = spark.sparkContext
    context.setJobGroup("few-jobs", "")
    try:
        jaccard.jaccard_components(near, 4, 85, 100)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(context.statusTracker().getJobIdsForGroup("few-jobs"))
    assert 0 < jobs <= 190


def test_broadcasts_go_once_they_are_used(spark, near, monkeypatch):
    made, broadcast = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: made.append(broadcast(self, value)) or made[-1])
    out = jaccard.jaccard_components(near, 4, 85, 100)
    assert len(made) > 2 and not [b for b in made if b._jbroadcast.isValid()]
    assert out.count() == near.count()
