"""Screening, permutation and selection of features."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairlead.operators import models


@pytest.fixture(scope="module")
def sample(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        y = i % 2
        x = y * 3 + rng.random()
        rows.append((i, f"g{i % 23}", x, round(x * 2, 9), rng.random() if i % 5 else None, 1.0, None if i % 10 else 1.0, y))
    return spark.createDataFrame(rows, "id long, grp string, good double, twin double, gaps double, same double, rare double, label int").repartition(5, "id").cache()


def test_screen_against_whole_ranks(spark, sample):
    got = {r.feature: r for r in models.feature_screen(sample, ["good", "twin", "gaps", "same", "rare"], "label").collect()}
    assert [got[f].kept for f in ("good", "twin", "gaps", "same", "rare")] == [True, False, True, False, False]
    assert got["twin"].reason.startswith("correlated") and got["same"].reason == "constant" and got["rare"].reason == "missing"
    d = sample.toPandas()
    assert got["good"].spearman == pytest.approx(d.good.rank().corr(d.label.rank()), abs=1e-9)
    filled = (d.gaps.rank() - 0.5).div(d.gaps.count()).fillna(0.5)
    assert got["gaps"].spearman == pytest.approx(filled.corr(d.label.rank()), abs=1e-9)
    assert got["same"].spearman is None and got["good"].mutual_information == pytest.approx(np.log(2), abs=1e-6)
    assert got["gaps"].missing_pct == 20.0
    none = models.feature_screen(sample.limit(0), ["good"], "label").first()
    assert (none.kept, none.reason, none.mutual_information) == (False, "constant", 0.0)


def test_ranks_beyond_the_sketch_are_close(spark, monkeypatch):
    monkeypatch.setattr(models, "SKETCH", 256)
    d = spark.range(20_000).select((F.col("id") * 7919 % 20_011).cast("double").alias("x"), (F.col("id") * 7919 % 20_011 > 9000).cast("int").alias("label"))
    matrix, _ = models._rank_sums(d, ["x"], "label")
    exact = d.toPandas()
    assert matrix[0, 1] == pytest.approx(exact.x.rank().corr(exact.label.rank()), abs=0.02)


def test_a_permuted_column_keeps_its_values(spark, sample):
    d = sample.select("id", "good", "gaps", "label")
    moved = models.permuted(d, ["good", "gaps"]).toPandas()
    plain = d.toPandas().sort_values("id").reset_index(drop=True)
    for f in ("", "good", "gaps"):
        part = moved[moved.feature == f].sort_values("id").reset_index(drop=True)
        assert len(part) == 400
        for c in ("good", "gaps", "label"):
            assert sorted(part[c].fillna(-1)) == sorted(plain[c].fillna(-1))
            changed = (part[c].fillna(-1) != plain[c].fillna(-1)).mean()
            assert changed > 0.5 if c == f else changed == 0
    same = spark.createDataFrame([(1.0,)] * 30, "x double")
    assert {r.feature: r["count"] for r in models.permuted(same, ["x"]).groupBy("feature").count().collect()} == {"": 30, "x": 30}
    assert models.permuted(same.limit(0), ["x"]).count() == 0


def test_folds_choose_the_feature_that_tells(spark, sample):
    by = models.fold_importances(sample, ["good", "gaps"], "label", "grp", models.candidates()["logistic_regression"], folds=3)
    assert by.count() == 6 and {r.fold for r in by.collect()} == {0, 1, 2}
    kept = {r.feature: r for r in models.select_stable(by, forced=(), least_folds=3, least=1).collect()}
    assert kept["good"].selected and kept["good"].folds == 3 and not kept["gaps"].selected


def test_samples_are_kept_in_as_many_partitions_as_their_rows_call_for(spark):
    rows = [(f"g{g}", int(g < 3), float(g)) for g in range(6)]
    d = spark.createDataFrame(rows, "source string, quality int, x double").repartition(64)
    with models._in_folds(d, "source", "quality", 8) as (parts, reasons):
        assert parts.rdd.getNumPartitions() == 1 and parts.count() == 6
        assert sorted(r or "" for r in reasons.values()) == [""] * 6 + ["no test rows"] * 2


def test_passes_of_a_linear_model_have_few_tasks(spark, sample, monkeypatch):
    monkeypatch.setattr(models, "ROWS_TOGETHER", 10)
    real, met = models.pipeline, []

    class Counted:
        def __init__(self, *args):
            self.pipeline, self.trees = real(*args), hasattr(args[1], "maxDepth")

        def fit(self, train):
            met.append((self.trees, train.rdd.getNumPartitions()))
            return self.pipeline.fit(train)

    monkeypatch.setattr(models, "pipeline", Counted)
    models.fold_importances(sample, ["good"], "label", "grp", models.candidates()["logistic_regression"], folds=2)
    assert met == [(False, 1)] * 2
