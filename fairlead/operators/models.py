"""Just-in-time classifier: feature screening, grouped cross-validation, selection by permutation, promotion."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fairlead.functions.codes import NO_COURSE, NO_HEADING

MAX_MISSING_PCT, MAX_CORRELATION, FOLDS, MAX_DROP = 50.0, 0.90, 10, 0.05
STABLE_FOLDS, LEAST_FEATURES = 6, 3
#: Buckets of hashes of groups, for dealing them into folds.
BUCKETS = 256


def clear_sentinels(df: DataFrame, course: str = "cog", heading: str = "heading") -> DataFrame:
    out = df
    if course in df.columns:
        out = out.withColumn(course, F.when(F.col(course) != NO_COURSE, F.col(course)))
    if heading in df.columns:
        out = out.withColumn(heading, F.when(F.col(heading) != NO_HEADING, F.col(heading)))
    return out


#: Size of a quantile sketch: up to so many values it holds them all, beyond, ranks are off by about 0.03 %.
SKETCH = 4096
BINS = 10
#: Folds that are fitted at the same time.
AT_ONCE = 5
#: Rows of the samples to a partition: a fit is hundreds of passes over few bytes a row, each a task for every partition.
ROWS_TOGETHER = 20_000
#: The same where one model without trees is fitted to a fold: its passes cost a task far more than its rows do.
LINEAR_TOGETHER = 250_000


def _sketches(df: DataFrame, columns: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each column, from one aggregation of mergeable sketches: distinct values in order, the mean rank (0 to 1) of each,
    and the cuts of BINS quantile bins. All of a size that SKETCH bounds."""
    number = lambda c: F.col(c).cast("double")
    made = df.agg(*[F.kll_sketch_agg_double(F.when(~F.isnan(number(c)), number(c)), F.lit(SKETCH)).alias(c) for c in columns]).first()
    # The sketches themselves are asked on a table of one row for each column.
    held = df.sparkSession.createDataFrame([(c, made[c]) for c in columns], "name string, sketch binary").where(F.kll_sketch_get_n_double("sketch") > 0)
    ask = lambda f, points, name: {r[0]: np.array(r[1], float) for r in held.where(F.col("name").isin(*name)).select("name", f("sketch", F.lit(points))).collect()}
    values = ask(F.kll_sketch_get_quantile_double, (np.arange(SKETCH) + 0.5) / SKETCH, columns)
    cuts = ask(F.kll_sketch_get_quantile_double, np.arange(1, BINS) / BINS, columns)
    out = {}
    for c in columns:
        if c not in values:
            out[c] = (np.zeros(0), np.zeros(0), np.zeros(0))
            continue
        known = np.unique(values[c])
        up_to = ask(F.kll_sketch_get_rank_double, known, [c])[c]
        out[c] = (known, (np.r_[0.0, up_to[:-1]] + up_to) / 2, np.unique(cuts[c]))
    return out


def _rank_sums(df: DataFrame, features: list[str], label: str) -> tuple[np.ndarray, dict]:
    """Correlations of ranks among the features and the label (the last), and counts by (feature, bin, label), from one
    pass that sums within tasks. A null has the middle rank and a bin of its own."""
    names = [*features, label]
    known = _sketches(df, names)
    width = len(names)

    def sums(batches):
        total = np.zeros((width + 1, width + 1))
        seen: dict = {}
        for rows in batches:
            columns = [rows[c].to_numpy(float, na_value=np.nan) for c in names]
            ranks = np.ones((len(rows), width + 1))
            for i, (c, x) in enumerate(zip(names, columns)):
                values, rank, _ = known[c]
                at = np.clip(np.searchsorted(values, x), 0, max(len(values) - 1, 0))
                ranks[:, i] = np.where(np.isnan(x), 0.5, rank[at]) if len(values) else 0.5
            total += ranks.T @ ranks
            for i, c in enumerate(features):
                bins = np.where(np.isnan(columns[i]), -1, np.searchsorted(known[c][2], columns[i], "left"))
                for key, n in zip(*np.unique(np.c_[bins, columns[-1]], axis=0, return_counts=True)):
                    seen[i, int(key[0]), float(key[1])] = seen.get((i, int(key[0]), float(key[1])), 0) + int(n)
        out = [(i, j, None, total[i, j]) for i in range(width + 1) for j in range(i + 1)]
        yield pd.DataFrame(out + [(i, b, y, float(n)) for (i, b, y), n in seen.items()], columns=["i", "j", "y", "value"]).astype({"y": float})

    given = df.where(F.col(label).isNotNull()).select(*[F.col(c).cast("double").alias(c) for c in names])
    summed = given.mapInPandas(sums, "i int, j int, y double, value double").groupBy("i", "j", F.col("y")).agg(F.sum("value").alias("value"))
    cross, joint = np.zeros((width + 1, width + 1)), {}
    for r in summed.collect():  # as many rows as pairs of columns, and bins by classes
        if r.y is None or np.isnan(r.y):
            cross[r.i, r.j] = cross[r.j, r.i] = r.value
        else:
            joint[r.i, r.j, r.y] = r.value
    n = max(cross[width, width], 1.0)
    mean = cross[width, :width] / n
    cov = cross[:width, :width] / n - np.outer(mean, mean)
    spread = np.sqrt(np.clip(np.diag(cov), 0, None))
    with np.errstate(divide="ignore", invalid="ignore"):
        matrix = np.where(np.outer(spread > 1e-12, spread > 1e-12), cov / np.outer(spread, spread), np.nan)
    return matrix, joint


def _information(joint: dict, feature: int) -> float:
    """Mutual information (nats) of a feature's bins and the label."""
    own = {(b, y): n for (i, b, y), n in joint.items() if i == feature}
    n = sum(own.values())
    by_bin, by_label = {}, {}
    for (b, y), k in own.items():
        by_bin[b], by_label[y] = by_bin.get(b, 0) + k, by_label.get(y, 0) + k
    return max(0.0, sum(k / n * np.log(k * n / (by_bin[b] * by_label[y])) for (b, y), k in own.items()))


def mutual_information(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """feature, mutual_information (nats) with the label, over BINS quantile bins; null is a bin of its own."""
    _, joint = _rank_sums(df, features, label)
    return df.sparkSession.createDataFrame([(f, float(_information(joint, i))) for i, f in enumerate(features)], "feature string, mutual_information double")


def _pearson(a: str, b: str):
    """Correlation from sums; null for a constant, where the built-in one divides by zero in ANSI mode."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    sx, sy = F.stddev_pop(F.when(y.isNotNull(), x)), F.stddev_pop(F.when(x.isNotNull(), y))
    return F.when((sx > 0) & (sy > 0), F.covar_pop(x, y) / sx / sy)


def feature_screen(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """feature, missing_pct, mutual_information, pearson, spearman (with the label), kept and reason.

    Three aggregations whatever the number of features: counts and moments, quantile sketches, and the sums of ranks; the
    driver gets their totals only. Features that are mostly missing or constant go; of two whose ranks go together, the one
    that says less of the label. Ties are ranked in their middle, nulls in the middle of all. Rows without label count for
    what is missing only. An empty table keeps nothing (all constant)."""
    aggs = [a for f in features for a in (F.avg(F.col(f).isNull().cast("double")).alias(f"{f}__m"), (F.min(f) < F.max(f)).alias(f"{f}__d"), _pearson(f, label).alias(f"{f}__p"))]
    one = df.agg(*aggs).first()
    matrix, joint = _rank_sums(df, features, label)
    info = {f: float(_information(joint, i)) for i, f in enumerate(features)}
    reason = {f: "missing" if 100 * (one[f"{f}__m"] or 0) > MAX_MISSING_PCT else "" if one[f"{f}__d"] else "constant" for f in features}
    for i, a in enumerate(features):
        for j, b in enumerate(features[:i]):
            if not reason[a] and not reason[b] and abs(matrix[i, j]) >= MAX_CORRELATION:
                worse = a if info[a] <= info[b] else b
                reason[worse] = f"correlated with {b if worse == a else a}"
    spearman = [None if np.isnan(x) else float(x) for x in matrix[:-1, -1]]
    rows = [(f, float(100 * (one[f"{f}__m"] or 0)), info[f], one[f"{f}__p"], spearman[i], not reason[f], reason[f]) for i, f in enumerate(features)]
    return df.sparkSession.createDataFrame(rows, "feature string, missing_pct double, mutual_information double, pearson double, spearman double, kept boolean, reason string")


def numbered(df: DataFrame, by: Column, keys: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: each row's place (from 0) within ``keys`` in the order of the hash ``by``. No task orders all
    rows of a key: buckets of hashes are counted, and rows placed inside their bucket, behind those before it."""
    held = df.withColumn("__by", by).withColumn("__bucket", F.pmod("__by", F.lit(BUCKETS)))
    before = W.partitionBy(*keys).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)  # one row for each bucket
    offsets = held.groupBy(*keys, "__bucket").agg(F.count("*").alias("__n")).select(*keys, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(W.partitionBy(*keys, "__bucket").orderBy("__by", *df.columns))
    placed = held.withColumn("__inside", inside).join(F.broadcast(offsets), [*keys, "__bucket"])  # BUCKETS rows for a key at most
    return placed.select(*df.columns, (F.col("__before") + F.col("__inside") - 1).alias(name))


def with_folds(df: DataFrame, group: str, label: str, folds: int = FOLDS) -> DataFrame:
    """``fold``: all rows of a group in one fold; groups are dealt in turn within their majority label, in
    the order of their hashes, so folds differ by one group at most, over all and in each label."""
    groups = df.groupBy(group).agg(F.avg(F.col(label).cast("double")).alias("__share"), F.count("*").alias("__n"))
    kind = F.coalesce((F.col("__share") >= 0.5).cast("int"), F.lit(0))
    held = groups.select(F.col(group), kind.alias("__kind"), F.xxhash64(group).alias("__hash")).withColumn("__bucket", F.pmod("__hash", F.lit(BUCKETS)))
    before = W.orderBy("__kind", "__bucket").rowsBetween(W.unboundedPreceding, -1)  # one row for each bucket
    offsets = held.groupBy("__kind", "__bucket").agg(F.count("*").alias("__n")).select("__kind", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    rank = F.row_number().over(W.partitionBy("__kind", "__bucket").orderBy("__hash", group)) - 1
    dealt = held.withColumn("__rank", rank).join(F.broadcast(offsets), ["__kind", "__bucket"]).select(group, F.pmod(F.col("__before") + F.col("__rank"), F.lit(folds)).cast("int").alias("fold"))
    return df.join(dealt, group)


def leakage(df: DataFrame, group: str) -> int:
    """Groups with rows in more than one fold."""
    return df.groupBy(group).agg(F.countDistinct("fold").alias("n")).where("n > 1").count()


def candidates() -> dict:
    return {
        "logistic_regression": LogisticRegression(labelCol="label", featuresCol="features", weightCol="weight", elasticNetParam=1.0, regParam=0.01, maxIter=100),
        "random_forest": RandomForestClassifier(labelCol="label", featuresCol="features", weightCol="weight", numTrees=150, maxDepth=4, seed=42),
        "gradient_boosting": GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight", maxIter=80, maxDepth=2, seed=42),
    }


def preparation(features: list[str]) -> list:
    filled = [f"{f}__f" for f in features]
    return [Imputer(inputCols=features, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]


def pipeline(features: list[str], estimator) -> Pipeline:
    return Pipeline(stages=[*preparation(features), estimator])


def balanced(df: DataFrame, label: str) -> DataFrame:
    """label as double and ``weight`` that gives both classes the same say."""
    n = {r[0]: r[1] for r in df.groupBy(F.col(label).cast("int")).count().collect()}
    total, classes = sum(n.values()), max(len(n), 1)
    w = F.when(F.col(label).cast("int") == 1, F.lit(total / (classes * n.get(1, 1)))).otherwise(F.lit(total / (classes * n.get(0, 1))))
    return df.withColumn("label", F.col(label).cast("double")).withColumn("weight", w)


def confusion_metrics(predicted: DataFrame, keys: list[str], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Counts and accuracy, balanced accuracy, precision, recall and F1 of each class, and their macro F1."""
    n = lambda y, p: F.count(F.when((F.col(label) == y) & (F.col(prediction) == p), 1))
    c = predicted.groupBy(*keys).agg(n(1, 1).alias("tp"), n(0, 0).alias("tn"), n(0, 1).alias("fp"), n(1, 0).alias("fn"))
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    c = c.withColumns({"accuracy": over(tp + tn, tp + tn + fp + fn), "precision_1": over(tp, tp + fp), "recall_1": over(tp, tp + fn), "precision_0": over(tn, tn + fn), "recall_0": over(tn, tn + fp)})
    f1 = lambda k: over(2 * F.col(f"precision_{k}") * F.col(f"recall_{k}"), F.col(f"precision_{k}") + F.col(f"recall_{k}"))
    return c.withColumns({"balanced_accuracy": (F.col("recall_0") + F.col("recall_1")) / 2, "f1_0": f1(0), "f1_1": f1(1)}).withColumn("f1_macro", (F.col("f1_0") + F.col("f1_1")) / 2)


def _side_by_side(calls: list[tuple]) -> list:
    """The rows of all calls (function, arguments) in their order; a few run at once, since each is many small jobs."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return [row for rows in pool.map(lambda c: c[0](*c[1:]), calls) for row in rows]


@contextmanager
def _in_folds(df: DataFrame, group: str, label: str, folds: int, together: int = ROWS_TOGETHER):
    """(samples, reasons): ``df`` with fold, label and weight, read once and kept in as many partitions as its rows call
    for (``together`` in each), and by fold why it cannot be judged, or None."""
    given = df.persist()
    parts = None
    try:
        tasks = max(1, -(-given.count() // together))
        parts = balanced(with_folds(given, group, label, folds), label).repartition(tasks).persist()
        met = {(r.fold, r.label) for r in parts.select("fold", "label").distinct().collect()}  # folds by classes
        tested = {k for k, _ in met}
        classes = {k: {y for other, y in met if other != k} for k in range(folds)}
        yield parts, {k: "no test rows" if k not in tested else "training rows of one class" if len(classes[k]) < 2 else None for k in range(folds)}
    finally:
        if parts is not None:
            parts.unpersist()
        given.unpersist()


def grouped_cv(df: DataFrame, features: list[str], label: str, group: str, folds: int = FOLDS, models: dict | None = None) -> DataFrame:
    """Metrics of each model and fold; all fitting and scoring is MLlib's. The number of models and folds is fixed, and a
    fold's features are prepared once for all models. A fold that cannot be scored is a row without metrics whose
    ``reason`` says why."""
    with _in_folds(df, group, label, folds) as (parts, reasons):
        if leakage(parts, group):
            raise ValueError("a group is in two folds")
        schema = confusion_metrics(parts.select(F.lit("").alias("model"), F.lit(0).alias("fold"), "label", F.lit(0.0).alias("prediction")), ["model", "fold"]).schema.add("auc", "double").add("reason", "string")
        for f in schema:
            f.nullable = True
        named = models or candidates()

        def judged(k):
            if reasons[k]:
                return [(name, k, *[None] * (len(schema) - 3), reasons[k]) for name in named]
            train = parts.where(F.col("fold") != k)
            ready = Pipeline(stages=preparation(features)).fit(train)
            train, test = (ready.transform(rows).select("label", "weight", "features").persist() for rows in (train, parts.where(F.col("fold") == k)))
            out = []
            try:
                for name, estimator in named.items():
                    scored = estimator.fit(train).transform(test)
                    auc = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="rawPrediction").evaluate(scored)
                    one = confusion_metrics(scored.withColumn("model", F.lit(name)).withColumn("fold", F.lit(k)), ["model", "fold"])
                    out += [(*r, auc, None) for r in one.collect()]  # one row
            finally:
                train.unpersist()
                test.unpersist()
            return out

        return df.sparkSession.createDataFrame(_side_by_side([(judged, k) for k in range(folds)]), schema)


def rank_models(metrics: DataFrame) -> DataFrame:
    """Mean and deviation over folds, best first."""
    order = ["recall_0", "balanced_accuracy", "f1_macro", "auc"]
    return metrics.groupBy("model").agg(*[a for m in order for a in (F.avg(m).alias(m), F.stddev_samp(m).alias(f"{m}_std"))]).orderBy(*[F.desc(m) for m in order])


def permuted(df: DataFrame, features: list[str], seed: int = 42) -> DataFrame:
    """``df`` once for each feature, with ``feature``: that one's values dealt anew over all rows by a random order, and
    once as it is, with feature ''. A row at one place of the table's order gets the value at that place of the feature's
    own random order, so each column keeps its values, however often they come."""
    rows = numbered(df, F.xxhash64(*df.columns), [], "__own")
    values = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("__value")) for f in features]))
    donors = rows.select("__own", values.alias("v")).select("__own", "v.*")
    dealt = numbered(donors, F.xxhash64(F.lit(seed), "feature", "__own"), ["feature"], "__place").select("feature", F.col("__place").alias("__own"), "__value")
    asked = rows.withColumn("feature", F.explode(F.array(*[F.lit(f) for f in ("", *features)])))
    met = asked.join(dealt, ["feature", "__own"], "left")
    swapped = {f: F.when(F.col("feature") == f, F.col("__value").cast(df.schema[f].dataType)).otherwise(F.col(f)) for f in features}
    return met.withColumns(swapped).select(*df.columns, "feature")


def permutation_importance(model, test: DataFrame, features: list[str], seed: int = 42) -> DataFrame:
    """feature, importance: the loss of balanced accuracy when that feature's values are dealt anew. All features are scored
    in one pass."""
    by = confusion_metrics(model.transform(permuted(test, features, seed)), ["feature"]).select("feature", "balanced_accuracy")
    base = F.max(F.when(F.col("feature") == "", F.col("balanced_accuracy"))).over(W.partitionBy())  # one row for each feature
    return by.withColumn("importance", base - F.col("balanced_accuracy")).where("feature <> ''").select("feature", "importance")


def fold_importances(df: DataFrame, features: list[str], label: str, group: str, estimator, folds: int = FOLDS, seed: int = 42) -> DataFrame:
    """fold, feature, importance of one kind of model, fitted anew for each fold and judged on the fold left out; for
    ``select_stable``. The number of folds is fixed; a fold that cannot be judged has no rows."""
    trees = hasattr(estimator, "maxDepth")
    with _in_folds(df, group, label, folds, ROWS_TOGETHER if trees else LINEAR_TOGETHER) as (parts, reasons):

        def judged(k):
            if reasons[k]:
                return []
            model = pipeline(features, estimator).fit(parts.where(F.col("fold") != k))
            by = permutation_importance(model, parts.where(F.col("fold") == k), features, seed + k)
            return [(k, r.feature, r.importance) for r in by.collect()]  # one row for each feature

        rows = _side_by_side([(judged, k) for k in range(folds)])
        return df.sparkSession.createDataFrame(rows, "fold int, feature string, importance double")


def select_stable(importances: DataFrame, forced: list[str] = ("destination_port_code",), least_folds: int = STABLE_FOLDS, least: int = LEAST_FEATURES) -> DataFrame:
    """``importances``: fold, feature, importance. Kept are features useful in enough folds, the forced ones, and the best
    others up to ``least``."""
    by = importances.groupBy("feature").agg(F.sum((F.col("importance") > 0).cast("int")).alias("folds"), F.avg("importance").alias("mean_importance"))
    order = W.orderBy(F.desc((F.col("feature").isin(*forced)).cast("int")), F.desc("folds"), F.desc("mean_importance"), "feature")  # one row for each feature
    return by.withColumn("rank", F.row_number().over(order)).withColumn("selected", (F.col("folds") >= least_folds) | F.col("feature").isin(*forced) | (F.col("rank") <= least))


def keep_reduced(full: dict, reduced: dict, most: float = MAX_DROP) -> bool:
    """The smaller model stays if it loses little."""
    return all(full[m] - reduced[m] <= most for m in ("recall_0", "balanced_accuracy"))


def promote(champion: dict | None, challenger: dict) -> bool:
    """Better recall, or equal recall and better balanced accuracy."""
    if champion is None:
        return True
    key = lambda m: (round(m["recall_0"], 12), round(m["balanced_accuracy"], 12))
    return key(challenger) > key(champion)


def register_champion(model, metrics: dict, path: str, metrics_table: str, spark) -> bool:
    """Saves the model beside its metrics if it is promoted over the best in ``metrics_table``."""
    best = None
    if spark.catalog.tableExists(metrics_table):
        r = spark.table(metrics_table).where("champion").orderBy(F.desc("version")).first()
        best = r.asDict() if r else None
    version = (best["version"] if best else 0) + 1
    won = promote(best, metrics)
    if won:
        model.write().overwrite().save(f"{path}/v{version}")
        row = [(version, float(metrics["recall_0"]), float(metrics["balanced_accuracy"]), True)]
        spark.createDataFrame(row, "version int, recall_0 double, balanced_accuracy double, champion boolean").write.mode("append").saveAsTable(metrics_table)
    return won


def score(model, df: DataFrame, features: list[str]) -> DataFrame:
    """model_label and model_probability of class 1; nothing leaves the executors."""
    return model.transform(df).withColumn("model_label", F.col("prediction").cast("int")).withColumn("model_probability", vector_to_array("probability")[1]).select(*df.columns, "model_label", "model_probability")
