"""Tables by bucket versions, batches taken once, documents with a ledger of keys."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fairlead.sources import sinks
from fairlead.sources.tables import BucketedTable

T0 = datetime(2024, 1, 1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_an_update_rewrites_the_buckets_it_touches(spark, tmp_path):
    t = BucketedTable(spark, str(tmp_path / "t"), "k", buckets=50)
    with pytest.raises(ValueError):
        t.read()
    assert t.upsert(spark.range(2000).select(F.col("id").alias("k"), F.lit("old").alias("v"))) == 50
    before, reader = {p: p.stat().st_mtime_ns for p in (tmp_path / "t/data").rglob("*.parquet")}, t.read()
    assert t.upsert(spark.createDataFrame([(7, "new"), (7, "newer"), (5000, "more"), (None, "none")], "k long, v string")) <= 2
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "t/data").rglob("*.parquet")}
    assert {p: after[p] for p in before} == before and len(after) - len(before) <= 2  # a fiftieth for each key
    got = {r.k: r.v for r in t.read().collect()}
    assert len(got) == 2001 and got[7] == "newer" and got[5000] == "more" and got[8] == "old"
    assert reader.where("v <> 'old'").count() == 0 and reader.count() == 2000  # a reader keeps what it began with
    assert len(t.unused()) <= 2 and t.upsert(spark.createDataFrame([], "k long, v string")) == 0


def test_a_cut_run_leaves_the_old_version(spark, tmp_path):
    t = BucketedTable(spark, str(tmp_path / "t"), ["a", "b"], buckets=4)
    t.upsert(spark.createDataFrame([(1, "x", 1), (2, None, 2)], "a int, b string, v int"))
    whole = t.spark.createDataFrame

    def cut(*args, **kwargs):
        raise RuntimeError("ends before its manifest")

    updates = whole([(1, "x", 10), (3, "y", 3)], "a int, b string, v int")
    t.spark.createDataFrame = cut
    try:
        with pytest.raises(RuntimeError):
            t.upsert(updates)
    finally:
        t.spark.createDataFrame = whole
    assert rows(t.read()) == [(1, "x", 1), (2, None, 2)]
    t.upsert(updates)
    assert rows(t.read()) == [(1, "x", 10), (2, None, 2), (3, "y", 3)]
    t.upsert(whole([(3, "y", 4, "n")], "a int, b string, v int, more string"))
    assert rows(t.read()) == [(1, "x", 10, None), (2, None, 2, None), (3, "y", 4, "n")]
    with pytest.raises(ValueError, match="keys"):
        BucketedTable(spark, str(tmp_path / "t"), "a").read()


def test_a_replayed_batch_is_in_each_sink_once(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    calls, files = [], {n: sinks.batch_files(str(tmp_path / n)) for n in "ab"}

    def first(batch, n):
        calls.append(("a", n))
        files["a"](batch, n)

    def fails_once_after_writing(batch, n):
        calls.append(("b", n))
        files["b"](batch, n)
        if calls.count(("b", n)) == 1 and n == 1:
            raise RuntimeError("after its write")

    def run():
        sinks.fan_out(stream, {"a": first, "b": fails_once_after_writing}, str(tmp_path / "ck"), str(tmp_path / "ledger")).awaitTermination()

    with pytest.raises(Exception, match="after its write"):
        run()
    run()
    assert calls == [("a", 0), ("b", 0), ("a", 1), ("b", 1), ("b", 1), ("a", 2), ("b", 2)]
    for name in "ab":
        assert sorted(r.id for r in spark.read.parquet(str(tmp_path / name)).collect()) == list(range(30))


def test_documents_look_up_their_own_days_only(spark, tmp_path):
    path = str(tmp_path / "docs")
    event = lambda day, *keys: spark.createDataFrame([(k, T0 + timedelta(days=day), i) for i, k in enumerate(keys)], "event_id string, emitted_at timestamp, v int")
    for day in range(4):
        sinks.dated_documents(event(day, "a", "b"), path)
    sinks.dated_documents(event(2, "b", "c"), path)
    sinks.dated_documents(event(2, "b", "c"), path)
    got = sorted((str(r.dt), r.event_id) for r in spark.read.json(path).collect())
    assert got == sorted([(f"2024-01-0{d + 1}", k) for d in range(4) for k in "ab"] + [("2024-01-03", "c")])
    earlier = spark.read.schema("event_id string, dt date, batch string").parquet(f"{path}/_keys")
    found = sinks.stored_keys(earlier, event(2, "x").withColumn("dt", F.to_date("emitted_at")), "other")
    assert {str(r.dt) for r in found.collect()} == {"2024-01-03"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "2024-01-03" in plan.split("PartitionFilters")[1]
    with pytest.raises(Exception, match="CAST|cast|type|INT|Parquet"):
        sinks.dated_documents(event(2, "y").withColumn("event_id", F.lit(5)), path)  # another type of key is an error
