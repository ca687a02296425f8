"""Columns that change over time, and joined objects read in splits."""

import json
import random
import time

import pytest
from pyspark.sql import types as T

from fairlead.sources import evolving, files, sinks


def put(spark, path, rows, schema):
    time.sleep(1.1)  # files are told apart by seconds
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def test_a_new_column_after_a_restart_or_while_it_runs(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    log = evolving.SchemaLog(spark, str(tmp_path / "log"))
    put(spark, src, [(1, "x")], "a int, b string")
    writer = evolving.guarded(sinks.batch_files(out), log)

    def start():
        return evolving.evolving_files(spark, str(src), log)

    def run(stream):
        sinks.fan_out(stream, [writer], ck).awaitTermination()

    def stored():
        d = spark.read.schema(log.current()).parquet(out)
        return sorted(map(tuple, d.select(*sorted(log.current().names)).collect()), key=str)

    run(start())
    put(spark, src, [(2, "y", 0.5)], "a int, b string, c double")
    run(start())  # a restart finds the new column
    assert stored() == [(1, "x", None), (2, "y", 0.5)]
    running = start()
    put(spark, src, [(3, "z", 1.5, True)], "a int, b string, c double, d boolean")
    with pytest.raises(Exception, match="SchemaChanged"):
        run(running)  # it came while the stream was running
    assert stored() == [(1, "x", None, None), (2, "y", 0.5, None)]
    run(start())
    assert stored() == [(1, "x", None, None), (2, "y", 0.5, None), (3, "z", 1.5, True)]
    running = start()
    put(spark, src, [(2**40, None)], "a long, b string")
    with pytest.raises(Exception, match="PARQUET_COLUMN_DATA_TYPE_MISMATCH"):
        run(running)
    run(start())
    assert stored()[-1] == (3, "z", 1.5, True) and (2**40, None, None, None) in stored() and len(stored()) == 4
    assert log.current().simpleString() == "struct<a:bigint,b:string,c:double,d:boolean>"
    with pytest.raises(ValueError, match="column b"):
        log.widen(T.StructType().add("b", T.IntegerType()))
    with pytest.raises(ValueError, match="no files"):
        evolving.SchemaLog(spark, str(tmp_path / "other")).look(str(tmp_path / "nowhere"))


def test_unknown_fields_are_rescued(spark):
    lines = ['{"a": 1, "b": "x"}', '{"a": 2, "n": {"m": [1, 2]}, "k": "v"}', '{"a": "no number"}', "no object", None, '{"a": null}']
    got = evolving.evolving_json(spark.createDataFrame([(x,) for x in lines], "value string"), T.StructType.fromDDL("a int, b string")).collect()
    assert [(r.a, r.b) for r in got] == [(1, "x"), (2, None), (None, None), (None, None), (None, None), (None, None)]
    rescued = [r._rescued for r in got]
    assert rescued[0] is None and json.loads(rescued[1]) == {"n": '{"m":[1,2]}', "k": "v"} and json.loads(rescued[2]) == {"a": "no number"}
    assert rescued[3] == "no object" and rescued[4:] == [None, None]


def test_joined_objects_in_splits_as_in_one_piece(spark, tmp_path):
    rng, objects = random.Random(6), []
    odd = ["plain", "} {", '"', "\\", '\\"}', "{", "}{", "é日", "a\nb", ""]
    for i in range(400):
        objects.append({"n": i, "s": "".join(rng.choice(odd) for _ in range(rng.randrange(5))), "o": {"p": {"q": rng.choice(odd)}}, "l": [{"z": 1}] * rng.randrange(3)})
    for k, end in enumerate(("", " \n", "\n\n")):
        text = "".join(json.dumps(o, ensure_ascii=bool(o["n"] % 2), indent=rng.choice([None, 1])) + rng.choice(["", " ", "\n"]) for o in objects[:-1]) + json.dumps(objects[-1]) + end
        (tmp_path / f"f{k}.json").write_text(text, encoding="utf-8")
    (tmp_path / "empty.json").write_text("")
    schema = "n int, s string, o struct<p: struct<q: string>>, l array<struct<z: int>>"
    size = (tmp_path / "f0.json").stat().st_size
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for splits in (8, 1):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size // splits + 1))
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            rows = files.joined_objects(spark, str(tmp_path), schema)
            got = {}
            for r in rows.collect():
                got.setdefault(r.file.rsplit("/", 1)[1], {})[r.idx] = r.o.asDict(recursive=True)
            assert set(got) == {"f0.json", "f1.json", "f2.json"}
            assert all([v[i] for i in range(len(v))] == objects for v in got.values())
        part = files.joined_objects(spark, str(tmp_path / "f1.json"), schema, first=10, most=3)
        assert sorted((r.idx, r.o.n) for r in part.collect()) == [(10, 10), (11, 11), (12, 12)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
