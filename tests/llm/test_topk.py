"""Exact search against its SQL on rows that repeat ids and vectors, with vectors of several lengths."""

from __future__ import annotations

import random

import duckdb

from fairlead.llm import topk


def _same_as_sql(spark, tmp_path, rows):
    folder = f"{tmp_path}/sf"
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet/*.parquet')")
    want = sorted(con.execute(topk.OP1_SQL).fetchall())
    got = sorted(tuple(r) for r in topk.op1_pivot_topk(spark, folder).collect())
    assert got == want
    return got


def test_every_row_is_a_candidate(spark, tmp_path):
    draw = random.Random(5)
    vector = lambda n: [round(draw.uniform(-1, 1), 2) for _ in range(n)]
    rows = [(i, vector(draw.choice([6, 6, 6, 4, 9]))) for i in range(300)]
    best = vector(6)
    rows += [(7, [9.0] * 6)] * 20 + [(50, best)] * 3 + [(51, best)] * 2 + [(2**60 + 1, best), (2**60 + 3, best)]
    rows += [(8, [8.0 + i / 100] * 6) for i in range(30)]  # one id with many vectors
    rows += [(200, [5.0] * 6)] * 12 + [(201, [5.0] * 6)]
    rows += [(None, best), (400, None), (450, []), (500, [1.0, None]), (550, [float("nan")]), (600, [float("inf"), 1.0])]
    got = _same_as_sql(spark, tmp_path, rows)
    assert [r[2] for r in got if r[0] == 0][:5] == [7] * 5
    assert not {400, 450, 500, 550, 600} & {r[0] for r in got}


def test_zero_vectors_and_ties_go_to_smaller_ids(spark, tmp_path):
    got = _same_as_sql(spark, tmp_path, [(i, [0.0, 0.0]) for i in range(120)])
    assert [r[2] for r in got if r[0] == 100] == [0, 1, 2, 3, 4]
