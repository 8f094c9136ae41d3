"""One question at a time, against the batch answer table and brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from storecast.plans import search as se

INDEX = "id string, `values` array<float>, date date, store_nbr int, family string, text string"


def _index(spark):
    import datetime as dt
    rng = np.random.default_rng(4)
    rows = [(f"v{i}", [float(x) for x in rng.normal(size=8).astype("float32")], dt.date(2001, 7, 1 + i % 20), i % 7,
             f"F{i % 3}", f"record {i}") for i in range(200)]
    rows += [("w0", rows[0][1], rows[0][2], 0, "F9", "a tie"), ("z", [0.0] * 8, None, None, None, "no length"),
             ("n", None, None, 1, "F1", "no vector")]
    return rows, spark.createDataFrame(rows, INDEX)


def test_search_one_equals_brute_force(spark):
    rows, index = _index(spark)
    q = [0.5, -1.0, 0.25, 2.0, 0.0, 1.0, -0.5, 0.75]

    def cosine(v):
        n = math.sqrt(sum(x * x for x in v))
        return sum(x * y for x, y in zip(v, q)) / (n * math.sqrt(sum(x * x for x in q))) if n else 0.0

    for store, date in ((None, None), (0, None), (None, "2001-07-01"), (0, "2001-07-01"), (99, None), (None, "2001-99-99")):
        want = sorted((-cosine(r[1]), r[0]) for r in rows if r[1] is not None and (store is None or r[3] == store)
                      and (date is None or str(r[2]) == date))[:5]
        got = se.search_one(index, q, 5, store, date)
        assert [g["id"] for g in got] == [i for _, i in want]
        assert np.allclose([g["score"] for g in got], [-s for s, _ in want])
        assert all(g["text"] == next(r[5] for r in rows if r[0] == g["id"]) for g in got)


def test_answer_one_equals_the_table(spark):
    _, index = _index(spark)
    vec = [1.0, 0.0, 2.0, 0.0, -1.0, 0.5, 0.0, 0.25]
    questions = [(1, "Which sold best?", vec), (2, "What about store 3?", vec), (3, "What about store 88?", vec),
                 (4, "Sales in Store 2 on 2001-07-03?", vec), (5, "What sold on 2001-01-01?", vec), (6, "No vector", None),
                 (7, "No vector, store 4", None)]
    df = spark.createDataFrame(questions, "qid long, text string, qvec array<float>")
    want = {r.qid: (r.prompt, r.message) for r in se.answer_table(df, index).collect()}
    for qid, text, qvec in questions:
        rows = se.answer_one(index, qid, text, qvec).collect()
        assert [(r.qid, r.prompt, r.message) for r in rows] == [(qid, *want[qid])]


def test_answer_one_of_an_empty_index(spark):
    _, index = _index(spark)
    row = se.answer_one(index.limit(0), 1, "What about store 3?", [1.0] * 8).first()
    assert row.prompt is None and row.message.startswith(se.NO_RECORDS_HEAD)


def test_filters_and_ids_reach_the_scan(spark, tmp_path):
    _, index = _index(spark)
    index.write.parquet(str(tmp_path / "index"))
    stored = spark.read.parquet(str(tmp_path / "index"))
    plan = stored.where(F.col("store_nbr") == 3).where(F.col("id").isin(["v1", "v2"])).select("id") \
        ._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(store_nbr,3)" in plan and "In(id, [v1,v2])" in plan
