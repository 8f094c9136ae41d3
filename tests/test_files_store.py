"""Inferred CSV types, the bucketed store, assigned ids, nested runs, questions without vectors."""

import os
import re

import pytest
from pyspark.sql import functions as F

from storecast.plans import records as rc
from storecast.plans import search as se
from storecast.sources import files
from storecast.streaming import counters as sc


def test_inferred_types_see_the_whole_file(spark, tmp_dir):
    path = os.path.join(tmp_dir, "t.csv")
    lines = ["id,late,dec,day,flag,name,none,mixed,big,sci"]
    lines += [f"{i},{i},{i}.5,2017-01-{1 + i % 28:02d},{'True' if i % 2 else 'false'},CAFÉ,NA,{i},{i},{i}e3" for i in range(500)]
    lines += ["500,x1,7,NA,,Ñandú,,2017-01-01,99999999999999999999,-.5"]
    with open(path, "w", encoding="latin-1") as f:
        f.write("\n".join(lines) + "\n")
    got = {f.name: f.dataType.simpleString() for f in files.inferred_schema(spark, path, "ISO-8859-1").fields}
    assert got == {"id": "bigint", "late": "string", "dec": "double", "day": "date", "flag": "boolean", "name": "string",
                   "none": "double", "mixed": "string", "big": "double", "sci": "double"}
    rows = files.read_csv_inferred(spark, path, "ISO-8859-1").orderBy("id").collect()
    assert rows[500].name == "Ñandú" and rows[500].day is None and rows[500].flag is None and rows[500].late == "x1"
    assert rows[3].dec == 3.5 and rows[3].none is None and rows[3].flag is True and rows[500].big == 1e20
    # The same types as a full read by pandas, where it has them.
    import pandas as pd
    full = pd.read_csv(path, encoding="latin-1")
    assert str(full["id"].dtype) == "int64" and str(full["dec"].dtype) == "float64" and full["late"].dtype == object


def _parts(path):
    out = {}
    for folder, _, names in os.walk(path):
        hit = re.search(r"bucket=(\d+)", folder)
        if hit:
            out[int(hit.group(1))] = {n for n in names if n.endswith(".parquet")}
    return out


def test_upsert_rewrites_only_touched_buckets(spark, tmp_dir):
    path = os.path.join(tmp_dir, "store")
    index = spark.createDataFrame([(f"v{i}", [float(i)], 0) for i in range(200)], "id string, values array<double>, v int")
    rc.create_store(index, path, buckets=8)
    before = _parts(path)
    assert all(len(f) == 1 for f in before.values())
    batch = spark.createDataFrame([("v3", [1.0], 5), ("v3", [2.0], 6), ("new", [3.0], 1)], index.schema)
    touched = rc.upsert_store(spark, path, batch, "v", os.path.join(tmp_dir, "staging"), buckets=8)
    after = _parts(path)
    assert 1 <= len(touched) <= 2
    assert {b for b in before if before[b] != after[b]} == set(touched)
    rows = {r.id: r["values"] for r in rc.read_store(spark, path).collect()}
    assert len(rows) == 201 and rows["v3"] == [2.0] and rows["new"] == [3.0] and rows["v4"] == [4.0]
    # Repeating an upsert changes nothing; an empty one touches nothing.
    rc.upsert_store(spark, path, batch, "v", os.path.join(tmp_dir, "staging"), buckets=8)
    assert rc.read_store(spark, path).count() == 201
    assert rc.upsert_store(spark, path, batch.limit(0), "v", os.path.join(tmp_dir, "staging"), buckets=8) == []
    rc.delete_store(spark, path)
    assert rc.read_store(spark, path).count() == 0 and rc.read_store(spark, path).columns == index.columns


def test_assigned_ids_are_gap_free_over_appends_and_failures(spark, tmp_dir):
    src = os.path.join(tmp_dir, "src")
    schema = "date string, store_nbr string, family string, sales string, onpromotion string"
    rows = spark.createDataFrame([(f"2024-01-{1 + i % 9:02d}", "1", f"f{i}", "1", "0") for i in range(40)], schema).repartition(5)
    order = ["date", "family"]
    assert sc.append_assigned(spark, rows, src, order) == (0, 40)
    assert sc.append_assigned(spark, rows.limit(7), src, order) == (40, 47)
    # An append whose rows arrived but whose commit did not.
    spark.createDataFrame([(47, "2024-01-01", "1", "x", "1", "0")], sc.ev.WIRE_SCHEMA).write.mode("append").parquet(src)
    assert sc.append_assigned(spark, rows.limit(3), src, order) == (48, 51)
    got = [r.msg_id for r in spark.read.parquet(src).collect()]
    assert sorted(got) == list(range(51))
    first = spark.read.parquet(src).where("msg_id < 40").orderBy("msg_id").collect()
    assert [(r.date, r.family) for r in first] == sorted((r.date, r.family) for r in first)
    # The stream reads the appended files only, not the commits.
    root = os.path.join(tmp_dir, "out")
    sc.run_once(spark, src, root)
    assert sc.read_buffer(spark, root).count() == 51


def test_nested_runs_roll_up_and_cycles_are_named(spark, tmp_dir):
    path = os.path.join(tmp_dir, "runs")
    files.log_run(spark, path, "root", {"mae": 1.0})
    files.log_run(spark, path, "a", {"mae": 2.0}, parent_id="root")
    files.log_run(spark, path, "a1", {"mae": 4.0, "n": 3}, parent_id="a")
    files.log_run(spark, path, "a1", {"depth": 10}, kind="param", parent_id="a")
    files.log_run(spark, path, "orphan", {"mae": 8.0}, parent_id="gone")
    files.log_run(spark, path, "c1", {"mae": 16.0}, parent_id="c2")
    files.log_run(spark, path, "c2", {"mae": 32.0}, parent_id="c1")
    runs = files.read_runs(spark, path)
    tree = {r.run_id: (r.root_id, r.depth) for r in files.run_tree(runs).collect()}
    assert tree == {"root": ("root", 0), "a": ("root", 1), "a1": ("root", 2), "orphan": ("orphan", 0),
                    "c1": (None, None), "c2": (None, None)}
    total = {(r.run_id, r.name): r.total for r in files.metric_rollup(runs).collect()}
    assert total == {("root", "mae"): 7.0, ("a", "mae"): 6.0, ("a1", "mae"): 4.0, ("root", "n"): 3.0, ("a", "n"): 3.0,
                     ("a1", "n"): 3.0, ("orphan", "mae"): 8.0}


def test_questions_without_a_vector_are_answered(spark):
    index = spark.createDataFrame([(f"r{i}", [1.0, float(i)], i, "fam", None, f"text {i}") for i in range(5)],
                                  "id string, values array<double>, store_nbr int, family string, date date, text string")
    questions = spark.createDataFrame([(1, "What about store 3?", [1.0, 0.5]), (2, "What about store 3?", None), (3, "Hi", None)],
                                      "qid long, text string, qvec array<double>")
    got = {r.qid: r for r in se.answer_table(questions, index).collect()}
    assert got[1].prompt and got[2].prompt is None and "store_nbr" in got[2].message and got[3].message
    # The cells carry ids and vectors only.
    plan = se.retrieve(questions, index)._jdf.queryExecution().optimizedPlan().toString()
    cells = [line for line in plan.splitlines() if "CoGroup" in line]
    assert cells and all("text#" not in line for line in cells)
