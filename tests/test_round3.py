"""Round 3: steps whose cost grew faster than their input."""

import datetime as dt
import os
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from storecast.models import boost
from storecast.operators import cellindex as ci
from storecast.operators import joins
from storecast.operators import scenario as sc
from storecast.operators.sample import draw_with_replacement
from storecast.operators.topk import _top_in_cell
from storecast.plans import features as ft
from storecast.sources import fixtures as fx
from tests.test_cellindex import brute


def test_blocks_are_dealt_over_the_cores(spark, monkeypatch):
    monkeypatch.setattr(boost, "BLOCK_ROWS", 20)
    rng = np.random.default_rng(1)
    rows = [(float(a), float(b), float(a > b)) for a, b in rng.normal(size=(700, 2))]
    df = spark.createDataFrame(rows, "a double, b double, sales double").repartition(3)
    p = boost.prepare(df, df.limit(0), 256, ("a", "b"))
    blocks = p.blocks.select("n", F.length("bins").alias("bins")).collect()
    assert p.parts == min(35, spark.sparkContext.defaultParallelism) and sum(b.n for b in blocks) == 700
    assert max(b.n for b in blocks) == 20 and all(b.bins == 2 * b.n for b in blocks) and len(blocks) <= 35 + 3


def test_columns_are_read_as_the_vector_is(spark):
    tree = boost.Tree()
    left = tree.split(0, 1, 0, 2.5)
    tree.value[left], tree.value[left + 1] = -1.0, 4.0
    model = boost.BoostedModel(10.0, [tree], ("a", "b"))
    df = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, None)], "a int, b double")
    assert [r.prediction for r in model.transform_columns(df).orderBy("a").collect()] == [9.0, 14.0, 9.0]


def test_keys_grow_with_stores_and_families_not_with_their_pairs(spark):
    day = dt.date(2001, 1, 1)
    facts = spark.createDataFrame([(day, s, f"F{f}") for s in range(40) for f in range(30)] + [(day, None, None)],
                                  "date date, store_nbr int, family string")
    keys = ft.fact_keys(facts)
    assert keys.count() == 1 + 41 + 31
    stores = spark.createDataFrame([(s, f"c{s % 7}", "s", "t") for s in range(50)], "store_nbr int, city string, state string, type string")
    got = {(r.col, r.value): r.code for r in ft.fit_feature_codes(None, keys, stores, materialize=False).collect()}
    values = [("family", [f"F{f}" for f in range(30)]), ("city", [f"c{c}" for c in range(7)]), ("state", ["s"]), ("type", ["t"])]
    assert got == {(c, v): i for c, vs in values for i, v in enumerate(sorted([*vs, "nan"]))}


def test_scenario_rows_come_from_one_grid(spark):
    grid = spark.createDataFrame([(1, dt.date(2001, 1, 1), 50.0, 7, 1, 0)],
                                 "store_nbr int, date date, oil double, scen_transactions int, scen_promo int, scen_holiday int")
    out = sc.scenario_features(grid)
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.branch, r.dcoilwtico, r.transactions, r.onpromotion) for r in out.collect()} == {
        ("scenario", 50.0, 7, 1), ("baseline", sc.BASELINE_OIL, sc.BASELINE_TRANSACTIONS, sc.BASELINE_PROMO)}


def test_a_large_transaction_side_is_joined_in_bounded_pieces(spark, monkeypatch):
    monkeypatch.setattr(joins, "broadcast_rows", lambda side, *_: 0)
    monkeypatch.setattr(joins, "SIDE_ROWS", 10)
    day = F.date_add(F.lit("2001-01-01").cast("date"), (F.col("id") % 20).cast("int"))
    side = spark.range(200).select(day.alias("date"), (F.col("id") / 20).cast("int").alias("store_nbr"), F.col("id").alias("transactions"))
    fact = spark.range(300).select(day.alias("date"), (F.col("id") / 20).cast("int").alias("store_nbr"), F.col("id").alias("n"))
    out = joins.join_transactions(fact, side)
    assert "RepartitionByExpression [date" in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.n, r.transactions) for r in out.collect()} == {(i, i if i < 200 else 0) for i in range(300)}


def test_transactions_of_a_large_table_are_counted_in_bounded_pieces(spark, monkeypatch):
    t = SimpleNamespace(
        lineitem=spark.range(400).selectExpr("id div 4 l_orderkey", "id % 7 l_suppkey"),
        orders=spark.range(100).selectExpr("id o_orderkey", "date_add(date'2001-01-01', cast(id % 5 as int)) o_orderdate"))
    want = {tuple(r) for r in fx.r_transactions(t).collect()}
    monkeypatch.setattr(fx, "PART_ROWS", 20)
    out = fx.r_transactions(t)
    assert "RepartitionByExpression [l_orderkey" in out._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in out.collect()} == want


def test_cells_split_their_queries_too(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(ci, "QBLOCK_ROWS", 4)
    monkeypatch.setattr(ci, "CHUNK_SCORES", 50)
    rng = np.random.default_rng(5)
    rows = [(f"r{i:03d}", v.tolist()) for i, v in enumerate(rng.normal(size=(200, 6)))]
    rows += [(f"s{i}", rows[3][1]) for i in range(40)] + [("z", [0.0] * 6)]
    queries = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(30, 6)))] + [(90, rows[3][1]), (91, [0.0] * 6)]
    corpus = spark.createDataFrame(rows, "id string, values array<double>")
    asked = spark.createDataFrame(queries, "qid long, qvec array<double>")
    index = ci.build(corpus, ci.fit_centroids(corpus, 3), os.path.join(tmp_dir, "cells"))
    found, _ = ci.search(index, asked, 5, block_rows=60)
    assert {(r.qid, r["rank"], r.id) for r in found.collect()} == brute(rows, queries, 5)


def test_scores_held_at_once_are_bounded():
    rng = np.random.default_rng(2)
    q = pd.DataFrame({"qid": range(2048), "qvec": list(rng.normal(size=(2048, 8))), "f": [None] * 2048})
    c = pd.DataFrame({"id": [f"{i:05d}" for i in range(4096)], "values": list(rng.normal(size=(4096, 8))), "g": 0})
    tracemalloc.start()
    _top_in_cell(5, [("f", "g")], [])(q, c)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 << 20


@pytest.mark.parametrize("n", [40])
def test_draw_ranks_keys_only_and_does_not_depend_on_partitions(spark, n):
    rows = spark.range(120).select((F.col("id") % 50).alias("k"), F.col("id").alias("v"), F.lit("x" * 20).alias("wide"))
    draws = [draw_with_replacement(rows.repartition(p), F.col("k").cast("string"), n, 7) for p in (1, 5)]
    a, b = ({(r.draw, r.k, r.v) for r in d.collect()} for d in draws)
    assert a == b and len({x[0] for x in a}) == n == len(a)
    assert "row_number() windowspecdefinition(_b" not in draws[0]._jdf.queryExecution().optimizedPlan().toString()
