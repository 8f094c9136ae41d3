"""Newest-N cuts below the row count, skewed keys, and the exact draw."""

import datetime as dt
import hashlib
import random

from pyspark.sql import functions as F

from storecast.operators.ordering import latest_n, newest_by_key
from storecast.operators.sample import draw_with_replacement


def test_newest_by_key_with_skewed_ids(spark):
    ids = list(range(500)) + [10_000_000 + 7 * i for i in range(40)] + [-5]
    df = spark.createDataFrame([(i,) for i in ids], "msg_id long").repartition(5)
    for keep in (1, 39, 40, 41, 300, len(ids), len(ids) + 9):
        got = sorted(r.msg_id for r in newest_by_key(df, keep, "msg_id", ranges=8).collect())
        assert got == sorted(ids)[-keep:]


def test_newest_of_nothing(spark):
    df = spark.createDataFrame([], "msg_id long, d date")
    assert newest_by_key(df, 5, "msg_id").count() == 0
    assert latest_n(df, 5, "d", ["msg_id"]).count() == 0


def test_renumber_after_a_cut_inside_a_day(spark):
    day = dt.date(2020, 1, 1)
    rows = [(i, day + dt.timedelta(days=i % 3)) for i in range(90)] + [(900, None)]
    df = spark.createDataFrame(rows, "k long, d date").repartition(4)
    want = sorted((r for r in rows if r[1]), key=lambda r: (r[1], r[0]))[-45:]
    got = {r.k: r.idx for r in latest_n(df, 45, "d", ["k"]).collect()}
    assert got == {k: i for i, (k, _) in enumerate(want)}


def test_draw_is_exact_and_independent_of_partitions(spark):
    rng = random.Random(4)
    keys = [f"row-{i}" for i in range(700)]
    df = spark.createDataFrame([(k, rng.random()) for k in keys], "k string, v double")
    n = 300
    order = sorted(keys, key=lambda k: hashlib.md5(k.encode()).hexdigest())
    want = [(i, order[int(hashlib.md5(f"7-{i}".encode()).hexdigest()[:15], 16) % len(keys)]) for i in range(n)]
    for parts in (1, 6):
        got = draw_with_replacement(df.repartition(parts), F.col("k"), n, seed=7).select("draw", "k").collect()
        assert sorted(map(tuple, got)) == want
    assert draw_with_replacement(df.where("false"), F.col("k"), n, seed=7).count() == 0
    assert draw_with_replacement(df, F.col("k"), 0, seed=7).count() == 0
