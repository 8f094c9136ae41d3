"""Streaming job (batch twin, restart, late rows), models and persisted tables."""

import datetime as dt
import os

import numpy as np
from pyspark.sql import functions as F

from storecast.models import trees, trend
from storecast.operators.events import counter_rollup, valid_events
from storecast.plans import records as rc
from storecast.sources import files
from storecast.streaming import counters as sc

WIRE = "msg_id long, date string, store_nbr string, family string, sales string, onpromotion string"


def _events(spark, rows):
    return spark.createDataFrame(rows, WIRE)


def _as_set(df):
    return {(r.grain, r.family, r.period, r.value) for r in df.collect()}


def test_stream_equals_batch_and_restart_adds_nothing(spark, tmp_dir):
    src, root = os.path.join(tmp_dir, "src"), os.path.join(tmp_dir, "out")
    a = [(i, f"2024-01-{1 + i % 9:02d}", "3", "A" if i % 2 else "B", f"{i}.25", "0") for i in range(40)]
    b = [(100 + i, f"2024-02-{1 + i % 5:02d}", "4", "A", "1.00", "1") for i in range(20)]
    b += [(200, "2024-13-40", "1", "A", "1", "0"), (201, "2024-01-01", "1", None, "2", "0"),
          (202, "2024-01-01", "1", "A", "abc", "0")]
    sc.append_events(_events(spark, a), src)
    sc.run_once(spark, src, root)
    sc.append_events(_events(spark, b), src)
    sc.run_once(spark, src, root)
    sc.run_once(spark, src, root)                       # nothing new: no change
    stream = _as_set(sc.read_counters(spark, root))
    batch = _as_set(counter_rollup(valid_events(_events(spark, a + b))))
    assert stream == batch
    assert sc.read_buffer(spark, root).count() == 60
    rej = spark.read.parquet(os.path.join(root, "rejects"))
    assert {r.reason for r in rej.collect()} == {"bad_date", "missing_key", "bad_sales"}


def test_watermark_drops_late_rows(spark, tmp_dir):
    src, root = os.path.join(tmp_dir, "src"), os.path.join(tmp_dir, "out")
    sc.append_events(_events(spark, [(1, "2024-03-10", "1", "A", "5", "0")]), src)
    sc.run_once(spark, src, root, watermark="1 day")
    sc.append_events(_events(spark, [(2, "2024-03-01", "1", "A", "7", "0"),
                                     (3, "2024-03-10", "1", "A", "1", "0")]), src)
    sc.run_once(spark, src, root, watermark="1 day")
    got = {(r.day.isoformat(), r.value) for r in sc.read_daily(spark, root).collect()}
    assert ("2024-03-10", 6) in {(d, int(v)) for d, v in got}
    assert all(d != "2024-03-01" for d, _ in got)


def test_buffer_drain_high_mark(spark, tmp_dir):
    src, root = os.path.join(tmp_dir, "src"), os.path.join(tmp_dir, "out")
    sc.append_events(_events(spark, [(i, "2024-01-01", "1", "A", "1", "0") for i in range(5)]), src)
    sc.run_once(spark, src, root)
    fresh, marks = sc.drain_buffer(spark, root)
    assert fresh.count() == 5
    sc.commit_mark(fresh, marks)
    sc.append_events(_events(spark, [(9, "2024-01-02", "1", "A", "1", "0")]), src)
    sc.run_once(spark, src, root)
    fresh2, _ = sc.drain_buffer(spark, root)
    assert [r.msg_id for r in fresh2.collect()] == [9]


def test_best_round_patience():
    assert trees.best_round([5, 4, 3, 3.5, 3.6, 3.7, 2.0], patience=3) == 2
    assert trees.best_round([5, 4, 3, 2, 1], patience=2) == 4


def test_gbt_beats_mean_and_roundtrips(spark, tmp_dir):
    rng = np.random.default_rng(1)
    n = 3000
    rows = []
    for i in range(n):
        promo = int(rng.integers(0, 2))
        dow = int(rng.integers(0, 7))
        rows.append((i, 10.0 + 20 * promo + 3 * dow + float(rng.normal()), promo, dow))
    df = spark.createDataFrame(rows, "store_nbr long, sales double, onpromotion int, day_of_week int")
    for c in trees.FEATURES:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(0))
    train, val = df.where("store_nbr < 2400"), df.where("store_nbr >= 2400")
    model, errors, best = trees.fit_early_stop(train, val, 8, 0.5, 4, patience=3)
    scored = trees.score(model, val)
    mae = trees.mae(scored)
    mean = train.agg(F.avg("sales")).collect()[0][0]
    base = val.agg(F.avg(F.abs(F.col("sales") - mean))).collect()[0][0]
    assert mae < base / 3 and len(errors) == 8 and 0 <= best < 8
    path = os.path.join(tmp_dir, "gbt")
    trees.save(model, path)
    again = trees.score(trees.load(path), val).agg(F.sum("prediction")).collect()[0][0]
    assert abs(again - scored.agg(F.sum("prediction")).collect()[0][0]) < 1e-6


def test_trend_recovers_seasonal_series(spark, tmp_dir):
    start = dt.date(2015, 1, 1)
    rows = []
    for s, (lvl, slope, amp) in {"a": (100, 0.05, 10), "b": (50, -0.01, 3)}.items():
        for i in range(900):
            day = start + dt.timedelta(days=i)
            y = lvl + slope * i + amp * np.sin(2 * np.pi * day.weekday() / 7)
            rows.append((s, day, float(y), 50.0, 0))
    df = spark.createDataFrame(rows, "series string, ds date, y double, dcoilwtico double, is_holiday int")
    bt = {r.series: r.mae for r in trend.backtest(df, "2017-01-01").collect()}
    assert bt["a"] < 1.0 and bt["b"] < 0.5
    coefs = trend.fit(df)
    path = os.path.join(tmp_dir, "trend")
    trend.save(coefs, path)
    fut = trend.future_frame(df.withColumn("y", F.col("y")), 7, by="series")
    pred = trend.predict(fut, trend.load(spark, path))
    assert pred.count() == 2 * 907
    r = pred.where("series = 'a'").orderBy(F.desc("ds")).first()
    assert r.yhat_lower <= r.yhat <= r.yhat_upper


def test_csv_codes_runlog_and_index_tables(spark, tmp_dir):
    p = os.path.join(tmp_dir, "train.csv")
    with open(p, "w", encoding="latin-1") as f:
        f.write("date,store_nbr,family,sales,onpromotion\n2017-01-01,1,CAFÉ,1.5,0\n2017-01-02,2,B,x,1\n")
    df = files.read_csv(spark, p, files.SALES_SCHEMA, encoding="ISO-8859-1").collect()
    assert df[0].family == "CAFÉ" and df[1].sales is None
    codes = spark.createDataFrame([("family", "a", 0)], files.CODES_SCHEMA)
    files.save_codes(codes, os.path.join(tmp_dir, "codes"))
    assert files.load_codes(spark, os.path.join(tmp_dir, "codes")).collect()[0].value == "a"
    files.log_run(spark, os.path.join(tmp_dir, "runs"), "r1", {"rows": 10}, kind="param")
    files.log_run(spark, os.path.join(tmp_dir, "runs"), "r2", {"mae": 1.5}, parent_id="r1")
    assert files.read_runs(spark, os.path.join(tmp_dir, "runs")).count() == 2
    idx = spark.createDataFrame([("a", [1.0, 0.0], 1), ("b", [0.0, 1.0], 1)],
                                "id string, values array<double>, v int")
    new = spark.createDataFrame([("a", [0.5, 0.5], 2), ("a", [0.6, 0.4], 3), ("c", [1.0, 1.0], 2)],
                                "id string, values array<double>, v int")
    up = {r.id: r.v for r in rc.upsert(idx, new, order_col="v").collect()}
    assert up == {"a": 3, "b": 1, "c": 2}
    st = rc.index_stats(rc.upsert(idx, new, order_col="v")).collect()[0]
    assert st.total_vectors == 3 and st.dimension == 2
    assert rc.empty_like(idx).count() == 0 and rc.empty_like(idx).schema == idx.schema
