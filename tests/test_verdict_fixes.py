"""Cases the fixtures do not reach."""

import os

import pytest
from pyspark.sql import functions as F

from storecast.functions.text import question_store
from storecast.models import trees, trend
from storecast.operators.events import sales_ok
from storecast.plans import records as rc
from storecast.sources import files
from storecast.streaming import counters as sc


def test_csv_columns_go_by_header(spark, tmp_dir):
    path = os.path.join(tmp_dir, "sales.csv")
    with open(path, "w") as f:
        f.write("id,date,store_nbr,family,sales,onpromotion\n1,2017-01-02,7,BREAD,1.5,0\n2,bad,8,EGGS,x,1\n")
    rows = files.read_csv(spark, path, files.SALES_SCHEMA).orderBy("store_nbr").collect()
    assert (str(rows[0].date), rows[0].store_nbr, rows[0].family, rows[0].sales) == ("2017-01-02", 7, "BREAD", 1.5)
    assert rows[1].date is None and rows[1].sales is None
    bad = files.csv_rejects(spark, path, files.SALES_SCHEMA).collect()
    assert [(r.id, r.bad_columns) for r in bad] == [("2", ["date", "sales"])]


def test_store_number_beyond_int_stays_a_filter(spark):
    df = spark.createDataFrame([("store 99999999999",), ("store 12",), ("hello",)], "q string")
    assert [r[0] for r in df.select(question_store(F.col("q"))).collect()] == [-1, 12, None]


def test_upsert_last_version_wins(spark):
    idx = spark.createDataFrame([("a", 0)], "id string, v int")
    new = spark.createDataFrame([("a", i) for i in range(1, 9)], "id string, v int").repartition(8)
    assert [r.v for r in rc.upsert(idx, new, order_col="v").collect()] == [8]
    with pytest.raises(TypeError):
        rc.upsert(idx, new)


def test_sales_out_of_range_are_rejected(spark):
    df = spark.createDataFrame([("1e30",), ("NaN",), ("Infinity",), ("abc",), ("1.25",), (None,)], "sales string")
    assert [r[0] for r in df.select(sales_ok()).collect()] == [False, False, False, False, True, True]


def test_drain_returns_late_ids(spark, tmp_dir):
    def put(ids):
        spark.createDataFrame([(i, "x") for i in ids], "msg_id long, payload string") \
             .write.mode("append").parquet(os.path.join(tmp_dir, "buffer"))
    put([8, 9, 10])
    fresh, marks = sc.drain_buffer(spark, tmp_dir)
    assert sorted(r.msg_id for r in fresh.collect()) == [8, 9, 10]
    sc.commit_mark(fresh, marks)
    put([7])
    assert [r.msg_id for r in sc.drain_buffer(spark, tmp_dir)[0].collect()] == [7]


def test_backtest_keeps_series_without_history(spark):
    days = [f"2017-01-{d:02d}" for d in range(1, 29)]
    rows = [("old", d, float(i), 50.0, 0) for i, d in enumerate(days)] + [("new", d, 1.0, 50.0, 0) for d in days[20:]]
    df = spark.createDataFrame(rows, "series string, ds string, y double, dcoilwtico double, is_holiday int") \
              .withColumn("ds", F.col("ds").cast("date"))
    out = {r.series: (r.mae, r.n_val) for r in trend.backtest(df, "2017-01-20").collect()}
    assert out["new"][0] is None and out["new"][1] == 8 and out["old"][0] is not None


def test_unseen_label_is_not_scored(spark):
    cols = {c: F.lit(1.0) for c in trees.FEATURES}
    df = spark.range(40).select("id", *[v.alias(c) for c, v in cols.items()],
                                F.col("id").cast("double").alias("sales"))
    model = trees.fit(df, 2, 0.3, 2)
    out = trees.score(model, df.withColumn("family_encoded", F.when(F.col("id") > 0, F.lit(1.0))).where("id < 2"))
    got = {r.id: (r.prediction, r.reason) for r in out.collect()}
    assert got[0] == (None, "unseen family") and got[1][0] is not None and got[1][1] is None
