"""Hand-made fixtures with hand-computed results (FIXTURES.md section 3)."""

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from storecast.functions.calendar import parse_date, period_key
from storecast.functions.text import (currency, question_date, question_store, record_id,
                                      record_text, signed_percent, store_from_label, store_label)
from storecast.operators import encode, fill
from storecast.operators.events import counter_rollup, flat_to_map, valid_events, with_defaults
from storecast.operators.scenario import impact, promo_uplift


def d(s):
    return dt.date.fromisoformat(s)


def test_oil_resample_keeps_observed_nulls(spark):
    rows = [(d("2024-01-01"), None), (d("2024-01-02"), 93.1), (d("2024-01-04"), None),
            (d("2024-01-07"), 93.2), (d("2024-01-09"), 95.0)]
    oil = spark.createDataFrame(rows, "date date, dcoilwtico double")
    got = [r.dcoilwtico for r in fill.resample_daily_ffill(oil).orderBy("date").collect()]
    assert got == [None, 93.1, 93.1, None, None, None, 93.2, 93.2, 95.0]


def test_fill_over_dates_ffill_then_bfill(spark):
    daily = spark.createDataFrame([(d("2024-01-03"), 5.0), (d("2024-01-04"), None),
                                   (d("2024-01-05"), 7.0)], "date date, dcoilwtico double")
    facts = spark.createDataFrame([(d(x),) for x in ["2024-01-01", "2024-01-03", "2024-01-04",
                                                      "2024-01-06", "2024-01-06"]], "date date")
    got = {r.date: r.dcoilwtico for r in fill.fill_over_dates(facts, daily).collect()}
    # first fact date before oil -> back-filled; 01-04 null -> forward-filled; 01-06 is past
    # the oil series, so it carries the previous *fact* date's value (01-05 is not a fact date)
    assert got == {d("2024-01-01"): 5.0, d("2024-01-03"): 5.0, d("2024-01-04"): 5.0,
                   d("2024-01-06"): 5.0}


def test_date_strings(spark):
    vals = ["2024-1-5", "2024-01-05", "2024-02-30", " 2024-01-05", "2024-01-05 10:00"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r.p for r in df.select(parse_date(F.col("s")).alias("p")).collect()]
    assert got == [d("2024-01-05"), d("2024-01-05"), None, None, None]


def test_week_keys(spark):
    df = spark.createDataFrame([(d("2017-01-01"),), (d("2016-01-01"),), (d("2017-12-31"),)], "d date")
    got = [r.k for r in df.select(period_key("weekly", F.col("d")).alias("k")).collect()]
    assert got == ["2017-W01", "2016-W00", "2017-W53"]


def test_week_keys_match_python_strftime(spark):
    rng = random.Random(7)
    days = [dt.date(2010, 1, 1) + dt.timedelta(days=rng.randrange(6000)) for _ in range(400)]
    df = spark.createDataFrame([(x,) for x in days], "d date")
    got = df.select("d", period_key("weekly", F.col("d")).alias("w"),
                    period_key("monthly", F.col("d")).alias("m")).collect()
    for r in got:
        assert r.w == r.d.strftime("%Y-W%U") and r.m == r.d.strftime("%Y-%m")


def test_promo_uplift_exactly_one(spark):
    df = spark.createDataFrame([(Decimal("10.00"), 0), (Decimal("10.00"), 1), (Decimal("10.00"), 2)],
                               "s decimal(18,2), p int")
    got = [r.u for r in df.select(promo_uplift(F.col("s"), F.col("p")).alias("u")).collect()]
    assert got == [Decimal("10.00"), Decimal("15.00"), Decimal("10.00")]


def test_impact_zero_base(spark):
    df = spark.createDataFrame([(0.0, 5.0)], "total_base double, total_scenario double")
    r = impact(df).collect()[0]
    assert r.diff == 5.0 and r.pct == 0


def test_question_filters(spark):
    df = spark.createDataFrame([("Sales in Store  25 on 2017-12-25?",), ("nothing here",),
                                ("store 7 and store 9",)], "q string")
    got = df.select(question_store(F.col("q")).alias("s"), question_date(F.col("q")).alias("d")).collect()
    assert (got[0].s, got[0].d) == (25, "2017-12-25")
    assert (got[1].s, got[1].d) == (None, None)
    assert got[2].s == 7


def test_codes_with_null(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "family string")
    codes = encode.fit_codes(df, ["family"], materialize=False)
    got = {r.value: r.code for r in codes.collect()}
    assert got == {"a": 0, "b": 1, "nan": 2}
    enc = encode.apply_codes(df, codes, ["family"], checked_broadcast=False)
    assert sorted(r.family_encoded for r in enc.collect()) == [0, 1, 1, 2]


def test_strict_codes_raise_on_unseen(spark):
    import pytest
    codes = encode.fit_codes(spark.createDataFrame([("a",)], "family string"), ["family"],
                             materialize=False)
    new = spark.createDataFrame([("zzz",)], "family string")
    with pytest.raises(Exception):
        encode.apply_codes(new, codes, ["family"], strict=True, checked_broadcast=False).collect()


def test_record_text_and_id(spark):
    df = spark.createDataFrame(
        [(d("2017-08-15"), 25, "Quito", "GROCERY I", Decimal("2.6750"), 1),
         (d("2017-08-15"), 3, None, "BREAD/BAKERY", Decimal("0.1250"), 0)],
        "date date, store int, city string, family string, sales decimal(18,4), promo int")
    out = df.select(record_text(F.col("date"), F.col("store"), F.col("city"), F.col("family"),
                                F.col("sales"), F.col("promo")).alias("t"),
                    record_id(F.col("date"), F.col("store"), F.col("family"), F.lit(7)).alias("i")).collect()
    assert out[0].t == "On 2017-08-15, Store 25 in Quito sold GROCERY I with sales of $2.68 (on promotion)"
    assert out[1].t == "On 2017-08-15, Store 3 sold BREAD/BAKERY with sales of $0.13"
    assert out[0].i == "2017-08-15_25_GROCERY_I_7"


def test_formats(spark):
    df = spark.createDataFrame([(1234.5, 12.25), (0.0, -4.0)], "v double, p double")
    got = df.select(currency(F.col("v")).alias("c"), signed_percent(F.col("p")).alias("p")).collect()
    assert [(r.c, r.p) for r in got] == [("$1,234.50", "+12.3%"), ("$0.00", "-4.0%")]
    lab = spark.createDataFrame([(5, "Quito")], "s int, c string").select(
        store_label(F.col("s"), F.col("c")).alias("l"))
    assert lab.select(store_from_label(F.col("l"))).collect()[0][0] == 5


def test_event_checks_and_rollup(spark):
    rows = [(1, "2017-01-01", "1", "A", "10.5", "0"),
            (2, "2017-01-02", "1", "A", None, "1"),       # missing sales -> 0
            (3, "2017-01-02", None, "A", "2", "0"),       # missing store -> '?'
            (4, "2017-13-01", "1", "A", "5", "0"),         # bad date
            (5, "2017-01-03", "1", "", "5", "0"),          # empty family
            (6, "2017-01-03", "1", "A", "abc", "0")]       # poison sales -> quarantined
    w = spark.createDataFrame(rows, "msg_id long, date string, store_nbr string, family string, "
                                    "sales string, onpromotion string")
    assert sorted(r.msg_id for r in valid_events(w).collect()) == [1, 2, 3]
    assert with_defaults(w).where("msg_id = 3").collect()[0].store == "?"
    got = {(r.grain, r.period): r.value for r in counter_rollup(valid_events(w)).collect()}
    assert got[("daily", "2017-01-02")] == Decimal("2.00")
    assert got[("weekly", "2017-W01")] == Decimal("12.50")
    assert got[("monthly", "2017-01")] == Decimal("12.50")


def test_flat_to_map(spark):
    df = spark.createDataFrame([(["date", "2024-01-01", "family", "A"],)], "f array<string>")
    m = df.select(flat_to_map(F.col("f")).alias("m")).collect()[0].m
    assert m == {"date": "2024-01-01", "family": "A"}


def test_three_way_split(spark):
    from storecast.plans.features import with_split
    df = spark.createDataFrame([(d(x),) for x in ["2000-12-31", "2001-01-01", "2001-05-31",
                                                  "2001-06-01", "2001-07-01"]], "date date")
    two = [r.split for r in with_split(df, "2001-01-01").orderBy("date").collect()]
    assert two == ["train", "validate", "validate", "validate", "validate"]
    three = [r.split for r in with_split(df, "2001-01-01", "2001-06-01").orderBy("date").collect()]
    assert three == ["train", "validate", "validate", "test", "test"]


def test_broadcast_check_bounds_rows_and_bytes(spark):
    from storecast.operators import joins
    side = spark.createDataFrame([(i, f"s{i}") for i in range(50)], "k int, v string")
    assert joins.broadcast_if_small(side) is not side                  # small: hinted
    assert joins.broadcast_if_small(side, max_rows=10) is side         # too many rows
    w = joins.row_bytes(side.schema)
    assert joins.broadcast_if_small(side, max_bytes=w * 49) is side    # too many bytes
    assert joins.broadcast_if_small(side, max_bytes=w * 50) is not side


def test_transaction_join_same_with_or_without_broadcast(spark):
    from storecast.operators import joins
    fact = spark.createDataFrame([(d("2024-01-01"), 1, 5), (d("2024-01-01"), 2, 6),
                                  (d("2024-01-02"), 1, 7), (d("2024-01-03"), 3, 8)],
                                 "date date, store_nbr int, x int")
    tx = spark.createDataFrame([(d("2024-01-01"), 1, 100), (d("2024-01-02"), 1, 50),
                                (d("2024-01-03"), 9, 1)], "date date, store_nbr int, transactions int")
    a = sorted(tuple(r) for r in joins.join_transactions(fact, tx, checked=True).collect())
    b = sorted(tuple(r) for r in joins.join_transactions(fact, tx, checked=False).collect())
    assert a == b
    assert [r[-1] for r in a] == [100, 0, 50, 0]
