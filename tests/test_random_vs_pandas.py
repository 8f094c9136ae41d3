"""Seeded random inputs: W1 (resample + forward fill), W2 (forward then back
fill over fact dates) and W3 (label codes) against plain pandas."""

import datetime as dt
import random

import numpy as np
import pandas as pd

from storecast.operators import encode, fill

START = dt.date(2020, 1, 1)


def _oil(rng):
    days = sorted(rng.sample(range(120), 40))
    vals = [None if rng.random() < 0.2 else round(rng.uniform(20, 120), 2) for _ in days]
    return [(START + dt.timedelta(days=k), v) for k, v in zip(days, vals)]


def _pandas_resample(oil):
    s = pd.DataFrame(oil, columns=["date", "v"])
    s["date"] = pd.to_datetime(s["date"])
    r = s.set_index("date").resample("D").ffill()
    return {k.date(): (None if pd.isna(v) else float(v)) for k, v in r["v"].items()}


def _pandas_fill(fact_dates, daily):
    f = pd.DataFrame({"date": pd.to_datetime(sorted(fact_dates))})
    o = pd.DataFrame([(pd.Timestamp(k), v) for k, v in daily.items()], columns=["date", "v"])
    m = f.merge(o, on="date", how="left")
    m["v"] = m["v"].astype(float).ffill().bfill()
    return {k.date(): (None if pd.isna(v) else float(v)) for k, v in zip(m["date"], m["v"])}


def test_resample_and_fill_match_pandas(spark):
    for seed in range(5):
        rng = random.Random(seed)
        oil = _oil(rng)
        df = spark.createDataFrame(oil, "date date, dcoilwtico double")
        daily = fill.resample_daily_ffill(df)
        got = {r.date: r.dcoilwtico for r in daily.collect()}
        want = _pandas_resample(oil)
        assert got == want, seed

        fact_dates = {START + dt.timedelta(days=rng.randrange(-10, 140)) for _ in range(60)}
        facts = spark.createDataFrame([(x,) for x in fact_dates], "date date")
        got_f = {r.date: r.dcoilwtico for r in fill.fill_over_dates(facts, daily).collect()}
        assert got_f == _pandas_fill(fact_dates, want), seed


def test_codes_match_sorted_position(spark):
    rng = np.random.default_rng(7)
    words = ["DAIRY", "BREAD", "BEVERAGES", "produce", "Eggs", "AUTOMOTIVE", None]
    fam = [words[i] for i in rng.integers(0, len(words), 500)]
    city = [None if rng.random() < 0.1 else f"C{int(x)}" for x in rng.integers(0, 30, 500)]
    df = spark.createDataFrame(list(zip(fam, city)), "family string, city string")
    codes = encode.fit_codes(df, ["family", "city"], materialize=False)
    enc = encode.apply_codes(df, codes, ["family", "city"], checked_broadcast=False)
    rows = enc.collect()
    for col in ("family", "city"):
        text = pd.Series([r[col] for r in rows]).astype(str).replace("None", "nan")
        classes = sorted(set(text))
        want = [classes.index(v) for v in text]
        assert [r[f"{col}_encoded"] for r in rows] == want
