"""Sparse trend changes and simulated intervals."""

import datetime as dt

import numpy as np
import pandas as pd

from storecast.models import changepoints as cp
from storecast.models import trend


def series(seed, days=900, breaks=((300, 0.08), (520, -0.15)), noise=1.0, name="s"):
    rng = np.random.default_rng(seed)
    d = np.arange(days)
    y = 50 + 0.02 * d + 3 * np.sin(2 * np.pi * d / 7) + rng.normal(0, noise, days)
    for at, slope in breaks:
        y = y + slope * np.maximum(d - at, 0)
    start = dt.date(2015, 1, 1)
    return [(name, start + dt.timedelta(days=int(i)), float(v), 50.0, 0) for i, v in zip(d, y)]


SCHEMA = "series string, ds date, y double, dcoilwtico double, is_holiday int"


def test_descent_reaches_the_minimum():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(80, 6)), rng.normal(size=80)
    absolute, square = np.array([0, 5.0, 5, 5, 0, 40]), np.full(6, 0.1)
    g, t = x.T @ x, x.T @ y
    b = cp.descend(g, t, absolute, square, np.zeros(6))
    assert cp.slack(g, t, absolute, square, b) < 1e-9 and b[5] == 0

    def cost(v):
        return v @ g @ v / 2 - t @ v + (absolute * np.abs(v)).sum() + (square * v * v).sum() / 2
    for _ in range(300):
        assert cost(b) <= cost(b + rng.normal(size=6) * rng.choice([1e-3, 0.1])) + 1e-12
    # Without the absolute penalty it is the solution of the normal equations.
    assert np.allclose(cp.descend(g, t, np.zeros(6), square, np.zeros(6)), np.linalg.solve(g + np.diag(square), t))


def test_planted_breaks_are_found_and_the_rest_is_zero(spark):
    rows = series(1, days=1825, breaks=((500, 0.08), (1000, -0.15)))
    c = cp.fit(spark.createDataFrame(rows, SCHEMA)).first()
    days = np.array(c.hinges) * c.t_days
    change = np.array(c.beta)[2:2 + trend.N_HINGES] * c.y_scale / c.t_days         # slope per day
    for at, slope in ((500, 0.08), (1000, -0.15)):
        near = np.abs(days - at) < 120
        assert abs(change[near].sum() - slope) < 0.02
    rest = np.abs(change[(np.abs(days - 500) >= 120) & (np.abs(days - 1000) >= 120)])
    assert rest.sum() < 0.1 * np.abs(change).sum() and c.n_changes < trend.N_HINGES
    assert c.slack < 1e-6 and 0.7 < c.sigma < 1.3


def test_intervals_cover_held_out_days_and_widen(spark):
    rows = sum((series(k, days=1860, breaks=((300, 0.03), (900, -0.04)), name=f"s{k}") for k in range(16)), [])
    df = spark.createDataFrame(rows, SCHEMA)
    cut = dt.date(2015, 1, 1) + dt.timedelta(days=1800)
    coefs = cp.fit(df.where(df.ds < cut)).checkpoint()
    p = cp.predict(df.where(df.ds >= cut), coefs).toPandas()
    j = p.merge(pd.DataFrame(rows, columns=["series", "ds", "y", "o", "h"]), on=["series", "ds"])
    share = ((j.y >= j.yhat_lower) & (j.y <= j.yhat_upper)).mean()
    assert 0.7 <= share <= 0.9, share          # 80 % intended
    width = (p.yhat_upper - p.yhat_lower).groupby(p.ds).mean()
    assert width.iloc[-10:].mean() > width.iloc[:10].mean()
    again = cp.predict(df.where(df.ds >= cut), coefs).toPandas()
    assert p.sort_values(["series", "ds"]).yhat_upper.tolist() == again.sort_values(["series", "ds"]).yhat_upper.tolist()


def test_one_day_and_empty(spark):
    one = spark.createDataFrame([("a", dt.date(2015, 1, 1), 5.0, None, None)], SCHEMA)
    p = cp.predict(one, cp.fit(one)).first()
    assert abs(p.yhat - 5.0) < 0.5 and p.yhat_lower <= p.yhat <= p.yhat_upper
    assert cp.fit(one.limit(0)).count() == 0
