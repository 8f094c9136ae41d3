"""M5/M6 with sparse trend changes and simulated intervals.

The additive model of ``trend`` (same columns), with a Laplace prior on the slope
changes instead of a ridge: few of the possible changes are used and the rest are
exactly zero.  The coefficients minimise

    sum of squared residuals / (2 sigma^2) + sum |change| / CHANGE_SCALE + sum other^2 / (2 OTHER_SCALE^2)

by coordinate descent on the normal equations (one pass over a series' days makes
them; a sweep costs columns^2, not days), with sigma estimated in turn.

An interval comes from ``DRAWS`` simulated futures: after the last day slopes go on
changing as often as the possible changes of the history and as strongly as the
fitted ones, and every day adds residual noise.  Draws are seeded by the series
name, so a rerun gives the same interval.  Within the history only the noise varies.

A series is one group, at most one row per day.  A day without a value is read as
0, as in ``trend``; a series of one day predicts that day's value.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storecast.models import trend

CHANGE_SCALE = 0.05
OTHER_SCALE = 10.0
DRAWS = 1000
LOW, HIGH = 0.1, 0.9
SWEEPS = 10             # of coordinate descent between two solutions for the coefficients in use
ROUNDS = 100
TOLERANCE = 1e-10
SIGMA_ROUNDS = 4

COEFS = T.StructType([*trend.COEF_SCHEMA.fields, T.StructField("change_mean", T.DoubleType()),
                      T.StructField("n_changes", T.IntegerType()), T.StructField("slack", T.DoubleType())])


def descend(gram: np.ndarray, target: np.ndarray, absolute: np.ndarray, square: np.ndarray,
            start: np.ndarray) -> np.ndarray:
    """Minimise b'Gb/2 - t'b + sum absolute_j |b_j| + sum square_j b_j^2 / 2: sweeps
    of coordinate descent decide which coefficients are in use; for those the rest
    is linear and solved, up to the first one that would change its sign."""
    b = start.copy()
    diagonal = np.diag(gram) + square
    columns = np.flatnonzero(diagonal > 0).tolist()
    for _ in range(ROUNDS):
        residual = target - gram @ b
        for _ in range(SWEEPS):
            for j in columns:
                z = residual[j] + gram[j, j] * b[j]
                step = np.sign(z) * max(abs(z) - absolute[j], 0.0) / diagonal[j] - b[j]
                if step:
                    residual -= gram[:, j] * step
                    b[j] += step
        for _ in range(len(b)):
            use = np.flatnonzero((b != 0) & (diagonal > 0))
            to = np.linalg.lstsq(gram[np.ix_(use, use)] + np.diag(square[use]),
                                 target[use] - absolute[use] * np.sign(b[use]), rcond=None)[0]
            cross = (absolute[use] > 0) & (np.sign(to) != np.sign(b[use]))
            if not cross.any():
                b[use] = to
                break
            share = np.where(cross, b[use] / np.where(cross, b[use] - to, 1.0), np.inf)
            b[use] += share.min() * (to - b[use])
            b[use[share.argmin()]] = 0.0
        if slack(gram, target, absolute, square, b) < TOLERANCE:
            break
    return b


def slack(gram, target, absolute, square, b) -> float:
    """How far ``b`` is from the conditions of a minimum (0: it is one), in units of the largest target."""
    pull = target - gram @ b - square * b
    off = np.where(b != 0, np.abs(pull - absolute * np.sign(b)), np.maximum(np.abs(pull) - absolute, 0))
    return float(off.max() / max(np.abs(target).max(), 1e-12))


def _fit_one(pdf: pd.DataFrame) -> pd.DataFrame:
    base = trend._fit_one(pdf)                   # scales, hinges and a start
    c = base.iloc[0]
    pdf = pdf.sort_values("ds")
    x = trend._features(pdf, pd.Timestamp(c["t0"]), float(c["t_days"]), np.asarray(c["hinges"]),
                        float(c["oil_mean"]), float(c["oil_std"]))
    y = pdf["y"].astype(float).fillna(0).to_numpy() / float(c["y_scale"])
    gram, target, total = x.T @ x, x.T @ y, float(y @ y)
    n, width = x.shape
    is_change = np.zeros(width, bool)
    is_change[2:2 + trend.N_HINGES] = True
    b, sigma = np.asarray(c["beta"], float), max(float(c["sigma"]) / float(c["y_scale"]), 1e-3)
    for _ in range(SIGMA_ROUNDS):
        absolute = np.where(is_change, sigma ** 2 / CHANGE_SCALE, 0.0)
        square = np.where(is_change, 0.0, sigma ** 2 / OTHER_SCALE ** 2)
        b = descend(gram, target, absolute, square, b)
        off = slack(gram, target, absolute, square, b)
        sigma = max(float(np.sqrt(max(total - 2 * target @ b + b @ gram @ b, 0.0) / n)), 1e-3)
    changes = b[is_change]
    base["beta"], base["sigma"] = [b.tolist()], [sigma * float(c["y_scale"])]
    base["change_mean"] = float(np.abs(changes).mean())
    base["n_changes"], base["slack"] = int((changes != 0).sum()), off
    return base


def fit(series: DataFrame) -> DataFrame:
    """One model per ``series`` over rows ``series, ds, y, dcoilwtico, is_holiday``."""
    cols = series.select("series", "ds", *[F.col(c).cast("double").alias(c) for c in ("y", "dcoilwtico", "is_holiday")])
    return cols.groupBy("series").applyInPandas(_fit_one, COEFS)


def simulate(t: np.ndarray, per_day: float, change_mean: float, sigma: float, seed: int, draws: int = DRAWS) -> np.ndarray:
    """Deviations (draws x days) for days ``t`` (in spans of the history, 1 = its
    last day): slope changes after 1 and noise on every day."""
    rng = np.random.default_rng(seed)
    ahead = np.maximum(t - 1.0, 0.0)
    reach = float(ahead.max(initial=0.0))
    out = rng.normal(0, sigma, (draws, len(t))) if sigma else np.zeros((draws, len(t)))
    count = rng.poisson(per_day * reach, draws) if reach else np.zeros(draws, int)
    who = np.repeat(np.arange(draws), count)
    at, size = rng.uniform(0, reach, len(who)), rng.laplace(0, change_mean, len(who)) if change_mean else np.zeros(len(who))
    for lo in range(0, len(who), 4096):
        cut = slice(lo, lo + 4096)
        np.add.at(out, who[cut], size[cut, None] * np.maximum(ahead[None, :] - at[cut, None], 0.0))
    return out


def _predict_one(rows: pd.DataFrame, coef: pd.DataFrame) -> pd.DataFrame:
    if rows.empty or coef.empty:
        return pd.DataFrame({f.name: pd.Series([], dtype=object) for f in trend.FORECAST_SCHEMA.fields})
    c = coef.iloc[0]
    x = trend._features(rows, pd.Timestamp(c["t0"]), float(c["t_days"]), np.asarray(c["hinges"], float),
                        float(c["oil_mean"]), float(c["oil_std"]))
    scale = float(c["y_scale"])
    yhat = x @ np.asarray(c["beta"], float)
    often = trend.N_HINGES / trend.HINGE_SPAN            # possible changes per span of the history
    off = simulate(x[:, 1], often, float(c["change_mean"]), float(c["sigma"]) / scale,
                   zlib.crc32(str(c["series"]).encode()))
    low, high = np.quantile(off, [LOW, HIGH], axis=0)
    return pd.DataFrame({"series": rows["series"].to_numpy(), "ds": rows["ds"].to_numpy(), "yhat": yhat * scale,
                         "yhat_lower": (yhat + np.minimum(low, 0)) * scale, "yhat_upper": (yhat + np.maximum(high, 0)) * scale})


def predict(rows: DataFrame, coefs: DataFrame) -> DataFrame:
    """Score ``series, ds, dcoilwtico, is_holiday`` rows with their series' model."""
    r = rows.select("series", "ds", *[F.col(c).cast("double").alias(c) for c in ("dcoilwtico", "is_holiday")])
    return r.groupBy("series").cogroup(coefs.groupBy("series")).applyInPandas(_predict_one, trend.FORECAST_SCHEMA)
