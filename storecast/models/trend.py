"""M5/M6: trend + seasonality + regressors, fitted for many daily series at once.

Each series is one group of ``groupBy(series).applyInPandas``; a group holds one
row per day of that series (bounded by the calendar, not by data volume).
The model is additive: a piecewise-linear trend with hinges spread over the
first 80 % of the history, yearly (order 10) and weekly (order 3) Fourier
terms, and the oil and holiday regressors.  Coefficients come from ridge
normal equations in numpy; the interval is yhat +/- z * residual std.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

N_HINGES = 25
HINGE_SPAN = 0.8
YEARLY_ORDER = 10
WEEKLY_ORDER = 3
INTERVAL_Z = 1.2815515655446004   # two-sided 80 % normal interval
RIDGE_HINGE = 0.1
RIDGE_OTHER = 1e-6
DEFAULT_OIL = 45.0
FUTURE_HOLIDAY = 0

COEF_SCHEMA = T.StructType([
    T.StructField("series", T.StringType()),
    T.StructField("t0", T.DateType()),
    T.StructField("t_days", T.DoubleType()),
    T.StructField("y_scale", T.DoubleType()),
    T.StructField("oil_mean", T.DoubleType()),
    T.StructField("oil_std", T.DoubleType()),
    T.StructField("hinges", T.ArrayType(T.DoubleType())),
    T.StructField("beta", T.ArrayType(T.DoubleType())),
    T.StructField("sigma", T.DoubleType()),
    T.StructField("n_obs", T.LongType()),
])

FORECAST_SCHEMA = T.StructType([
    T.StructField("series", T.StringType()),
    T.StructField("ds", T.DateType()),
    T.StructField("yhat", T.DoubleType()),
    T.StructField("yhat_lower", T.DoubleType()),
    T.StructField("yhat_upper", T.DoubleType()),
])


def _design(days: np.ndarray, t_days: float, hinges: np.ndarray, oil: np.ndarray,
            hol: np.ndarray, doy: np.ndarray, dow: np.ndarray) -> np.ndarray:
    t = days / t_days
    cols = [np.ones_like(t), t]
    cols += [np.maximum(t - h, 0.0) for h in hinges]
    for k in range(1, YEARLY_ORDER + 1):
        a = 2 * np.pi * k * doy / 365.25
        cols += [np.sin(a), np.cos(a)]
    for k in range(1, WEEKLY_ORDER + 1):
        a = 2 * np.pi * k * dow / 7.0
        cols += [np.sin(a), np.cos(a)]
    cols += [oil, hol]
    return np.column_stack(cols)


def _penalties(n_cols: int) -> np.ndarray:
    pen = np.full(n_cols, RIDGE_OTHER)
    pen[0] = 0.0
    pen[2:2 + N_HINGES] = RIDGE_HINGE
    return pen


def _features(pdf: pd.DataFrame, t0: pd.Timestamp, t_days: float, hinges: np.ndarray,
              oil_mean: float, oil_std: float) -> np.ndarray:
    ds = pd.to_datetime(pdf["ds"])
    days = (ds - t0).dt.days.to_numpy(dtype=float)
    oil = (pdf["dcoilwtico"].astype(float).fillna(oil_mean).to_numpy() - oil_mean) / oil_std
    hol = pdf["is_holiday"].astype(float).fillna(0).to_numpy()
    return _design(days, t_days, hinges, oil, hol, ds.dt.dayofyear.to_numpy(float),
                   ds.dt.dayofweek.to_numpy(float))


def _fit_one(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("ds")
    series = pdf["series"].iloc[0]
    ds = pd.to_datetime(pdf["ds"])
    t0 = ds.min()
    t_days = max(float((ds.max() - t0).days), 1.0)
    y = pdf["y"].astype(float).fillna(0).to_numpy()
    y_scale = float(np.max(np.abs(y))) or 1.0
    oil_raw = pdf["dcoilwtico"].astype(float)
    oil_mean = float(oil_raw.mean()) if oil_raw.notna().any() else DEFAULT_OIL
    oil_std = float(oil_raw.std()) if oil_raw.notna().sum() > 1 else 1.0
    oil_std = oil_std if oil_std > 0 else 1.0
    hinges = np.linspace(0, HINGE_SPAN, N_HINGES + 1)[1:]
    X = _features(pdf, t0, t_days, hinges, oil_mean, oil_std)
    yt = y / y_scale
    A = X.T @ X + np.diag(_penalties(X.shape[1]) * len(yt))
    beta = np.linalg.solve(A, X.T @ yt)
    resid = (yt - X @ beta) * y_scale
    sigma = float(np.std(resid)) if len(resid) > 1 else 0.0
    return pd.DataFrame([{
        "series": series, "t0": t0.date(), "t_days": t_days, "y_scale": y_scale,
        "oil_mean": oil_mean, "oil_std": oil_std, "hinges": hinges.tolist(),
        "beta": beta.tolist(), "sigma": sigma, "n_obs": len(yt)}])


def fit(series: DataFrame) -> DataFrame:
    """Fit one model per ``series`` over rows ``series, ds, y, dcoilwtico, is_holiday``."""
    cols = series.select("series", "ds", F.col("y").cast("double").alias("y"),
                         F.col("dcoilwtico").cast("double").alias("dcoilwtico"),
                         F.col("is_holiday").cast("double").alias("is_holiday"))
    return cols.groupBy("series").applyInPandas(_fit_one, COEF_SCHEMA)


def _predict_one(rows: pd.DataFrame, coef: pd.DataFrame) -> pd.DataFrame:
    if rows.empty or coef.empty:
        return pd.DataFrame({f.name: pd.Series([], dtype=object) for f in FORECAST_SCHEMA.fields})
    c = coef.iloc[0]
    X = _features(rows, pd.Timestamp(c["t0"]), float(c["t_days"]), np.asarray(c["hinges"], float),
                  float(c["oil_mean"]), float(c["oil_std"]))
    yhat = X @ np.asarray(c["beta"], float) * float(c["y_scale"])
    band = INTERVAL_Z * float(c["sigma"])
    return pd.DataFrame({"series": rows["series"].to_numpy(), "ds": rows["ds"].to_numpy(),
                         "yhat": yhat, "yhat_lower": yhat - band, "yhat_upper": yhat + band})


def predict(rows: DataFrame, coefs: DataFrame) -> DataFrame:
    """Score ``series, ds, dcoilwtico, is_holiday`` rows with their series' model."""
    r = rows.select("series", "ds", F.col("dcoilwtico").cast("double").alias("dcoilwtico"),
                    F.col("is_holiday").cast("double").alias("is_holiday"))
    return (r.groupBy("series").cogroup(coefs.groupBy("series"))
             .applyInPandas(_predict_one, FORECAST_SCHEMA))


def future_frame(hist: DataFrame, days: int, oil: float = DEFAULT_OIL,
                 holiday: int = FUTURE_HOLIDAY, by: str | None = None) -> DataFrame:
    """history rows plus ``days`` days after each series' last day,
    with constant regressors for the future rows."""
    keys = [by] if by else []
    last = hist.groupBy(*keys).agg(F.max("ds").alias("_last"))
    fut = last.select(*keys, F.explode(F.sequence(F.date_add("_last", 1),
                                                  F.date_add("_last", days))).alias("ds"))
    fut = fut.select(*keys, "ds", F.lit(None).cast(hist.schema["y"].dataType).alias("y"),
                     F.lit(oil).cast(hist.schema["dcoilwtico"].dataType).alias("dcoilwtico"),
                     F.lit(holiday).cast(hist.schema["is_holiday"].dataType).alias("is_holiday"),
                     F.lit(True).alias("is_future"))
    past = hist.select(*keys, "ds", "y", "dcoilwtico", "is_holiday", F.lit(False).alias("is_future"))
    return past.unionByName(fut)


def backtest(series: DataFrame, split_date: str) -> DataFrame:
    """Fit before ``split_date``, score on/after it, MAE per series.  A
    series without rows before the split has no model: its MAE is null."""
    s = series.withColumn("_val", F.col("ds") >= F.lit(split_date).cast("date"))
    coefs = fit(s.where(~F.col("_val")))
    val = s.where(F.col("_val"))
    pred = predict(val, coefs)
    j = val.select("series", "ds", F.col("y").cast("double").alias("y")).join(pred, ["series", "ds"], "left")
    return j.groupBy("series").agg(F.avg(F.abs(F.col("yhat") - F.col("y"))).alias("mae"),
                                   F.count(F.lit(1)).alias("n_val"))


def save(coefs: DataFrame, path: str) -> None:
    """Coefficients as parquet (one row per series)."""
    coefs.write.mode("overwrite").parquet(path)


def load(spark, path: str) -> DataFrame:
    return spark.read.schema(COEF_SCHEMA).parquet(path)
