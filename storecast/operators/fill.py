"""Calendar resampling and forward/backward fill of a sparse daily series.

Both windows run over *dates*, never over fact rows: a calendar holds one row
per day (tens of thousands per century), so a single ordered window over it
is bounded by the calendar span, not by data volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resample_daily_ffill(series: DataFrame, date_col: str = "date",
                         value_col: str = "dcoilwtico") -> DataFrame:
    """One row per day from the first to the last observed date; each
    inserted day takes the latest *observed row* (its value may be null).
    Observed nulls stay null.  Two rows on one date are an error."""
    obs = series.groupBy(date_col).agg(
        F.count(F.lit(1)).alias("_n"), F.first(value_col).alias("_v"))
    obs = obs.select(
        date_col,
        F.when(F.col("_n") > 1, F.raise_error(F.lit("duplicate date in daily series")))
         .otherwise(F.struct(F.col("_v").alias("v"))).alias("_obs"))
    cal = (series.agg(F.min(date_col).alias("lo"), F.max(date_col).alias("hi"))
                 .select(F.explode(F.sequence("lo", "hi")).alias(date_col)))
    w = Window.orderBy(date_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j = cal.join(F.broadcast(obs), date_col, "left")
    return j.select(date_col, F.last("_obs", ignorenulls=True).over(w)["v"].alias(value_col))


def fill_over_dates(dates: DataFrame, daily: DataFrame, date_col: str = "date",
                    value_col: str = "dcoilwtico") -> DataFrame:
    """Value of ``daily`` at each of ``dates`` (distinct), then forward fill
    and back fill over those dates in date order."""
    d = dates.select(date_col).distinct()
    j = d.join(F.broadcast(daily), date_col, "left")
    before = Window.orderBy(date_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.orderBy(date_col).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    v = F.col(value_col)
    return j.select(date_col, F.coalesce(F.last(v, ignorenulls=True).over(before),
                                         F.first(v, ignorenulls=True).over(after)).alias(value_col))
