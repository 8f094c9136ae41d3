"""Label encoding (W3) and code lookup.

A code is the 0-based position of a value among the sorted distinct values of
its column; a null is encoded as the text ``'nan'``.  Fitting is an action (as
for any estimator); the fitted table ``(col, value, code)`` is cut from its
lineage, so its size is known before it is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storecast.operators.joins import broadcast_if_small

ENCODED_COLUMNS = ("family", "city", "state", "type")
NULL_TEXT = "nan"


def code_value(c: str):
    return F.coalesce(F.col(c).cast("string"), F.lit(NULL_TEXT))


def distinct_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("col"), code_value(c).alias("value")) for c in cols])
    return df.select(F.inline(pairs)).distinct()


def rank_codes(values: DataFrame) -> DataFrame:
    """Dense rank of each value within its column.  The window is partitioned
    by column name; each partition holds the distinct values of one
    categorical column (its domain), not the rows of the fact."""
    w = Window.partitionBy("col").orderBy("value")
    return values.select("col", "value", (F.dense_rank().over(w) - 1).alias("code"))


def fit_codes(df: DataFrame, cols: Sequence[str] = ENCODED_COLUMNS, materialize: bool = True) -> DataFrame:
    """Fit the encoders.  With ``materialize`` the table is checkpointed to the
    shared checkpoint folder (reliable, survives executor loss)."""
    codes = rank_codes(distinct_values(df, cols))
    return codes.checkpoint(eager=True) if materialize else codes


def apply_codes(df: DataFrame, codes: DataFrame, cols: Sequence[str] = ENCODED_COLUMNS,
                strict: bool = False, checked_broadcast: bool = True) -> DataFrame:
    """Add ``{col}_encoded`` for each column.  Unseen values give null, or
    fail the job when ``strict`` (the source raises on an unseen label)."""
    side = broadcast_if_small(codes) if checked_broadcast else codes
    out = df
    for c in cols:
        key, code = f"_{c}_value", f"{c}_encoded"
        cd = side.where(F.col("col") == c).select(F.col("value").alias(key), F.col("code").alias(code))
        out = out.withColumn(key, code_value(c)).join(cd, key, "left").drop(key)
        if strict:
            out = out.withColumn(code, F.when(F.col(code).isNull(), F.raise_error(
                F.concat(F.lit(f"unseen label in {c}: "), code_value(c)))).otherwise(F.col(code)))
    return out


def classes(codes: DataFrame, col: str) -> DataFrame:
    """A3: the fitted classes of one column, in code order."""
    return codes.where(F.col("col") == col).select("value", "code")
