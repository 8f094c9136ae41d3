"""Order-dependent operators: exact global row numbers, newest-N, renumbering,
buffer trimming and series tails.

``global_index`` numbers rows in a total order without pulling them into one
task: rows are range-partitioned and sorted, each partition's size and first
id are aggregated (one row per partition), and a running sum over those few
rows gives each partition its offset.  The sorted frame is checkpointed to
the shared checkpoint folder first, so both passes see the same partitions
even after an executor loss.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def global_index(df: DataFrame, order: Sequence[Column], index_col: str = "idx") -> DataFrame:
    """Add a 0-based position in ``order`` (make the order total for a
    deterministic result)."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    tagged = ranged.select("*", F.spark_partition_id().alias("_pid"),
                           F.monotonically_increasing_id().alias("_mid")).checkpoint(eager=True)
    per_part = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    # one row per partition: bounded by the partition count, not the data
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("_pid", "_m0", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    out = tagged.join(F.broadcast(offsets), "_pid")
    return out.withColumn(index_col, (F.col("_off") + F.col("_mid") - F.col("_m0")).cast("bigint")) \
              .drop("_pid", "_mid", "_m0", "_off")


def _keep_newest(df: DataFrame, n: int, group: Column, order: Sequence[Column]) -> DataFrame:
    """The ``n`` rows with the largest ``group``, ties inside a group taken in
    ``order``.  Counts per group (few rows) tell which group the cut falls in:
    rows above it are kept unsorted, and only that group's rows are ranked.
    A null group comes after all others: its rows are taken only when the rest
    are fewer than ``n``."""
    grouped = df.withColumn("_g", group)
    counts = grouped.groupBy("_g").agg(F.count(F.lit(1)).alias("_c"))
    above = Window.orderBy(F.col("_g").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    cut = (counts.select("_g", "_c", F.coalesce(F.sum("_c").over(above), F.lit(0)).alias("_above"))
                 .where(F.col("_above") < n).orderBy(F.col("_g").asc_nulls_first()).limit(1).collect())
    if not cut:
        return df.where(F.lit(False))
    edge, size, left = cut[0]["_g"], cut[0]["_c"], n - cut[0]["_above"]
    at_edge = F.col("_g").eqNullSafe(F.lit(edge))
    higher = F.col("_g").isNotNull() if edge is None else F.col("_g") > F.lit(edge)
    if size <= left:
        return grouped.where(at_edge | higher).drop("_g")
    ranked = global_index(grouped.where(at_edge), order, "_pos").where(F.col("_pos") < left)
    return grouped.where(higher).drop("_g").unionByName(ranked.drop("_g", "_pos"))


def newest_rows(df: DataFrame, n: int, date_col: str, tie_cols: Sequence[str]) -> DataFrame:
    """L1: the ``n`` newest rows by (date, ties) descending, in no order; rows
    without a date come last."""
    return _keep_newest(df, n, F.col(date_col), [F.col(c).desc() for c in tie_cols])


def renumber(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """L2: rows numbered from 0 (``idx``) in ascending ``order``."""
    return global_index(df, [F.col(c).asc() for c in order], "idx")


def latest_n(df: DataFrame, n: int, date_col: str, tie_cols: Sequence[str]) -> DataFrame:
    """L1 + L2: the ``n`` newest rows, numbered 0.. in ascending order (``idx``)."""
    return renumber(newest_rows(df, n, date_col, tie_cols), [date_col, *tie_cols])


def newest_by_key(df: DataFrame, keep: int, key_col: str, ranges: int = 4096) -> DataFrame:
    """L3: the ``keep`` rows with the largest ``key_col`` (unique integer key;
    rows without one come last, in no set order among themselves).  The key's span
    is cut into ``ranges`` equal ranges for the counts."""
    lo, hi = df.agg(F.min(key_col), F.max(key_col)).first()
    if lo is None:
        lo = hi = 0
    width = (hi - lo) // ranges + 1
    return _keep_newest(df, keep, F.floor((F.col(key_col) - F.lit(lo)) / F.lit(width)), [F.col(key_col).desc()])


def tail_rows(series: DataFrame, n: int, order_col: str) -> DataFrame:
    """The last ``n`` rows of a per-day series (a top-n report)."""
    return series.orderBy(F.col(order_col).desc()).limit(n).orderBy(order_col)
