"""Left joins of the sales fact to its side tables.

Broadcast policy: a side is broadcast only when its size is bounded by
construction (one row per calendar day) or checked at run time
(``broadcast_if_small``).  Anything else is left to the planner and AQE,
which pick a shuffle join and split skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Largest side we broadcast after a check: at most this many rows and, by a
# schema-based width estimate, at most this many bytes (well under the driver
# and executor memory a broadcast takes on a large cluster).
BROADCAST_MAX_ROWS = 1_000_000
BROADCAST_MAX_BYTES = 64 * 1024 * 1024
# Transaction rows of one partition of the shuffle join, which bounds what a task sorts.
SIDE_ROWS = 100_000

# Estimated bytes per value, by type name (strings and nested values are guesses
# on the large side, so the bound errs toward not broadcasting).
_WIDTH = {"boolean": 1, "byte": 1, "short": 2, "integer": 4, "date": 4, "float": 4,
          "long": 8, "double": 8, "timestamp": 8, "timestamp_ntz": 8, "decimal": 16,
          "string": 32, "binary": 32}


def _value_bytes(dt: T.DataType) -> int:
    if isinstance(dt, T.StructType):
        return sum(_value_bytes(f.dataType) for f in dt.fields)
    if isinstance(dt, (T.ArrayType, T.MapType)):
        return 256
    return _WIDTH.get(dt.typeName(), 16)


def row_bytes(schema: T.StructType) -> int:
    """Estimated width of one row of ``schema`` in bytes (plus row overhead)."""
    return 16 + _value_bytes(schema)


def broadcast_rows(side: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> int:
    """The most rows of ``side``'s schema that are broadcast."""
    return min(max_rows, max(0, max_bytes // row_bytes(side.schema)))


def broadcast_if_small(side: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                       max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast ``side`` if it has at most ``max_rows`` rows and its estimated
    size is at most ``max_bytes``; else return it unchanged (shuffle join, with
    AQE free to re-plan).  The check is a distributed count, so pass a scan or
    a checkpointed side."""
    return F.broadcast(side) if side.count() <= broadcast_rows(side, max_rows, max_bytes) else side


def join_oil(fact: DataFrame, oil_by_day: DataFrame) -> DataFrame:
    """Fact left join the calendar-filled oil series on ``date``
    (one row per day, so the side is bounded by the calendar)."""
    return fact.join(F.broadcast(oil_by_day), "date", "left")


def join_stores(fact: DataFrame, stores: DataFrame, checked: bool = True) -> DataFrame:
    """Fact left join stores on ``store_nbr``."""
    side = broadcast_if_small(stores) if checked else stores
    return fact.join(side, "store_nbr", "left")


def effective_holidays(holidays: DataFrame) -> DataFrame:
    """Holidays not transferred (null counts as not kept), flag 1."""
    return (holidays.where(F.col("transferred") == F.lit(False))
                    .select("date", F.lit(1).alias("is_holiday")))


def join_holidays(fact: DataFrame, holidays: DataFrame, dedupe: bool = False) -> DataFrame:
    """Fact left join effective holidays on ``date``.  A date with k
    holidays yields k copies of each sale (source behaviour) unless
    ``dedupe``; no match gives ``is_holiday = 0``.  A day may hold any number
    of holidays, so the side is broadcast only after a size check."""
    h = effective_holidays(holidays)
    if dedupe:
        h = h.distinct()
    j = fact.join(broadcast_if_small(h), "date", "left")
    return j.withColumn("is_holiday", F.coalesce(F.col("is_holiday"), F.lit(0)))


def join_transactions(fact: DataFrame, tx: DataFrame, checked: bool = True) -> DataFrame:
    """Fact left join transactions on (date, store_nbr); missing -> 0.

    Transactions grow with stores x days, far slower than the fact.  With
    ``checked`` the side is first cut from its lineage (a reliable checkpoint,
    so the size check and the join read it once) and broadcast when it passes
    the size check: the fact is then joined without a shuffle.  A side too
    large for that is joined by sort-merge, in as many partitions as its rows
    need, so that a task's sort does not grow with the table."""
    side = tx.select("date", "store_nbr", "transactions")
    if checked:
        side = side.checkpoint(eager=True)
        rows = side.count()
        if rows <= broadcast_rows(side):
            side = F.broadcast(side)
        else:
            parts = max(-(-rows // SIDE_ROWS), int(side.sparkSession.conf.get("spark.sql.shuffle.partitions")))
            fact, side = (df.repartition(parts, "date", "store_nbr") for df in (fact, side))
    j = fact.join(side, ["date", "store_nbr"], "left")
    return j.withColumn("transactions", F.coalesce(F.col("transactions"), F.lit(0)).cast("bigint"))
