"""C2 with keyed state that expires: counters by (grain, family, period) as a
``transformWithState`` operator.

State is one small record per open period.  An event-time timer is set to the
period's end plus ``keep``; when the watermark passes it, the period is emitted
as closed and its state is removed, so state holds the open periods only, however
long the stream runs.  Repeated messages are dropped within the watermark before
they reach the counters, and events behind the watermark are dropped by the
operator.  Sums are whole cents, exact in 64 bits.

Each trigger emits the totals of the periods it touched (``open``) and of those
it closed (``closed``); the sink overwrites the folder of its batch, so a replay
writes the same rows, and readers take the newest row per key.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from storecast.functions.calendar import GRAINS, parse_date, period_key
from storecast.operators import events as ev

KEY = ["grain", "family", "period"]
OUT = "grain string, family string, period string, cents long, n_events long, status string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
STATE = "cents long, n_events long, expires long"


def period_end(grain: str, d: Column) -> Column:
    """The first day after the period of day ``d``."""
    if grain == "daily":
        return F.date_add(d, 1)
    if grain == "weekly":       # Sunday to Saturday, cut at the turn of the year
        return F.least(F.next_day(d, "Sunday"), F.make_date(F.year(d) + 1, F.lit(1), F.lit(1)))
    return F.date_add(F.last_day(d), 1)


def period_rows(events: DataFrame, watermark: str, keep_ms: int) -> DataFrame:
    """Deduplicated valid events, one row per grain, with the time their period
    expires (milliseconds)."""
    d = parse_date(F.col("date"))
    sales = F.coalesce(F.col("sales").try_cast(ev.SALES_TYPE), F.lit(0).cast(ev.SALES_TYPE))
    rows = (ev.valid_events(events)
            .select("msg_id", "family", d.alias("day"), (sales * 100).cast("long").alias("cents"),
                    F.to_timestamp(d).alias("event_ts"))
            .withWatermark("event_ts", watermark).dropDuplicatesWithinWatermark(["msg_id"]))
    grains = F.array(*[F.struct(F.lit(g).alias("grain"), period_key(g, F.col("day")).alias("period"),
                                (F.unix_millis(F.to_timestamp(period_end(g, F.col("day")))) + keep_ms).alias("expires"))
                       for g in GRAINS])
    return rows.select("family", "cents", "event_ts", F.inline(grains))


class PeriodCounters(StatefulProcessor):
    """Totals of one (grain, family, period) until its timer."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.total = handle.getValueState("total", STATE)

    def _row(self, key, cents: int, n: int, status: str) -> pd.DataFrame:
        return pd.DataFrame({"grain": [key[0]], "family": [key[1]], "period": [key[2]], "cents": [cents],
                             "n_events": [n], "status": [status]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cents, n, expires = self.total.get() if self.total.exists() else (0, 0, None)
        for batch in rows:
            cents, n = cents + int(batch["cents"].sum()), n + len(batch)
            if expires is None:
                expires = int(batch["expires"].iloc[0])
                self.handle.registerTimer(expires)
        self.total.update((cents, n, expires))
        yield self._row(key, cents, n, "open")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        cents, n, _ = self.total.get()
        self.total.clear()
        yield self._row(key, cents, n, "closed")

    def close(self) -> None:
        pass


def start(spark: SparkSession, events: DataFrame, root: str, watermark: str, keep_ms: int = 0,
          available_now: bool = True) -> StreamingQuery:
    """The counters of ``events`` (a stream of wire events) under ``root``."""
    counted = period_rows(events, watermark, keep_ms).groupBy(*KEY).transformWithStateInPandas(
        PeriodCounters(), outputStructType=OUT, outputMode="Update", timeMode="EventTime")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(root, "periods", f"batch_id={batch_id}"))
    w = counted.writeStream.outputMode("update").foreachBatch(write).option(
        "checkpointLocation", os.path.join(root, "_checkpoints", "periods"))
    # A started query keeps the settings it saw, so the caller's provider is put back.
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return (w.trigger(availableNow=True) if available_now else w).start()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def run_once(spark: SparkSession, events: DataFrame, root: str, watermark: str, keep_ms: int = 0) -> None:
    q = start(spark, events, root, watermark, keep_ms)
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def read_periods(spark: SparkSession, root: str) -> DataFrame:
    """The newest totals of every period: grain, family, period, value, n_events, status."""
    rows = spark.read.parquet(os.path.join(root, "periods"))
    # A trigger that touches and closes a period writes both rows: closed is the later one.
    newest = F.max_by(F.struct("cents", "n_events", "status"), F.struct("batch_id", F.col("status") == "closed"))
    return rows.groupBy(*KEY).agg(newest.alias("r")).select(
        *KEY, (F.col("r.cents").cast("decimal(38,2)") / 100).cast("decimal(38,2)").alias("value"), "r.n_events", "r.status")
