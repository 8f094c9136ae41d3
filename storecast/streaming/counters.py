"""The live counter job on Structured Streaming.

Source: a folder of parquet files of wire events (``msg_id`` + string fields);
the producer appends files (S5), the checkpoint holds the read offset (S6, S8),
``availableNow`` processes what is there and stops (S7).

Three queries share the source, each with its own checkpoint:

* counters - valid events summed per (family, event day).  The day is a
  ``window`` on the event time, so an optional watermark both drops late
  events and evicts closed days from state; without one, state is kept for
  every day and late events still count (source behaviour).  Each trigger
  emits the *absolute* totals of the days it touched; ``foreachBatch``
  overwrites ``batch_id=N`` (a replayed batch rewrites the same folder, so the
  sink is exactly-once) and readers keep the newest batch per key.  Every
  ``snapshot_every`` batches the newest totals are written as one snapshot, so a
  reader opens one snapshot and the few folders after it.  The last
  ``SNAPSHOTS_KEPT`` snapshots and what follows them stay, older files are
  removed.  Weekly and monthly counters are rolled up from the days at read time
  (S9/A1).
* buffer - the raw valid events as JSON payloads (S10).  With ``keep`` the buffer
  is trimmed after each batch to the newest ``keep`` messages (L3): folders below
  the cut leave the list of live folders, folders above it stay as they are, and
  only folders the cut falls in are rewritten.
* rejects - skipped and quarantined events with the reason (poison values do
  not stop the stream).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from storecast.functions.calendar import GRAINS, parse_date, period_key
from storecast.operators import events as ev
from storecast.operators.ordering import global_index, newest_by_key

KEEP = 100_001              # messages the source's buffer holds
SNAPSHOT_EVERY = 20         # batches from one snapshot of the counters to the next
SNAPSHOTS_KEPT = 2          # the newest, and the one a replay of its batch starts from


def _sales():
    return F.coalesce(F.col("sales").try_cast(ev.SALES_TYPE), F.lit(0).cast(ev.SALES_TYPE))


def append_events(wire: DataFrame, source_dir: str) -> None:
    """Publish a batch of wire events (new files in the source folder)."""
    wire.select(*[f.name for f in ev.WIRE_SCHEMA.fields]).write.mode("append").parquet(source_dir)


def append_assigned(spark: SparkSession, events: DataFrame, source_dir: str, order: list[str]) -> tuple[int, int]:
    """S5 with ids handed out here: the events (without ``msg_id``), in ``order``,
    get the next gap-free ascending ids.  Returns the first and the last + 1.

    The numbered rows are one append, and the commit that names the next free id
    is one file renamed into place.  The next append starts from what is really in
    the folder or the commit, whichever is higher, so an append that died between
    the two hands out no id twice; a retried task writes the same rows again.  One
    writer at a time: of two that race, the slower fails on the existing commit."""
    commits = os.path.join(source_dir, "_ids")
    n, rows = _newest_commit(spark, commits, "next long")
    first = 0 if n < 0 else rows.first()["next"]
    names = [f.name for f in ev.WIRE_SCHEMA.fields if f.name != "msg_id"]
    spark.createDataFrame([], ev.WIRE_SCHEMA).write.mode("append").parquet(source_dir)
    there = spark.read.schema(ev.WIRE_SCHEMA).parquet(source_dir).agg(F.max("msg_id")).first()[0]
    first = max(first, 0 if there is None else there + 1)
    numbered = global_index(events.select(*names), [F.col(c).asc() for c in order]).select(
        (F.col("idx") + F.lit(first)).cast("long").alias("msg_id"), *names).checkpoint(eager=True)
    count = numbered.count()
    numbered.write.mode("append").parquet(source_dir)
    spark.range(1).select(F.lit(first + count).cast("long").alias("next")).coalesce(1).write.mode("error").parquet(
        os.path.join(commits, f"upto={n + 1}"))
    return first, first + count


def read_events(spark: SparkSession, source_dir: str, max_files: int | None = None) -> DataFrame:
    """The event stream; ``max_files`` bounds one micro-batch."""
    r = spark.readStream.schema(ev.WIRE_SCHEMA)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(source_dir)


def daily_totals(events: DataFrame, watermark: str | None = None, dedupe: bool = False) -> DataFrame:
    """Running sum of sales per (family, event day) of the valid events."""
    v = ev.valid_events(events).select(
        "msg_id", "family", _sales().alias("sales"),
        F.to_timestamp(parse_date(F.col("date"))).alias("event_ts"))
    if watermark:
        v = v.withWatermark("event_ts", watermark)
    if dedupe:
        v = v.dropDuplicatesWithinWatermark(["msg_id"]) if watermark else v.dropDuplicates(["msg_id"])
    g = v.groupBy("family", F.window("event_ts", "1 day").alias("w")).agg(
        F.sum("sales").cast("decimal(38,2)").alias("value"), F.count(F.lit(1)).alias("n_events"))
    return g.select("family", F.col("w.start").cast("date").alias("day"), "value", "n_events")


# A commit is one file in a folder ``upto=N``: it appears whole, by the rename that
# ends its write.  It covers the batches up to N; what it names is written before it.


def _commit(rows: DataFrame, folder: str, upto: int) -> None:
    rows.coalesce(1).write.mode("overwrite").parquet(os.path.join(folder, f"upto={upto}"))


def _newest_commit(spark: SparkSession, folder: str, schema: str, before: int | None = None) -> tuple[int, DataFrame]:
    """(N, rows) of the newest commit, of those below ``before`` if given; (-1, no
    rows) without one.  One row per commit folder at most is read for N."""
    # An empty append makes the folder exist, so any read error is a real one.
    spark.createDataFrame([], schema).write.mode("append").parquet(os.path.join(folder, "upto=-1"))
    rows = spark.read.schema(f"{schema}, upto long").parquet(folder)
    upto = rows.where(F.col("upto") < before) if before is not None else rows
    n = upto.agg(F.max("upto")).first()[0]
    n = -1 if n is None else n
    return n, rows.where(F.col("upto") == n).drop("upto")


def _clear(spark: SparkSession, path: str) -> None:
    """Remove a folder's files: overwritten by no rows under a partition column,
    it holds no data file."""
    (spark.createDataFrame([], "part int, value int").write.mode("overwrite")
     .option("partitionOverwriteMode", "static").partitionBy("part").parquet(path))


def _commits_below(spark: SparkSession, folder: str, schema: str, upto: int) -> list:
    """The commits below ``upto``; those of removed folders are gone, so a few."""
    rows = spark.read.schema(f"{schema}, upto long").parquet(folder)
    return rows.where((F.col("upto") < upto) & (F.col("upto") >= 0)).orderBy(F.col("upto").desc()).collect()


def _daily(rows: DataFrame) -> DataFrame:
    return rows.groupBy("family", "day").agg(F.max_by(F.struct("value", "n_events", "batch_id"), F.col("batch_id")).alias("r")
                                             ).select("family", "day", "r.*")


TOTALS = "family string, day date, value decimal(38,2), n_events long, batch_id long"


def _totals(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """Counter rows from the newest snapshot and the batch folders after it."""
    upto, _ = _newest_commit(spark, os.path.join(root, "snapshot_commits"), "n long", before)
    later = spark.read.schema(TOTALS).parquet(os.path.join(root, "counters")).where(F.col("batch_id") > upto)
    if upto < 0:
        return later
    snapshot = spark.read.schema(TOTALS + ", upto long").parquet(os.path.join(root, "snapshots"))
    return snapshot.where(F.col("upto") == upto).drop("upto").unionByName(later)


def snapshot(spark: SparkSession, root: str, upto: int) -> None:
    """Write the newest totals of all batches up to ``upto`` and commit them."""
    rows = _daily(_totals(spark, root, upto).where(F.col("batch_id") <= upto))
    rows.write.mode("overwrite").parquet(os.path.join(root, "snapshots", f"upto={upto}"))
    # The commit holds the snapshot before it: its own batches are those between.
    before, _ = _newest_commit(spark, os.path.join(root, "snapshot_commits"), "n long", upto)
    _commit(spark.range(1).select(F.lit(before).cast("long").alias("n")), os.path.join(root, "snapshot_commits"), upto)


def drop_old_snapshots(spark: SparkSession, root: str, upto: int, kept: int = SNAPSHOTS_KEPT) -> None:
    """Remove all but the newest ``kept`` (2 at least) snapshots up to ``upto``, and
    the batch folders that the removed ones hold; a snapshot's commit goes last, so
    a run that died here does the rest when its batch is replayed."""
    commits = os.path.join(root, "snapshot_commits")
    for c in _commits_below(spark, commits, "n long", upto + 1)[max(2, kept):]:
        for batch_id in range(c["n"] + 1, c["upto"] + 1):
            _clear(spark, os.path.join(root, "counters", f"batch_id={batch_id}"))
        _clear(spark, os.path.join(root, "snapshots", f"upto={c['upto']}"))
        _clear(spark, os.path.join(commits, f"upto={c['upto']}"))


def _counter_writer(root: str, snapshot_every: int):
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(root, "counters", f"batch_id={batch_id}"))
        if snapshot_every and batch_id % snapshot_every == snapshot_every - 1:
            snapshot(batch.sparkSession, root, batch_id)
            drop_old_snapshots(batch.sparkSession, root, batch_id)
    return write


BUFFER = "msg_id long, payload string"


def _live_buffer(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """Buffered rows with their folder: (kind, at) is a batch, or the rest of
    folders cut by an earlier trim."""
    upto, live = _newest_commit(spark, os.path.join(root, "buffer_commits"), "kind string, at long", before)
    names = {"batch": [], "cut": []}
    live = live.where(F.col("kind").isin(*names))
    for r in live.collect():                      # live folders: at most one per batch since the cut
        names[r["kind"]].append(r["at"])
    rows = spark.read.schema(BUFFER + ", batch_id long").parquet(os.path.join(root, "buffer"))
    # Conditions on the folder name only, so only live folders are opened.  Files
    # outside a batch folder count as a batch before the first.
    at = F.coalesce(F.col("batch_id"), F.lit(-1).cast("long"))
    live_at = (at > upto) | at.isin(names["batch"]) if upto >= 0 else F.lit(True)
    rows = rows.where(live_at).select("msg_id", "payload", F.lit("batch").alias("kind"), at.alias("at"))
    if before is not None:
        rows = rows.where(F.col("at") <= before)
    if names["cut"]:
        cut = spark.read.schema(BUFFER + ", cut long").parquet(os.path.join(root, "buffer_cut"))
        rows = rows.unionByName(cut.where(F.col("cut").isin(names["cut"])).select(
            "msg_id", "payload", F.lit("cut").alias("kind"), F.col("cut").alias("at")))
    return rows


def trim(spark: SparkSession, root: str, keep: int, upto: int) -> None:
    """L3 on the live buffer: keep the ``keep`` largest message ids of the batches
    up to ``upto``.  A replayed batch starts from the trim before it."""
    live = _live_buffer(spark, root, upto)
    folders = live.groupBy("kind", "at").agg(F.count("*").alias("n"), F.min("msg_id").alias("lo"),
                                             F.max("msg_id").alias("hi")).collect()     # one row per live folder
    if sum(f["n"] for f in folders) <= keep:
        return
    lowest = newest_by_key(live.select("msg_id"), keep, "msg_id").agg(F.min("msg_id")).first()[0]
    whole = [f for f in folders if f["lo"] >= lowest]
    split = [f for f in folders if f["lo"] < lowest <= f["hi"]]
    rows = [(f["kind"], f["at"]) for f in whole]
    if split:
        some = F.lit(False)
        for f in split:
            some = some | ((F.col("kind") == f["kind"]) & (F.col("at") == f["at"]))
        live.where(some & (F.col("msg_id") >= lowest)).select("msg_id", "payload").write.mode("overwrite").parquet(
            os.path.join(root, "buffer_cut", f"cut={upto}"))
        rows.append(("cut", upto))
    rows += [(f"old {f['kind']}", f["at"]) for f in folders if f["lo"] < lowest and f["at"] >= 0]
    _commit(spark.createDataFrame(rows, "kind string, at long"), os.path.join(root, "buffer_commits"), upto)
    drop_trimmed(spark, root, upto)


def drop_trimmed(spark: SparkSession, root: str, upto: int) -> None:
    """Remove the folders that the trim before ``upto`` left out, and the commits
    before that trim."""
    commits = os.path.join(root, "buffer_commits")
    older = _commits_below(spark, commits, "kind string, at long", upto)
    last = max((c["upto"] for c in older), default=-1)
    for c in older:
        if c["upto"] == last and c["kind"] == "old batch":
            _clear(spark, os.path.join(root, "buffer", f"batch_id={c['at']}"))
        elif c["upto"] == last and c["kind"] == "old cut":
            _clear(spark, os.path.join(root, "buffer_cut", f"cut={c['at']}"))
    for n in sorted({c["upto"] for c in older} - {last}):
        _clear(spark, os.path.join(commits, f"upto={n}"))


def _buffer_writer(root: str, keep: int | None):
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.select("msg_id", "payload").write.mode("overwrite").parquet(
            os.path.join(root, "buffer", f"batch_id={batch_id}"))
        if keep is not None:
            trim(batch.sparkSession, root, keep, batch_id)
    return write


def start(spark: SparkSession, source_dir: str, root: str, watermark: str | None = None,
          dedupe: bool = False, max_files: int | None = None, available_now: bool = True,
          keep: int | None = None, snapshot_every: int = SNAPSHOT_EVERY) -> list[StreamingQuery]:
    """Start the three queries; results and checkpoints live under ``root``.
    ``keep``: messages the buffer holds at most (None: all)."""
    src = read_events(spark, source_dir, max_files)
    ck = os.path.join(root, "_checkpoints")

    def trig(w):
        return w.trigger(availableNow=True) if available_now else w

    counters = trig(daily_totals(src, watermark, dedupe).writeStream
                    .outputMode("update")
                    .option("checkpointLocation", os.path.join(ck, "counters"))
                    .foreachBatch(_counter_writer(root, snapshot_every))).start()
    buffer = trig(ev.to_payload(ev.valid_events(src)).writeStream
                  .outputMode("append")
                  .option("checkpointLocation", os.path.join(ck, "buffer"))
                  .foreachBatch(_buffer_writer(root, keep))).start()
    rejects = trig(ev.rejected_events(src).writeStream
                   .format("parquet").outputMode("append")
                   .option("checkpointLocation", os.path.join(ck, "rejects"))
                   .option("path", os.path.join(root, "rejects"))).start()
    return [counters, buffer, rejects]


def run_once(spark: SparkSession, source_dir: str, root: str, **kw) -> None:
    """Process everything available now, then stop (one scheduled run)."""
    for q in start(spark, source_dir, root, available_now=True, **kw):
        q.awaitTermination()
        if q.exception():
            raise q.exception()


def read_daily(spark: SparkSession, root: str) -> DataFrame:
    """Newest total per (family, day): the last snapshot and the folders after it."""
    return _daily(_totals(spark, root)).drop("batch_id")


def rollup(daily: DataFrame) -> DataFrame:
    """Daily totals to the three grains (same rows as the batch rollup)."""
    keys = F.array(*[F.struct(F.lit(g).alias("grain"), period_key(g, F.col("day")).alias("period"))
                     for g in GRAINS])
    rows = daily.select("family", "value", F.inline(keys))
    agg = rows.groupBy("grain", "family", "period").agg(F.sum("value").cast("decimal(38,2)").alias("value"))
    return agg.withColumn("key", ev.counter_key(F.col("grain"), F.col("family"), F.col("period")))


def read_counters(spark: SparkSession, root: str) -> DataFrame:
    return rollup(read_daily(spark, root))


def read_buffer(spark: SparkSession, root: str) -> DataFrame:
    """The live buffer."""
    return _live_buffer(spark, root).select("msg_id", "payload")


def drain_buffer(spark: SparkSession, root: str) -> tuple[DataFrame, str]:
    """Buffered rows not consumed yet, and the folder to record them in
    (call ``commit_mark`` after the consumer succeeded; nothing is deleted).
    Ids do not arrive in order, so the consumed ids are recorded, not a mark."""
    marks = os.path.join(root, "buffer_marks")
    # An empty append makes the folder exist, so any read error is a real one.
    spark.createDataFrame([], "msg_id long").write.mode("append").parquet(marks)
    done = spark.read.schema("msg_id long").parquet(marks)
    return read_buffer(spark, root).join(done, "msg_id", "left_anti"), marks


def commit_mark(fresh: DataFrame, marks_dir: str) -> None:
    fresh.select("msg_id").write.mode("append").parquet(marks_dir)
