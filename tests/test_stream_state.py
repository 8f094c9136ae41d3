"""Live buffer trim, counter snapshots and replayed batches."""

import os
import re

from pyspark.sql import functions as F

from storecast.operators.events import counter_rollup, valid_events
from storecast.streaming import counters as sc

WIRE = "msg_id long, date string, store_nbr string, family string, sales string, onpromotion string"


def _batch(spark, ids):
    return spark.createDataFrame([(i, f"2024-01-{1 + i % 28:02d}", "1", "AB"[i % 2], f"{i % 7}.5", "0") for i in ids], WIRE)


def _folders(df):
    return {re.search(r"(batch_id|cut|upto)=(-?\d+)", f).group(0) for f in
            [r[0] for r in df.select(F.input_file_name()).distinct().collect()]}


def test_trim_keeps_the_newest_and_rewrites_only_the_folder_of_the_cut(spark, tmp_dir):
    src, root = os.path.join(tmp_dir, "src"), os.path.join(tmp_dir, "out")
    batches = [range(0, 40), range(40, 80), range(80, 120), [5, 200, 201], range(120, 130)]
    seen = []
    for ids in batches:
        sc.append_events(_batch(spark, ids), src)
        sc.run_once(spark, src, root, keep=50)
        seen += ids
        got = [r.msg_id for r in sc.read_buffer(spark, root).orderBy("msg_id").collect()]
        assert got == sorted(seen)[-50:]
    live = sc._live_buffer(spark, root).select("kind", "at").distinct().collect()
    # The last batches are whole; what is left of the older ones is one rewritten folder.
    assert ("batch", 4) in {(r["kind"], r["at"]) for r in live} and len([r for r in live if r["kind"] == "cut"]) == 1
    # A replay of the last batch (its folder, its trim) gives the same rows.
    again = sc.ev.to_payload(sc.ev.valid_events(_batch(spark, batches[-1])))
    sc._buffer_writer(root, 50)(again, 4)
    assert [r.msg_id for r in sc.read_buffer(spark, root).orderBy("msg_id").collect()] == sorted(seen)[-50:]


def test_untrimmed_buffer_keeps_every_message(spark, tmp_dir):
    src, root = os.path.join(tmp_dir, "src"), os.path.join(tmp_dir, "out")
    sc.append_events(_batch(spark, range(30)), src)
    sc.run_once(spark, src, root, keep=100)
    assert sc.read_buffer(spark, root).count() == 30


def test_fifty_batches_open_a_bounded_number_of_folders(spark, tmp_dir):
    root = os.path.join(tmp_dir, "out")
    write = sc._counter_writer(root, 10)
    schema = "family string, day date, value decimal(38,2), n_events long"
    for n in range(50):
        rows = [("A", "2024-01-01", n + 1, n + 1), (f"f{n % 7}", "2024-01-02", n, 1)]
        batch = spark.createDataFrame(rows, "family string, d string, v long, n_events long").select(
            "family", F.col("d").cast("date").alias("day"), F.col("v").cast("decimal(38,2)").alias("value"), "n_events")
        assert batch.schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString()
        write(batch, n)
        if n == 44:
            assert len(_folders(sc._totals(spark, root))) <= 10
    got = {(r.family, int(r.value)) for r in sc.read_daily(spark, root).collect()}
    assert got == {("A", 50)} | {(f"f{k}", max(n for n in range(50) if n % 7 == k)) for k in range(7)}
    assert len(_folders(sc._totals(spark, root))) <= 10
    # A replayed batch that ends a snapshot writes the same totals again.
    write(batch, 49)
    assert {(r.family, int(r.value)) for r in sc.read_daily(spark, root).collect()} == got


def test_snapshots_equal_the_batch_rollup(spark, tmp_dir):
    src, root = os.path.join(tmp_dir, "src"), os.path.join(tmp_dir, "out")
    wire = _batch(spark, range(90))
    for k in range(3):
        sc.append_events(wire.where(F.col("msg_id") % 3 == k), src)
        sc.run_once(spark, src, root, snapshot_every=2)
    want = {(r.grain, r.family, r.period, r.value) for r in counter_rollup(valid_events(wire)).collect()}
    assert {(r.grain, r.family, r.period, r.value) for r in sc.read_counters(spark, root).collect()} == want


def _files(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder)
                  for f in names if f.startswith("part-"))


def _holding(folder):
    return {os.path.dirname(f) for f in _files(folder)}


def test_old_snapshots_and_their_batches_are_removed(spark, tmp_dir):
    root = os.path.join(tmp_dir, "out")
    write = sc._counter_writer(root, 3)

    def batch(n):
        return spark.createDataFrame([("A", "2024-01-01", n, 1), (f"f{n % 4}", "2024-01-02", n, 1)],
                                     "family string, d string, v long, n_events long").select(
            "family", F.col("d").cast("date").alias("day"), F.col("v").cast("decimal(38,2)").alias("value"), "n_events")

    def want(last):
        return {("A", last)} | {(f"f{k}", max(n for n in range(last + 1) if n % 4 == k)) for k in range(4)}

    def got():
        return {(r.family, int(r.value)) for r in sc.read_daily(spark, root).collect()}

    for n in range(14):
        write(batch(n), n)
    # Snapshots at 2, 5, 8 and 11: the last two stay, with the batches after the older of them.
    assert got() == want(13)
    assert _holding(os.path.join(root, "snapshots")) == {"upto=8", "upto=11"}
    assert _holding(os.path.join(root, "snapshot_commits")) - {"upto=-1"} == {"upto=8", "upto=11"}
    assert _holding(os.path.join(root, "counters")) == {f"batch_id={n}" for n in range(6, 14)}
    write(batch(14), 14)
    left = _files(os.path.join(root, "counters"))
    write(batch(14), 14)                       # a replay of the batch that removes
    assert got() == want(14) and len(_files(os.path.join(root, "counters"))) == len(left)
    # A run that died after the snapshot was written, before anything was removed.
    for n in (15, 16, 17):
        batch(n).write.mode("overwrite").parquet(os.path.join(root, "counters", f"batch_id={n}"))
    sc.snapshot(spark, root, 17)
    assert got() == want(17)
    write(batch(17), 17)
    assert got() == want(17) and _holding(os.path.join(root, "snapshots")) == {"upto=14", "upto=17"}


def test_trimmed_folders_are_removed_one_trim_later(spark, tmp_dir):
    src, root = os.path.join(tmp_dir, "src"), os.path.join(tmp_dir, "out")
    seen = []
    for k in range(6):
        ids = range(40 * k, 40 * k + 40)
        sc.append_events(_batch(spark, ids), src)
        sc.run_once(spark, src, root, keep=50)
        seen += ids
        assert [r.msg_id for r in sc.read_buffer(spark, root).orderBy("msg_id").collect()] == seen[-50:]
    # The live folders of the last two trims, and no commit before those.
    assert _holding(os.path.join(root, "buffer")) == {"batch_id=4", "batch_id=5"}
    assert _holding(os.path.join(root, "buffer_cut")) == {"cut=4", "cut=5"}
    assert _holding(os.path.join(root, "buffer_commits")) - {"upto=-1"} == {"upto=4", "upto=5"}
    again = sc.ev.to_payload(sc.ev.valid_events(_batch(spark, range(200, 240))))
    sc._buffer_writer(root, 50)(again, 5)
    assert [r.msg_id for r in sc.read_buffer(spark, root).orderBy("msg_id").collect()] == seen[-50:]
