"""Round 4: what a step holds at once, and work done more than once."""

import os

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from storecast.models import boost
from storecast.operators import cellindex as ci


def numbers(spark, n, parts=4):
    a, b = F.col("id") % 7, F.col("id") * 7919 % 1009
    return spark.range(0, n, 1, parts).select(a.cast("double").alias("a"), b.cast("double").alias("b"),
                                             (F.col("id") % 3).cast("double").alias("c"), (a * 2 + b / 100).alias("sales"))


def test_features_of_few_bins_share_a_byte(spark):
    widths = [256, 6, 11, 6, 256, 2, 25, 5]
    rng = np.random.default_rng(0)
    bins = [rng.integers(0, w, 500) for w in widths]
    where = boost.places(widths)
    stored = np.zeros((max(k for k, _ in where) + 1, 500), np.int64)
    for (k, step), b in zip(where, bins):
        stored[k] += b * step
    assert len(stored) == 5 and stored.max() < 256
    assert all((stored[k] // step % w == b).all() for (k, step), w, b in zip(where, widths, bins))
    p = boost.prepare(numbers(spark, 3000), numbers(spark, 10), 256, ("a", "b", "c"))
    assert all(r.bins == 2 * r.n for r in p.blocks.select("n", F.length("bins").alias("bins")).collect())


def test_a_reader_of_blocks_holds_a_small_row_group(spark, monkeypatch):
    monkeypatch.setattr(boost, "BLOCK_ROWS", 1000)
    monkeypatch.setattr(boost, "ROW_GROUP", 40_000)
    p = boost.prepare(numbers(spark, 40_000), numbers(spark, 10), 256, ("a", "b", "c"))
    folder = os.path.join(p.root, "start").removeprefix("file:")
    groups = [m.row_group(i).total_byte_size for f in os.listdir(folder) if f.endswith(".parquet")
              for m in [pq.ParquetFile(os.path.join(folder, f)).metadata] for i in range(m.num_row_groups)]
    assert len(groups) >= 10 and max(groups) < 80_000


def test_blocks_reach_a_worker_one_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(boost, "BLOCK_ROWS", 20_000)
    p = boost.prepare(numbers(spark, 400_000, 2), numbers(spark, 10), 256, ("a", "b", "c"))
    blocks = boost._kept(boost._stored(p.blocks.where(~F.col("validation")), 1))
    batches = blocks._jrdd.count()      # what is sent to a worker as a whole
    assert blocks.getNumPartitions() == 1 and batches >= blocks.count() // 2 >= 10
    blocks.unpersist()


def test_a_worker_keeps_a_bounded_state(monkeypatch):
    monkeypatch.setattr(boost, "_SEEN", {})
    monkeypatch.setattr(boost, "SEEN_BYTES", 2500)
    tree = boost.Tree()
    tree.split(0, 0, 3, 1.0)
    route = boost.routes(tree.arrays(), [10])
    bins = np.arange(1000, dtype=np.uint8).reshape(1, -1) % 10
    for nth in range(5):
        assert (boost._nodes(("x", 0, nth), route, 1, bins) == 1 + (bins[0] > 3)).all()
    assert len(boost._SEEN) == 2 and all(held[1].base is None for held in boost._SEEN.values())
    boost._nodes(("y", 0, 0), route, 1, bins)
    assert list(boost._SEEN) == [("y", 0, 0)]


def test_blocks_written_before_are_removed(spark):
    x = numbers(spark, 2000)
    before = os.path.dirname(spark.sparkContext.getCheckpointDir().removeprefix("file:") + "/")

    def written():
        return sum(len(files) for folder, _, files in os.walk(before) if "rdd-" in folder)
    was = written()
    boost.fit(x, numbers(spark, 100), 7, 0.3, 2, features=("a", "b", "c"))
    assert written() == was


def test_sums_that_a_double_cannot_hold_are_added_in_parts():
    n = 64
    label, pred = np.zeros(n), np.full(n, 2.0 ** 50) + np.arange(n) * 2.0 ** -2
    record = np.zeros((1, n), np.uint8).tobytes(), label.tobytes(), pred.tobytes()
    run = boost._summer("x", [], boost.Tree().arrays(), 0, np.zeros(1, np.int32), 1, np.array([0, 1]), 4.0)
    (_, (at, g, rows)), = run(0, iter([record]))
    assert rows.tolist() == [n] and g.tolist() == [n * 2 ** 52 + n * (n - 1) // 2]


def test_probes_are_chosen_by_reading_every_cell_once_from_dealt_queries(spark, tmp_dir, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(f"r{i:03d}", v.tolist()) for i, v in enumerate(rng.normal(size=(300, 5)))] + [("z", [0.0] * 5)]
    corpus = spark.createDataFrame(rows, "id string, values array<double>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 5)))], "qid long, qvec array<double>").coalesce(1)
    index = ci.build(corpus, ci.fit_centroids(corpus, 6), os.path.join(tmp_dir, "cells"))
    exact = ci.search(index, asked, 4)[0].checkpoint(eager=True)
    read, parts, plain = [], [], ci._asked

    def counted(*a):
        pairs, n = plain(*a)
        read.append(sum(n.values()))
        parts.append(pairs.rdd.getNumPartitions())
        return pairs, n
    monkeypatch.setattr(ci, "_asked", counted)
    chosen = ci.choose_probes(index, asked, exact, 4, target=0.999)
    assert sum(read) <= 40 * len(index.cells) and set(parts) == {ci.DEALT * spark.sparkContext.defaultParallelism}
    monkeypatch.setattr(ci, "_asked", plain)
    shares = {p: ci.recall(exact, ci.probe_search(index, asked, 4, p)).first().recall for p in (1, 2, 4, 8)}
    assert chosen[1] == shares[chosen[0]] and chosen[0] == min(p for p, s in shares.items() if s >= 0.999 or p == 8)


def test_rows_equal_to_single_precision_are_told_apart():
    rng = np.random.default_rng(6)
    one = ci.unit(rng.normal(size=(1, 16)))[0]
    rows = ci.unit(np.array([one + 1e-9 * i * rng.normal(size=16) for i in range(600)]))
    left = pd.DataFrame({"qid": [1], "vec": [one], "bound": [np.inf], "to_centre": [0.5], "cell": [0]})
    right = pd.DataFrame({"cell": 0, "id": [f"{i:04d}" for i in range(600)], "vec": list(rows), "dist": 0.5})
    got = ci._scan(5)(left, right)
    s = np.round(rows @ one, 12)
    want = sorted(range(600), key=lambda i: (-s[i], i))[:5]
    assert got["id"].tolist() == [f"{i:04d}" for i in want] and np.allclose(got["score"], s[want], atol=1e-11)
