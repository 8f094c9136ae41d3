"""The pruned cell index against brute force."""

import os

import numpy as np
import pytest

from storecast.operators import cellindex as ci


def brute(rows, queries, k):
    out = set()
    r = ci.unit(np.array([v for _, v in rows], float))
    for qid, q in queries:
        s = r @ ci.unit(np.array([q], float))[0]
        best = sorted(range(len(rows)), key=lambda i: (-round(s[i], 9), rows[i][0]))[:k]
        out |= {(qid, n + 1, rows[i][0]) for n, i in enumerate(best)}
    return out


@pytest.mark.parametrize("spread,cells,block", [(0.05, 12, 8192), (2.0, 7, 40)])
def test_equals_brute_force_and_reads_fewer_cells(spark, tmp_dir, spread, cells, block):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    rows = [(f"r{i:04d}", (centres[i % 12] + spread * rng.normal(size=8)).tolist()) for i in range(600)]
    rows += [(f"t{i}", rows[5][1]) for i in range(30)] + [("z1", [0.0] * 8), ("z2", [0.0] * 8)]
    queries = [(i, (centres[i % 12] + spread * rng.normal(size=8)).tolist()) for i in range(25)]
    queries += [(100, [0.0] * 8), (101, rows[5][1])]
    corpus = spark.createDataFrame([*rows, ("none", None)], "id string, values array<double>")
    asked = spark.createDataFrame([*queries, (102, None)], "qid long, qvec array<double>")
    index = ci.build(corpus, ci.fit_centroids(corpus, cells), os.path.join(tmp_dir, "cells"))
    found, read = ci.search(index, asked, 7, block_rows=block)
    assert {(r.qid, r["rank"], r.id) for r in found.collect()} == brute(rows, queries, 7)
    total = len(queries) * len(index.cells)
    assert read <= total and (spread > 1 or read < total / 2)
    probed = ci.probe_search(index, asked.where("qid < 100"), 7, probes=len(index.cells), block_rows=block)
    assert ci.recall(found.where("qid < 100"), probed).first().recall == 1.0
    probes, share = ci.choose_probes(index, asked.where("qid < 100"), found.where("qid < 100"), 7)
    assert share >= 0.9 and 1 <= probes < 2 * len(index.cells)
    few = ci.recall(found.where("qid < 100"), ci.probe_search(index, asked.where("qid < 100"), 7, 2)).first()
    assert few.n == 7 * 25 and (spread > 1 or few.recall >= 0.9)


def test_empty_corpus(spark, tmp_dir):
    corpus = spark.createDataFrame([], "id string, values array<double>")
    asked = spark.createDataFrame([(1, [1.0])], "qid long, qvec array<double>")
    index = ci.build(corpus, ci.fit_centroids(corpus, 4), os.path.join(tmp_dir, "cells"))
    found, read = ci.search(index, asked, 3)
    assert found.count() == 0 and read == 0
