"""M8: an exact vector index of centroid cells pruned by the triangle inequality,
and its approximate use with a few probes.

Vectors are scaled to length 1, where a larger cosine is a smaller distance.

* **Fit.**  Centroids come from a bounded sample of the vectors (``SAMPLE`` rows in
  hash order).  Any centroids give exact results; better ones read fewer cells.
* **Index.**  Every row goes to its nearest centroid's cell, with its distance.
  The written table is clustered by cell; each cell's size and radius (largest
  distance) are one row of a small table.
* **Search.**  A query reads its nearest cells until they hold ``k`` rows; the
  ``k``-th distance found is a bound.  Then it reads the other cells whose
  distance minus radius is within the bound: no other can hold a row as near.
  Within a cell, rows whose distance to the centroid differs from the query's by
  more than the bound are skipped too.  Big cells are read in blocks.
* **Scores.**  Products in single precision, with a margin above their rounding, name
  the rows that may be among a query's first; only these are scored in double precision.
* **Probes.**  ``probe_search`` reads the nearest ``probes`` cells only; ``recall``
  measures it against the exact result.  ``choose_probes`` reads a cell once: twice as
  many probes add the cells not read before, within the bound of what was found.

Rows without a direction (all zeros) have cosine 0 with everything; they form a
cell of their own that every query reads.  Rows without a vector are not indexed,
queries without one have no matches.  Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE = 20_000
ROUNDS = 8
BLOCK_ROWS = 32_768      # rows of one cell scored together
QBLOCK_ROWS = 32_768     # queries of one cell scored together
CHUNK_SCORES = 1 << 20   # scores held at once
SEGMENTS = 128           # parts of a block whose largest scores are looked at first
RESCORED = 1 << 16       # pairs scored at once in double precision
DEALT = 3                # query partitions a core
PAIRS = 8192             # (query, cell) pairs made at once
PLANNED = ["qid", "vec", "bound", "to_centre", "cell"]
SLACK = 1e-6             # bounds are widened by this, so that rounding skips no row
ZERO = -1                # the cell of vectors without a direction


def unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a ** 2).sum(axis=1)[:, None] + (b ** 2).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0.0))


def fit_centroids(corpus: DataFrame, cells: int, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of at most ``cells`` groups of the sampled vectors (``id``, ``values``)."""
    some = (corpus.where(F.col("values").isNotNull()).orderBy(F.xxhash64("id", F.lit(23)), "id").limit(sample)
            .select("values").toPandas()["values"])
    rows = unit(np.stack([np.asarray(v, np.float64) for v in some])) if len(some) else np.zeros((0, 1))
    rows = np.unique(rows[np.abs(rows).sum(axis=1) > 0], axis=0)
    rows = rows[np.random.default_rng(7).permutation(len(rows))]
    centres = rows[:cells].copy()
    for _ in range(rounds):
        near = distances(rows, centres).argmin(axis=1) if len(centres) else np.empty(0, int)
        for c in range(len(centres)):
            mine = rows[near == c]
            if len(mine):
                centres[c] = mine.mean(axis=0)
    return centres


@dataclass
class CellIndex:
    rows: DataFrame              # cell, block, id, vec, dist
    cells: pd.DataFrame          # cell, n, radius: one row per cell
    centres: np.ndarray


def build(corpus: DataFrame, centres: np.ndarray, path: str, block_rows: int = BLOCK_ROWS) -> CellIndex:
    """Write the index of ``corpus`` (``id``, ``values``) under ``path``."""
    spark = corpus.sparkSession

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            if df.empty:
                continue
            v = unit(np.stack([np.asarray(x, np.float64) for x in df["values"]]))
            some = np.abs(v).sum(axis=1) > 0
            cell, dist = np.full(len(v), ZERO), np.zeros(len(v))
            if some.any() and len(centres):
                d = distances(v[some], centres)
                cell[some] = d.argmin(axis=1)
                dist[some] = d.min(axis=1)
            yield pd.DataFrame({"cell": cell.astype(np.int32), "id": df["id"], "vec": list(v), "dist": dist})
    rows = corpus.where(F.col("values").isNotNull()).select("id", "values").mapInPandas(
        assign, "cell int, id string, vec array<double>, dist double")
    # A cell may hold most rows, so it is dealt out by id as well and written as several files.
    rows.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(16))).sortWithinPartitions("cell").write.mode(
        "overwrite").parquet(f"{path}/rows")
    stored = spark.read.schema("cell int, id string, vec array<double>, dist double").parquet(f"{path}/rows")
    stats = stored.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("radius")).toPandas()
    return CellIndex(stored, stats.sort_values("cell", ignore_index=True), centres)


def _plan(index: CellIndex, pick):
    """Query rows (qid, qvec, bound) -> a row per cell to read, and how many there are by cell."""
    cell = index.cells["cell"].to_numpy()
    n, radius = index.cells["n"].to_numpy(), index.cells["radius"].to_numpy()
    centres = np.stack([index.centres[c] if c != ZERO else np.zeros(index.centres.shape[1]) for c in cell]) \
        if len(cell) else np.zeros((0, 1))

    def picked(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if not batch.num_rows or not len(cell):
                continue
            q = unit(np.stack([np.asarray(x, np.float64) for x in batch.column("qvec").to_numpy(zero_copy_only=False)]))
            d, bound = distances(q, centres), batch.column("bound").to_numpy()
            yield batch.column("qid"), q, bound, d, *np.nonzero(pick(d, n, radius, cell, bound))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for qid, q, bound, d, every_row, every_col in picked(batches):
            for a in range(0, len(every_row), PAIRS):
                row, col = every_row[a:a + PAIRS], every_col[a:a + PAIRS]
                vec = pa.ListArray.from_arrays(np.arange(len(row) + 1, dtype=np.int32) * q.shape[1], q[row].ravel())
                yield pa.RecordBatch.from_arrays([qid.take(pa.array(row)), vec, pa.array(bound[row]), pa.array(d[row, col]),
                                                  pa.array(cell[col].astype(np.int32))], names=PLANNED)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *_, col in picked(batches):
            some, of = np.unique(col, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell[some].astype(np.int32)), pa.array(of)], names=["cell", "n"])
    return pairs, counts


def _nearest(k: int):
    """The nearest cells that hold ``k`` rows between them."""
    def pick(d, n, radius, cell, bound):
        d = np.where(cell[None, :] == ZERO, np.inf, d)
        order = np.argsort(d, axis=1, kind="stable")
        before = np.cumsum(n[order], axis=1) - n[order]
        out = np.zeros(d.shape, bool)
        np.put_along_axis(out, order, before < k, axis=1)
        return out | (cell[None, :] == ZERO)
    return pick


def _within(k: int):
    """Cells that may hold a row within the bound and were not read first."""
    first = _nearest(k)

    def pick(d, n, radius, cell, bound):
        return (d - radius[None, :] <= bound[:, None] + SLACK) & ~first(d, n, radius, cell, bound)
    return pick


def _probed(probes: int, before: int = 0):
    """The nearest ``probes`` cells without the nearest ``before``, as far as the bound goes."""
    def pick(d, n, radius, cell, bound):
        far = np.where(cell[None, :] == ZERO, np.inf, d)
        out = np.zeros(d.shape, bool)
        np.put_along_axis(out, np.argsort(far, axis=1, kind="stable")[:, before:probes], True, axis=1)
        if not before:
            return out | (cell[None, :] == ZERO)
        return out & (cell[None, :] != ZERO) & (d - radius[None, :] <= bound[:, None] + SLACK)
    return pick


def _scan(k: int):
    """The best rows of a block for each of its queries, scored as matrix products."""
    def best(q, rows, near, rank, bound):
        """(query, row, score) of each query's first ``k`` rows within its bound;
        ``near``: both in single precision."""
        scores = near[0] @ near[1].T
        margin = (rows.shape[1] + 8) * np.finfo(np.float32).eps
        # A row within the bound has a cosine of at least 1 - bound^2 / 2.
        floor = 1.0 - (bound + SLACK) ** 2 / 2 - SLACK
        n = scores.shape[1]
        parts = min(n, max(SEGMENTS, 16 * k))
        size = n // parts
        # The largest score of each part; rows beyond the last whole part are parts of their own.
        top = np.concatenate([scores[:, :size * parts].reshape(len(q), size, parts).max(axis=1), scores[:, size * parts:]], axis=1)
        least = floor - margin
        if top.shape[1] > k:
            # At least k rows score as much as the k-th of the parts.
            least = np.maximum(least, np.partition(top, top.shape[1] - k, axis=1)[:, top.shape[1] - k] - 2 * margin)
        least = least.astype(np.float32)
        r, at = np.nonzero(top >= least[:, None])
        whole = at < parts
        cols = at[whole, None] + parts * np.arange(size)
        hit = scores[r[whole, None], cols] >= least[r[whole], None]
        r, at = (np.concatenate(x) for x in ((np.repeat(r[whole], hit.sum(axis=1)), r[~whole]),
                                             (cols[hit], at[~whole] + (size - 1) * parts)))
        if 16 * len(r) > scores.size:
            s = (q @ rows.T)[r, at]
        else:
            cuts = range(0, len(r), RESCORED)
            s = np.concatenate([np.empty(0)] + [np.einsum("ij,ij->i", q[r[a:a + RESCORED]], rows[at[a:a + RESCORED]]) for a in cuts])
        near_enough = s >= floor[r]
        # Rounded, so that equal vectors tie whatever block they are scored in.
        r, at, s = r[near_enough], at[near_enough], np.round(s[near_enough], 12)
        order = np.lexsort((rank[at], -s, r))
        r, at, s = r[order], at[order], s[order]
        first = np.arange(len(r)) - np.searchsorted(r, r) < k
        return r[first], at[first], s[first]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"qid": np.empty(0, np.int64), "id": np.empty(0, object), "score": np.empty(0)})
        if not (len(left) and len(right)):
            return none
        left, right = left.sort_values("to_centre", ignore_index=True), right.sort_values("dist", ignore_index=True)
        ids, qids, dist = right["id"].to_numpy(), left["qid"].to_numpy(), right["dist"].to_numpy()
        rank = np.unique(ids.astype(str), return_inverse=True)[1]
        rows, q = (np.stack(df["vec"].to_numpy()).astype(np.float64) for df in (right, left))
        near_rows, near_q = rows.astype(np.float32), q.astype(np.float32)
        bound, to = left["bound"].to_numpy(), left["to_centre"].to_numpy()
        zero = right["cell"].iloc[0] == ZERO
        out = []
        for a in range(0, len(q), max(1, CHUNK_SCORES // len(rows))):
            b = a + max(1, CHUNK_SCORES // len(rows))
            # Rows whose distance to the centre differs by more than the bound from every query's are skipped.
            lo, hi = (0, len(rows)) if zero else np.searchsorted(
                dist, [(to[a:b] - bound[a:b]).min() - SLACK, (to[a:b] + bound[a:b]).max() + SLACK])
            if hi > lo:
                r, at, s = best(q[a:b], rows[lo:hi], (near_q[a:b], near_rows[lo:hi]), rank[lo:hi], bound[a:b])
                out.append((qids[a:b][r], ids[lo:hi][at], s))
        return pd.DataFrame(dict(zip(none.columns, map(np.concatenate, zip(*out))))) if out else none
    return run


def _read_cells(index: CellIndex, asked: DataFrame, asked_n: dict[int, int], k: int, block_rows: int) -> DataFrame:
    """The best rows of the asked (query, cell) pairs, by blocks of a cell's rows and of its queries."""
    n = dict(zip(index.cells["cell"].tolist(), index.cells["n"].tolist()))
    counts = [(c, max(1, -(-n[c] // block_rows)), -(-queries // QBLOCK_ROWS)) for c, queries in asked_n.items()]     # one row per cell
    spark = asked.sparkSession
    counts = F.broadcast(spark.createDataFrame(counts, "cell int, blocks int, parts int"))

    def other(n):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def own(key, n):
        return F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    # Cells nobody asks for are not shuffled.
    left = asked.join(counts, "cell").withColumn("block", other("blocks")).withColumn("part", own("qid", "parts"))
    right = index.rows.join(counts, "cell").withColumn("part", other("parts")).withColumn("block", own("id", "blocks"))
    key = ["cell", "block", "part"]
    kind = asked.schema["qid"].dataType
    schema = T.StructType([T.StructField("qid", kind), T.StructField("id", T.StringType()), T.StructField("score", T.DoubleType())])
    return (left.drop("blocks", "parts").groupBy(*key).cogroup(right.drop("blocks", "parts").groupBy(*key))
            .applyInPandas(_scan(k), schema))


def _first(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _asked(index: CellIndex, queries: DataFrame, pick) -> tuple[DataFrame, dict[int, int]]:
    """The (query, cell) pairs to read, and how many there are by cell.  The queries
    are dealt out and written once; their pairs, each with a vector, are made anew."""
    schema = T.StructType([T.StructField("qid", queries.schema["qid"].dataType)]
                          + T.StructType.fromDDL("vec array<double>, bound double, to_centre double, cell int").fields)
    parts = DEALT * queries.sparkSession.sparkContext.defaultParallelism
    dealt = queries.repartition(parts).checkpoint(eager=True)
    pairs, counts = _plan(index, pick)
    n = dealt.mapInArrow(counts, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    return dealt.mapInArrow(pairs, schema), {r.cell: r.n for r in n}


def _unbounded(queries: DataFrame) -> DataFrame:
    return queries.where(F.col("qvec").isNotNull()).select("qid", "qvec", F.lit(float("inf")).alias("bound"))


def _bounded(queries: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The queries with the distance of the k-th row found so far, from its cosine
    (queries and rows of length 1; a zero query reads all)."""
    bound = found.groupBy("qid").agg(F.when(F.count("*") >= k, F.sqrt(F.greatest(F.lit(0.0), 2.0 - 2.0 * F.min("score")))).alias("_bound"))
    return queries.join(bound, "qid", "left").select("qid", "qvec", F.coalesce("_bound", "bound").alias("bound"))


def search(index: CellIndex, queries: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """(exact top ``k`` of every query (qid, qvec): qid, id, score, rank; how many
    (query, cell) pairs were read)."""
    q = _unbounded(queries)
    start, start_n = _asked(index, q, _nearest(k))
    one = _first(_read_cells(index, start, start_n, k, block_rows), k).checkpoint(eager=True)
    more, more_n = _asked(index, _bounded(q, one, k), _within(k))
    two = _read_cells(index, more, more_n, k, block_rows)
    out = _first(one.select("qid", "id", "score").unionByName(two), k)
    return out, sum(start_n.values()) + sum(more_n.values())


def probe_search(index: CellIndex, queries: DataFrame, k: int, probes: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Approximate top ``k`` from the nearest ``probes`` cells."""
    return _first(_read_cells(index, *_asked(index, _unbounded(queries), _probed(probes)), k, block_rows), k)


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """One row: exact matches, how many of them were found, and the share."""
    hit = exact.select("qid", "id").join(found.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    return hit.agg(F.count("*").alias("n"), F.count("hit").alias("n_found"), (F.count("hit") / F.count("*")).alias("recall"))


def choose_probes(index: CellIndex, queries: DataFrame, exact: DataFrame, k: int, target: float = 0.9,
                  block_rows: int = BLOCK_ROWS) -> tuple[int, float]:
    """The fewest probes, doubling from 1, whose recall against ``exact`` reaches
    ``target``, and that recall (all cells give 1).  What ``probe_search`` finds with
    twice the probes is the best of what was found and of the cells between."""
    probes = 1
    q = _unbounded(queries)
    found = probe_search(index, queries, k, probes, block_rows).checkpoint(eager=True)
    while True:
        share = recall(exact, found).first()["recall"]
        if share is None or share >= target or probes >= len(index.cells):
            return probes, share
        more, more_n = _asked(index, _bounded(q, found, k), _probed(2 * probes, before=probes))
        new = _read_cells(index, more, more_n, k, block_rows)
        found = _first(found.select("qid", "id", "score").unionByName(new), k).checkpoint(eager=True)
        probes *= 2
