"""Hard-negative mining by threshold joins over an inverted index.

1. **Classes.**  Rows of equal label and vector are one class, which keeps the
   few smallest ids that any window can need.  A group limit cuts on the map
   side, so copies of one vector never meet in one task.
2. **Cells.**  Anchor classes and row classes are dealt into blocks; a pair of
   blocks is one cell, small enough for a worker, and searched as a whole.
3. **Threshold join** in a cell.  Dimensions come in descending order of their
   energy over all rows.  For a threshold t the index holds, dimension by
   dimension, the rows and their values; a row's dimensions from j on are left
   out where its suffix norm times the largest suffix norm of the anchors at
   hand stays below t.  Partial scores are accumulated list by list; after each
   group of lists, rows whose partial score plus the product of the remaining
   norms stays below the threshold of every anchor are pruned.  Survivors are
   scored exactly.
4. **Windows.**  A window asks for the first few rows with a score in [lo, hi].
   Its threshold starts near hi and is lowered until the window is full or the
   threshold has reached lo.  First every anchor class's positives are found in
   its own label; each positive score then opens a window for negatives among
   the other labels.  Cells return at most a window's length a window; a group
   limit keeps the first ones overall.

Scores are integers, exact in doubles up to 2^53 and in 64 bits beyond; larger
ones raise OverflowError.  Rows with a null label, a null vector or a null or
non-finite component take no part.  A vector shorter than others ends in zeros.
Repeated rows are rows of their own: an anchor's copy is an other row, and every
row with an anchor's id is an anchor.  Ties go to the smaller id; a null id comes
last.  An anchor without positives, or a positive without negatives in its
window, gives no rows.  An empty table gives none.  Only the id, label and vector
are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storecast.llm.common import saved

CELL_ROWS = 16_384
CELL_ANCHORS = 16_384
CHUNK = 256                 # anchors searched together within a cell
LISTS = 8                   # dimensions accumulated between two prunings
STEPS = (0.125, 0.25, 0.5)      # how far a window's threshold is lowered, turn by turn; then to lo
FULL_SHARE = 0.5            # of the best possible score: where an open-ended window's threshold starts
POSITIVES, NEGATIVES = 5, 3
LAST_ID = (1 << 63) - 1     # stands for a null id, which comes last
SPLIT_ROWS = 20_000         # anchors of one class that one task answers

HITS = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("window", T.LongType()),
                     T.StructField("score", T.LongType()), T.StructField("vec_id", T.LongType())])


def finite(vector: Column) -> Column:
    return vector.isNotNull() & F.coalesce(F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))),
        F.lit(False))


def whole_components(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256.0).cast("long"))


# -- the threshold join ---------------------------------------------------------


def _norms(m: np.ndarray) -> np.ndarray:
    """Norms of the suffixes of every row, from each group of lists on (and 0 after the last)."""
    squares = np.cumsum((m[:, ::-1] ** 2), axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([squares[:, ::LISTS], np.zeros((len(m), 1))], axis=1))


class Index:
    """Rows of a cell, searched with thresholds."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.norms = _norms(rows)
        self.groups = self.norms.shape[1] - 1

    def candidates(self, anchors: np.ndarray, norms: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
        """Rows whose score with some anchor may reach that anchor's threshold.
        Bounds are widened a little, so that rounding leaves no row out."""
        low = thresholds.min()
        # Depth: groups of lists that hold a row; the rest is covered by the suffix norms.
        covered = self.norms * norms.max(axis=0) * (1 + 1e-9) + 1e-6 < low
        depth = np.where(covered.any(axis=1), covered.argmax(axis=1), self.groups)
        order = np.argsort(-depth, kind="stable")
        order = order[:int((depth > 0).sum())]
        depth = depth[order]
        score = np.zeros((len(anchors), len(order)))
        for g in range(self.groups):
            n = int(np.searchsorted(-depth, -g, "left"))       # rows with depth > g come first
            if not n:
                break
            cut = slice(g * LISTS, (g + 1) * LISTS)
            score[:, :n] += anchors[:, cut] @ self.rows[order[:n], cut].T
            rest = norms[:, g + 1][:, None] * self.norms[order, g + 1][None, :]
            # A row that left the lists earlier has more than this group's rest before it.
            rest[:, n:] = norms.max(axis=0)[depth[n:]][None, :] * self.norms[order[n:], depth[n:]][None, :]
            alive = (score + rest * (1 + 1e-9) + 1e-6 >= thresholds[:, None]).any(axis=0)
            if not alive.all():
                order, depth, score = order[alive], depth[alive], score[:, alive]
        return np.sort(order)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer scores."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2.0 ** 53:
        return (a @ b.T).astype(np.int64)
    if most >= 2.0 ** 63:
        raise OverflowError("scores of these vectors do not fit in 64 bits")
    return a.astype(np.int64) @ b.astype(np.int64).T


def first_of(scores: np.ndarray, rows: np.ndarray, ids: list[list[int]], k: int) -> list[tuple[int, int]]:
    """The first ``k`` (score, id) of some rows, by descending score and ascending id."""
    if len(rows) > k:
        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, rows = scores[keep], rows[keep]
    every = [(-s, i) for s, r in zip(scores.tolist(), rows.tolist()) for i in ids[r][:k]]
    return [(-s, i) for s, i in sorted(every)[:k]]


def search_cell(anchors: np.ndarray, anchor_labels: np.ndarray, windows: list[list[tuple[int, int, int]]],
                rows: np.ndarray, row_labels: np.ndarray, ids: list[list[int]], k: int, same_label: bool):
    """Yields (anchor number, window, score, id).  ``windows``: (name, lo, hi) of
    every anchor; hi may be ``LAST_ID`` (open)."""
    index = Index(rows)
    count = np.array([min(len(i), k) for i in ids], np.int64)
    norms = _norms(anchors)
    top = index.norms[:, 0].max(initial=0.0)
    for at in range(0, len(anchors), CHUNK):
        open_ = []
        for i in range(at, min(at + CHUNK, len(anchors))):
            reach = float(norms[i, 0]) * top
            for name, lo, hi in windows[i]:
                if hi == LAST_ID:
                    levels = [reach * FULL_SHARE, reach * FULL_SHARE / 2, 0.0, -reach - 1]
                else:
                    levels = [*(hi - (hi - lo) * f for f in STEPS), lo]
                open_.append((i, name, hi, levels))
        turn = 0
        while open_:
            # An anchor's threshold is the lowest of its open windows.
            low: dict[int, float] = {}
            for i, _, _, levels in open_:
                low[i] = min(low.get(i, np.inf), levels[turn])
            who = np.array(sorted(low), np.int64)
            found = index.candidates(anchors[who], norms[who], np.array([low[i] for i in who.tolist()]))
            score = _product(anchors[who], rows[found])
            of = {i: n for n, i in enumerate(who.tolist())}
            kept = []
            for i, name, hi, levels in open_:
                s = score[of[i]]
                fits = (row_labels[found] == anchor_labels[i]) == same_label
                hit = np.flatnonzero(fits & (s >= levels[turn]) & (s <= hi))
                if turn + 1 == len(levels) or int(count[found[hit]].sum()) >= k:
                    for value, vec_id in first_of(s[hit], found[hit], ids, k):
                        yield i, name, value, vec_id
                else:
                    kept.append((i, name, hi, levels))
            open_, turn = kept, turn + 1


# -- cells ----------------------------------------------------------------------


def _matrix(column: pa.ChunkedArray, width: int, order: np.ndarray) -> np.ndarray:
    lists = column.combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy().astype(np.float64)
    out = np.zeros((len(lists), width))
    row = np.repeat(np.arange(len(lists)), size)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
    return out[:, order]


def _cell_search(width: int, order: np.ndarray, k: int, same_label: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            windows = [[(w["window"], w["lo"], w["hi"]) for w in ws] for ws in left.column("windows").to_pylist()]
            anchor = left.column("class").to_pylist()
            out = [(anchor[i], *rest) for i, *rest in search_cell(
                _matrix(left.column("vec"), width, order), left.column("label").to_numpy(), windows,
                _matrix(right.column("vec"), width, order), right.column("label").to_numpy(),
                right.column("ids").to_pylist(), k, same_label)]
        cols = list(zip(*out)) or [[]] * 4
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=HITS.names)
    return run


def threshold_join(anchors: DataFrame, classes: DataFrame, k: int, same_label: bool, width: int, order: list[int],
                   cell_anchors: int, cell_rows: int) -> DataFrame:
    """The first ``k`` (score, vec_id) of every (anchor class, window)."""
    by = "label" if same_label else None

    def blocks(df, cell):
        """Block counts: by label, or one for all."""
        n = df.groupBy(by).agg(F.count("*").alias("n")) if by else df.agg(F.count("*").alias("n"))
        return n.withColumn("n", F.greatest(F.ceil(F.col("n") / cell), F.lit(1)).cast("int"))

    if by:
        # One row per label: labels that hold anchors, each with its two block counts.
        counts = blocks(anchors, cell_anchors).withColumnRenamed("n", "na").join(
            blocks(classes, cell_rows).withColumnRenamed("n", "nr"), "label")
        counts = saved(counts, "cell-counts")
        dealt_a, dealt_r = anchors.join(counts, "label"), classes.join(counts, "label")
    else:
        na, nr = blocks(anchors, cell_anchors).first()["n"], blocks(classes, cell_rows).first()["n"]
        dealt_a, dealt_r = (d.withColumns({"na": F.lit(na), "nr": F.lit(nr)}) for d in (anchors, classes))
    mine = F.xxhash64("class", F.lit(5))
    group = F.col("label") if by else F.lit(0).cast("long")
    dealt_a = dealt_a.withColumn("i", F.pmod(mine, F.col("na"))).withColumn(
        "j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nr").cast("long") - 1)))
    dealt_r = dealt_r.withColumn("j", F.pmod(mine, F.col("nr"))).withColumn(
        "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("na").cast("long") - 1)))
    cell = F.xxhash64(group, F.col("i").cast("long"), F.col("j").cast("long"))
    left = dealt_a.select(cell.alias("cell"), "class", "label", "vec", "windows")
    right = dealt_r.select(cell.alias("cell"), "label", "vec", "ids")
    hits = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(
        _cell_search(width, np.array(order, np.int64), k, same_label), HITS)
    first = W.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low_percent: int = 50, high_percent: int = 95, cell_anchors: int = CELL_ANCHORS,
                   cell_rows: int = CELL_ROWS, id_col: str = "vec_id", label_col: str = "label",
                   vector_col: str = "embedding") -> DataFrame:
    """For every anchor row and each of its first ``positives`` other rows of its
    label, the first ``negatives`` rows of other labels whose score lies between
    ``low_percent`` and ``high_percent`` of the positive's: anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score."""
    keep = positives + 1                      # one of an anchor class's hits may be the anchor itself
    vec = whole_components(F.col(vector_col))
    usable = rows.where(F.col(label_col).isNotNull() & finite(F.col(vector_col))).select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("vec_id"), F.col(label_col).cast("long").alias("label"),
        vec.alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    # Trailing zeros do not change a score, so vectors of unlike length can be equal.
    last = F.aggregate(F.transform("vec", lambda x, i: F.when(x != 0, i + 1).otherwise(0)), F.lit(0),
                       lambda a, b: F.greatest(a, b))
    usable = usable.withColumn("vec", F.slice("vec", F.lit(1), last))
    usable = usable.withColumn("key", F.unhex(F.sha2(F.concat_ws(",", F.col("label").cast("string"),
                                                                 F.col("vec").cast("array<string>")), 256)))
    by_id = W.partitionBy("key").orderBy("vec_id")
    few = usable.withColumn("nth", F.row_number().over(by_id)).where(F.col("nth") <= keep)
    classes = saved(few.groupBy("key").agg(F.first("label").alias("label"), F.first("vec").alias("vec"),
                                           F.sort_array(F.collect_list("vec_id")).alias("ids"))
                    .withColumn("class", F.monotonically_increasing_id()), "mining-classes")
    # Squares of every dimension over all classes: one row per dimension.
    energy = (classes.select(F.posexplode("vec").alias("dim", "x"))
              .groupBy("dim").agg(F.sum(F.col("x").cast("double") * F.col("x")).alias("e")).toPandas())
    width = int(energy["dim"].max()) + 1 if len(energy) else 1
    order = list(range(width))
    by_dim = dict(zip(energy["dim"].tolist(), energy["e"].tolist()))
    order.sort(key=lambda j: (-by_dim.get(j, 0.0), j))

    anchor_rows = saved(usable.where("is_anchor").select(F.col("vec_id").alias("anchor_id"), "key"), "mining-anchor-rows")
    per_class = anchor_rows.groupBy("key").agg(F.count("*").alias("n_anchors"))
    anchors = saved(classes.join(per_class, "key").select(
        "key", "class", "label", "vec", "n_anchors",
        F.aggregate("vec", F.lit(0).cast("long"), lambda s, x: s + x * x).alias("self")), "mining-anchors")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("window"), F.lit(-LAST_ID).alias("lo"), F.lit(LAST_ID).alias("hi")))
    near = saved(threshold_join(anchors.withColumn("windows", whole), classes, keep, True, width, order,
                                cell_anchors, cell_rows).select("anchor", "score", "vec_id"), "mining-positives")

    # Scores of at least 0: below, no row can lie between the two shares (low < high).
    named = F.struct(F.col("score").alias("window"), _ceil_div(F.col("score") * low_percent).alias("lo"),
                     _floor_div(F.col("score") * high_percent).alias("hi"))
    asked = near.where("score >= 0").select("anchor", named.alias("w")).distinct().where("w.lo <= w.hi")
    asked = asked.groupBy("anchor").agg(F.sort_array(F.collect_list("w")).alias("windows"))       # at most positives + 1
    hard = saved(threshold_join(
        anchors.join(asked, anchors["class"] == asked["anchor"]).select("class", "label", "vec", "windows"),
        classes, negatives, False, width, order, cell_anchors, cell_rows), "mining-negatives")

    # One row per anchor class, answered to its anchors; a class of many anchors is split.
    pos = near.groupBy("anchor").agg(F.sort_array(F.collect_list(
        F.struct((-F.col("score")).alias("minus"), "vec_id"))).alias("pos"))
    neg = hard.groupBy("anchor").agg(F.sort_array(F.collect_list(
        F.struct(F.col("window").alias("p"), "rank", F.col("vec_id").alias("negative_id"),
                 F.col("score").alias("negative_score")))).alias("neg"))
    answers = (anchors.select("key", "class", "self", "n_anchors")
               .join(pos, F.col("class") == pos["anchor"]).drop("anchor")
               .join(neg, F.col("class") == neg["anchor"]).drop("anchor", "class"))
    parts = F.ceil(F.col("n_anchors") / SPLIT_ROWS).cast("int")
    answers = answers.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n_anchors")
    asked_rows = anchor_rows.join(per_class, "key").select(
        "key", "anchor_id", F.pmod(F.xxhash64("anchor_id"), parts).cast("int").alias("part"))
    joined = asked_rows.join(answers, ["key", "part"])
    mine = F.struct((-F.col("self")).alias("minus"), F.col("anchor_id").alias("vec_id"))
    others = joined.withColumn("own", F.array_position("pos", mine)).withColumn(
        "pos", F.slice(F.filter("pos", lambda x, i: i + 1 != F.col("own")), 1, positives))
    each = others.select("anchor_id", "neg", F.explode("pos").alias("p")).select(
        "anchor_id", F.col("p.vec_id").alias("positive_id"), (-F.col("p.minus")).alias("positive_score"),
        F.explode(F.filter("neg", lambda n: n["p"] == -F.col("p.minus"))).alias("n"))
    shown = {c: F.when(F.col(c) != LAST_ID, F.col(c)) for c in ("anchor_id", "positive_id", "negative_id")}
    return each.select("anchor_id", "positive_id", "n.rank", "n.negative_id", "positive_score",
                       "n.negative_score").withColumns(shown)


def _floor_div(x: Column) -> Column:
    """x div 100 for x >= 0, in 64 bits."""
    return F.call_function("div", x, F.lit(100).cast("long")).cast("long")


def _ceil_div(x: Column) -> Column:
    return _floor_div(x + 99)
