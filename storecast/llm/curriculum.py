"""Mixing sources to target weights with a time-varying curriculum.

DataFrame and SQL functions only; no Python runs on the rows.

1. ``targets``: sources share ``budget`` times all words by weight; a target
   stops at ``cap`` times its source and the excess is shared again by weight.
   The end of that process has a closed form: with sources sorted by
   cap / weight, a prefix is capped and the rest share what is left in
   proportion to weight.
2. ``taken``: a source's stream is its documents in a seeded hash order, passed
   over again and again.  A pass over a document is taken when its midpoint lies
   before the target, so a source misses its target by at most about half a
   document, and no document is taken more than ``cap`` times.
3. ``position``: each source has a weight schedule over training time t in
   [0, 1], linear from ``start`` to ``end``.  Its integral, scaled to the
   target, is the source's cumulative token demand D(t); the pass that begins
   at word x of the stream is trained at the t with D(t) = x (the inverse is a
   square root).  Documents are range-sorted by position.

Running totals inside a source are made in two steps.  All rows are cut into
slices by a range partition on (source, order, id, size, text, row number), so a
slice is bounded whatever the source, and rows that share an id or are null there
are cut like any others.  Totals then run inside (source, slice) and over the
slices of a source.  Slices grow in number with the rows.  Tables of one row per
source (and slice) are the only ones sorted or numbered as a whole.

A null text has size 0; a document of size 0 is taken in 0 words (and, in the
mixed corpus, once if its midpoint passes, like any other).  A null source is a
source of its own, last in order.  Repeated rows each count; rows of one id (or
none) follow by size and text.  Reruns agree: the order depends on the rows only,
and rows alike in all of it give the same results in any order.  An empty table
gives no rows.  Only doc_id, source and text are read, so other columns may have
any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storecast.llm.common import WORD, saved, small, text_or_empty

WEIGHTS = (5, 2, 1)                 # by source in code point order, repeating
BUDGET = 1.5                        # words of the mix over words of all documents
CAP = 2                             # most passes over a source
SCHEDULES = ((1.0, 1.0), (0.5, 1.5), (1.5, 0.5))   # (start, end), by source, repeating
SLICE_ROWS = 100_000                # rows aimed at in one slice of the order
SEED = 20


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and the seeded order key of every row."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(text_or_empty()).alias("text_key"),
        # 60 bits of a digest of the id: the seeded order, the same in any engine.
        F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
                                 .cast("binary")), 1, 15), 16, 10).cast("long").alias("_order"))


def _pick(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, cap: int = CAP) -> DataFrame:
    """One row per source: source, source_size, rank, weight, target."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = W.orderBy(F.col("source").asc_nulls_last())
    s = per.withColumn("rank", F.row_number().over(ordered) - 1)
    s = s.withColumn("weight", _pick(weights, F.col("rank")).cast("long"))
    s = s.withColumn("_cap", F.col("source_size") * cap)
    s = s.withColumn("_budget", F.sum("source_size").over(W.partitionBy()) * F.lit(float(budget)))
    by_ratio = W.orderBy(F.col("_cap") / F.col("weight"), F.col("rank"))
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)
    s = s.withColumn("_capped", F.coalesce(F.sum("_cap").over(before), F.lit(0)))
    s = s.withColumn("_open", F.sum("weight").over(after))
    # The share per weight if all sources sorted before this one are capped.
    s = s.withColumn("_share", (F.col("_budget") - F.col("_capped")) / F.col("_open"))
    s = s.withColumn("_free", F.col("_share") * F.col("weight") < F.col("_cap"))
    s = s.withColumn("_level", F.first(F.when(F.col("_free"), F.col("_share")), ignorenulls=True).over(
        by_ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return s.select("source", "source_size", "rank", "weight",
                    F.least(F.col("_cap").cast("double"),
                            F.coalesce(F.col("_level") * F.col("weight"), F.col("_cap").cast("double")))
                    .alias("target"))


def _sliced(rows: DataFrame, slice_rows: int) -> DataFrame:
    """The rows cut by a range partition on the whole order, with ``_slice``.  The
    row number, stored with the rows, lets a cut fall between rows alike in all else."""
    spark = rows.sparkSession
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // slice_rows))
    ranged = rows.repartitionByRange(slices, F.col("source").asc_nulls_last(), "_order", "doc_id", "size", "text_key",
                                     "_row")
    return saved(ranged.withColumn("_slice", F.spark_partition_id()), "mix-slices")


def _offsets(rows: DataFrame, slice_rows: int) -> DataFrame:
    """Adds ``_at``: words of the source's stream before this document."""
    rows = _sliced(rows, slice_rows)
    per = rows.groupBy("source", "_slice").agg(F.sum("size").alias("_sum"))
    of_source = W.partitionBy("source").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    start = per.select(F.col("source").alias("_s"), F.col("_slice").alias("_b"),
                       F.coalesce(F.sum("_sum").over(of_source), F.lit(0)).alias("_start"))
    within = (W.partitionBy("source", "_slice").orderBy("_order", "doc_id", "size", "text_key", "_row")
              .rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_in", F.coalesce(F.sum("size").over(within), F.lit(0)))
    start = small(saved(start, "mix-starts"))
    joined = rows.join(start, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_slice") == F.col("_b")))
    return joined.withColumn("_at", F.col("_start") + F.col("_in")).drop("_s", "_b", "_start", "_in", "_slice", "_row")


def time_of(x: Column, target: Column, start: Column, end: Column) -> Column:
    """The t in [0, 1] at which a source with a linear schedule has asked for
    ``x`` of its ``target`` words.  D(t) = target * (a t + (b - a) t^2 / 2) /
    ((a + b) / 2); solved for t."""
    share = F.when(target > 0, F.least(F.lit(1.0), x / target)).otherwise(F.lit(0.0))
    asked = share * (start + end) / 2
    root = F.sqrt(start * start + 2 * (end - start) * asked)
    return F.when(start == end, share).otherwise((root - start) / (end - start)) + F.lit(0.0)


def mix(docs: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, cap: int = CAP,
        schedules: tuple = SCHEDULES, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, passes
    (times taken), taken (words), positions (training time of each pass) and
    text_key."""
    rows = saved(sized(docs).withColumn("_row", F.monotonically_increasing_id()), "mix-sizes")
    share = saved(targets(rows, weights, budget, cap), "mix-targets")
    r = _offsets(rows, slice_rows)
    share = small(share).withColumnRenamed("source", "_s")
    r = r.join(share, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    passes = [F.col("_at") + F.col("source_size") * k for k in range(cap)]
    taken = [x + F.col("size") / 2 < F.col("target") for x in passes]
    start = _pick(tuple(a for a, _ in schedules), F.col("rank"))
    end = _pick(tuple(b for _, b in schedules), F.col("rank"))
    times = F.filter(F.array(*[F.when(t, time_of(x, F.col("target"), start, end))
                               for t, x in zip(taken, passes)]), lambda t: t.isNotNull())
    r = r.withColumn("positions", times).withColumn("passes", F.size("positions").cast("long"))
    return r.select("doc_id", "source", "size", "source_size", "target", "passes",
                    (F.col("size") * F.col("passes")).alias("taken"), "positions", "text_key")


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per pass, range-sorted by training position."""
    passes = mixed.select("doc_id", "text_key", "source", F.explode("positions").alias("position"))
    return passes.orderBy("position", "source", "doc_id", "text_key")
