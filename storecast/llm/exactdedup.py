"""Exact deduplication with counting quotient filters.

1. One pass makes a narrow key table: doc_id, a 64-bit fingerprint of the
   normalised text, and the text's SHA-256.
2. Every partition builds counting quotient filters over its fingerprints.  A
   fingerprint's top bits choose the slice (one filter), the next bits the
   quotient (a run of the filter), the rest is the remainder; a filter holds the
   run lengths, the sorted remainders and their counts.
3. Filters of one slice merge without loss: sorted remainders are merged and the
   counts of equal ones added.  Hot fingerprints are one entry per partition by
   then, so no slice is larger than its share of distinct fingerprints.
4. Only fingerprints with a count above one route their rows to verification,
   which groups by the normalised text itself (byte comparison, combined on the
   map side, so thousands of copies cross the shuffle as one row per task).

Texts are equal when they are identical after each run of ASCII blanks became
one space; a null text counts as empty.  The row with the smallest doc_id of
equal texts stays; among rows with that same id and an equal text, exactly one
is marked as kept, the one whose raw text hashes lowest.  A null doc_id sorts
before all others.  A very long text is one row like any other.  An empty table
gives no rows.  Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storecast.llm.common import BLANK, saved, small, text_or_empty

QUOTIENT_BITS = 12            # runs of one filter: 2^12
SLICE_FINGERPRINTS = 250_000  # distinct fingerprints aimed at in one slice

FILTER = T.StructType([T.StructField("slice", T.IntegerType()), T.StructField("runs", T.BinaryType()),
                       T.StructField("remainders", T.BinaryType()), T.StructField("counts", T.BinaryType())])
REPEATED = T.StructType([T.StructField("fp", T.LongType()), T.StructField("n", T.LongType())])


def normalised(col: str = "text") -> Column:
    """The text with every run of ASCII blanks as one space (null: empty)."""
    return F.regexp_replace(text_or_empty(col), BLANK, " ")


def _layout(slice_bits: int) -> tuple[np.uint64, np.uint64, np.uint64]:
    r = 64 - slice_bits - QUOTIENT_BITS
    return np.uint64(slice_bits), np.uint64(r), np.uint64((1 << r) - 1)


def encode_filter(fps: np.ndarray, counts: np.ndarray, slice_bits: int) -> tuple[bytes, bytes, bytes]:
    """Sorted distinct fingerprints of one slice -> run lengths per quotient,
    remainders (sorted within each run), counts."""
    _, r, mask = _layout(slice_bits)
    quotient = ((fps >> r) & np.uint64((1 << QUOTIENT_BITS) - 1)).astype(np.int64)
    runs = np.bincount(quotient, minlength=1 << QUOTIENT_BITS).astype(np.uint32)
    return runs.tobytes(), (fps & mask).tobytes(), counts.astype(np.uint64).tobytes()


def decode_filter(slice_no: int, runs: bytes, remainders: bytes, counts: bytes,
                  slice_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The (fingerprint, count) pairs a filter holds: it loses nothing."""
    _, r, _ = _layout(slice_bits)
    quotient = np.repeat(np.arange(1 << QUOTIENT_BITS, dtype=np.uint64), np.frombuffer(runs, np.uint32))
    top = np.uint64(slice_no) << np.uint64(64 - slice_bits) if slice_bits else np.uint64(0)
    return top | (quotient << r) | np.frombuffer(remainders, np.uint64), np.frombuffer(counts, np.uint64)


def merge_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Merge sorted (fingerprint, count) runs; equal fingerprints add up."""
    fps = np.concatenate([p[0] for p in parts])
    n = np.concatenate([p[1] for p in parts])
    order = np.argsort(fps, kind="stable")
    fps, n = fps[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], fps[1:] != fps[:-1]]))
    return fps[first], np.add.reduceat(n, first)


def _builder(slice_bits: int, flush: int = 2_000_000):
    def emit(parts):
        fps, n = merge_counts(parts)
        slices = (fps >> np.uint64(64 - slice_bits)).astype(np.int64) if slice_bits else np.zeros(len(fps), np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], slices[1:] != slices[:-1]]))
        rows = []
        for a, b in zip(cuts, [*cuts[1:], len(fps)]):
            rows.append((int(slices[a]), *encode_filter(fps[a:b], n[a:b], slice_bits)))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32())] + [pa.array([r[i] for r in rows], pa.binary())
                                                           for i in (1, 2, 3)], names=FILTER.names)

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            if not len(fps):
                continue
            u, c = np.unique(fps, return_counts=True)
            parts.append((u, c.astype(np.uint64)))
            held += len(u)
            if held > flush:
                parts = [merge_counts(parts)]
                held = len(parts[0][0])
                if held > flush:      # a very large partition writes several filters
                    yield emit(parts)
                    parts, held = [], 0
        if parts:
            yield emit(parts)
    return run


def _merger(slice_bits: int):
    def run(key, table):
        parts = [decode_filter(key[0].as_py(), r, m, c, slice_bits) for r, m, c in zip(
            table.column("runs").to_pylist(), table.column("remainders").to_pylist(),
            table.column("counts").to_pylist())]
        fps, n = merge_counts(parts)
        more = n > 1
        return pa.table([pa.array(fps[more].view(np.int64)), pa.array(n[more].astype(np.int64))],
                        names=REPEATED.names)
    return run


def repeated_fingerprints(keys: DataFrame) -> DataFrame:
    """(fp, n) of the fingerprints found more than once in ``keys.fp``, through
    per-partition filters merged slice by slice."""
    total = keys.count()
    slice_bits = max(0, int(np.ceil(np.log2(max(1, total / SLICE_FINGERPRINTS)))))
    filters = keys.select("fp").mapInArrow(_builder(slice_bits), FILTER)
    return filters.groupBy("slice").applyInArrow(_merger(slice_bits), REPEATED)


def fingerprints(docs: DataFrame) -> DataFrame:
    """The narrow key table: doc_id, fp, text_key, text_sha256."""
    norm = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.xxhash64(text_or_empty()).alias("text_key"), normalised().alias("norm"))
    return norm.select("doc_id", "text_key", F.xxhash64("norm").alias("fp"),
                       F.sha2(F.encode("norm", "UTF-8"), 256).alias("text_sha256"))


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, keep_id, group_size, kept, text_sha256,
    and text_key (hash of the raw text, ties the decision to the row)."""
    keys = saved(fingerprints(docs), "dedup-keys")
    repeated = saved(repeated_fingerprints(keys), "dedup-repeated")
    side = small(repeated.select("fp"))

    # Byte verification of the routed rows: equal only if the texts are.
    routed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("norm"))
    routed = routed.withColumn("fp", F.xxhash64("norm")).join(side, "fp", "left_semi")
    groups = (routed.groupBy("fp", "norm")
              .agg(F.min("doc_id").alias("low"), F.count("*").alias("group_size"),
                   F.count("doc_id").alias("with_id"))
              .where("group_size > 1")
              .select("fp", F.sha2(F.encode("norm", "UTF-8"), 256).alias("text_sha256"), "group_size",
                      F.when(F.col("with_id") == F.col("group_size"), F.col("low")).alias("keep_id")))
    groups = saved(groups, "dedup-groups")

    single = F.col("group_size").isNull()
    rows = keys.join(small(groups), ["fp", "text_sha256"], "left").select(
        "doc_id", "text_key", "text_sha256",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"))
    return rows.withColumn("kept", F.col("keep_id").eqNullSafe(F.col("doc_id")))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """``exact_groups`` with exactly one kept row per group, also where rows
    repeat the smallest id (or have none): the first of them stays."""
    rows = saved(exact_groups(docs), "dedup-rows")
    heads = rows.where("kept")
    ties = saved(heads.groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n")).where("n > 1"), "dedup-ties")
    if ties.isEmpty():
        return rows
    marked = rows.join(small(ties.withColumn("_tie", F.lit(True)).select(
        F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), "_tie")),
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_sha256") == F.col("_sha")), "left")
    marked = marked.drop("_id", "_sha")
    plain = marked.where(F.col("_tie").isNull() | ~F.col("kept")).drop("_tie")
    # Row numbers stored with the rows; the first of a group is an aggregate combined on the
    # map side, so that any number of copies without an id cross no shuffle as rows.
    tied = saved(marked.where(F.col("_tie") & F.col("kept")).drop("_tie")
                 .withColumn("_row", F.monotonically_increasing_id()), "dedup-tied")
    firsts = saved(tied.groupBy("doc_id", "text_sha256").agg(F.min(F.struct("text_key", "_row")).alias("first"))
                   .select(F.col("first._row").alias("_first")), "dedup-firsts")
    tied = (tied.join(small(firsts), F.col("_row") == F.col("_first"), "left")
            .withColumn("kept", F.col("_first").isNotNull()).drop("_row", "_first"))
    return plain.unionByName(tied)
