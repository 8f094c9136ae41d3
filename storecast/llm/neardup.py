"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

1. One pass over the texts makes, per document, its set of five-word shingles
   (hashes), a 128-bit digest of that set, and a MinHash signature.  Documents with the
   same set form one class; from here on a class is handled once.
2. Band and row counts follow from the threshold and a target recall, which
   counts the losses of the bands and of the signature filter together.  Classes
   are shuffled on band hashes.  Buckets are cut into cells of at most a few
   hundred members, so that a hot bucket becomes many tasks; a cell compares
   signatures and passes on a spanning forest of its similar pairs.
3. The components of those edges are the candidate clusters.  Every cluster is
   cut into cells of block pairs, each holding the full shingle sets of two
   blocks; a cell finds all intersections, verifies Jaccard >= threshold for
   every pair and returns link counts and a spanning forest.  Pairs are never
   written out, and no pair of a cluster is skipped.
4. The components of the verified edges are the groups.

Words are runs of anything but ASCII blanks, compared as they stand.  A text of
one to four words has one shingle: all its words.  A text without words (null,
empty) has none: it is a class of its own row, with no links.  Repeated rows
fall into one class.  ``doc_id`` ties are kept apart by the text.  Rows with a
null doc_id take part like any other; a class or group has the smallest id that
is not null, and a null one only where no member has an id.  An empty table
gives no rows.  Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storecast.llm import bytewords as bw
from storecast.llm.common import saved, small, text_or_empty
from storecast.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.999
MAX_HASHES = 128
CELL = 256            # members of one side of a cell
PIECE_PAIRS = 400_000  # equal shingles of two sides that are counted at a time (some 50 bytes each)
SLACK = 0.2           # a signature this far below the threshold still counts as a candidate

_WORDS = bw.table()


def _passes(threshold: float, hashes: int) -> np.ndarray:
    """For 0 to ``hashes`` equal hashes, whether the signature filter lets a pair through."""
    return np.arange(hashes + 1) / hashes >= max(0.0, threshold - SLACK)


def joint_recall(threshold: float, bands: int, rows: int) -> float:
    """Probability that a pair at the threshold shares a band and passes the
    signature filter (hashes taken as independent; exact otherwise)."""
    one = np.array([math.comb(rows, k) * threshold ** k * (1 - threshold) ** (rows - k) for k in range(rows + 1)])
    equal, no_band = np.ones(1), np.ones(1)
    for _ in range(bands):
        equal = np.convolve(equal, one)
        no_band = np.convolve(no_band, np.where(np.arange(rows + 1) < rows, one, 0.0))
    return float((equal - no_band)[_passes(threshold, bands * rows)].sum())


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL,
                 max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band (fewest false candidates) with which
    a pair at the threshold still shares a band and passes the signature filter
    with probability ``recall``, using at most ``max_hashes`` hashes."""
    for rows in range(max_hashes, 0, -1):
        least = int(np.ceil(np.log(1 - recall) / np.log1p(-threshold ** rows))) if threshold < 1 else 1
        for bands in range(max(1, least), max_hashes // rows + 1):
            if joint_recall(threshold, bands, rows) >= min(recall, 1 - 1e-12):
                return bands, rows
    raise ValueError("max_hashes is too small for this recall")


def _multipliers(n: int) -> np.ndarray:
    return bw.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle hash) of a block, in document order, repeats included."""
    t = bw.Tokens(data, offsets, _WORDS)
    gram, first = bw.grams(t, n)
    doc = t.doc[first]
    per_doc = t.counts()
    short = np.flatnonzero((per_doc > 0) & (per_doc < n))
    if len(short):
        at = np.searchsorted(t.doc, short)
        extra = np.array([int.from_bytes(hashlib.blake2b(t.hash[a:a + k].tobytes(), digest_size=8).digest(),
                                         "little") for a, k in zip(at, per_doc[short])], np.uint64)
        doc, gram = np.concatenate([doc, short]), np.concatenate([gram, extra])
        order = np.argsort(doc, kind="stable")
        doc, gram = doc[order], gram[order]
    return doc, gram


def _sets(data, offsets, n) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of every document of a block."""
    doc, gram = shingles(data, offsets, n)
    edges = np.searchsorted(doc, np.arange(len(offsets)))
    for a, b in zip(edges[:-1], edges[1:]):
        yield np.unique(gram[a:b])


def _digest(members: np.ndarray) -> tuple[int | None, int | None]:
    """128 bits of a set, as two longs; nulls for the empty set."""
    if not len(members):
        return None, None
    return struct.unpack("<qq", hashlib.blake2b(members.tobytes(), digest_size=16).digest())


def settled(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """``rows`` whose ``set_id`` stands for the whole digest (``set_id``,
    ``set_check``): where different sets share the first half (``shared``, a
    handful of ids if any), the second half is hashed into the id."""
    known = rows.join(small(shared.select(F.col("set_id").alias("_shared"))),
                      F.col("set_id") == F.col("_shared"), "left")
    return known.withColumn("set_id", F.when(F.col("_shared").isNull(), F.col("set_id"))
                            .otherwise(F.xxhash64("set_id", "set_check"))).drop("_shared")


SIGNED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_key", T.LongType()),
                       T.StructField("set_id", T.LongType()), T.StructField("set_check", T.LongType()),
                       T.StructField("n_set", T.IntegerType()),
                       T.StructField("bands", T.ArrayType(T.LongType())),
                       T.StructField("signature", T.BinaryType())])


def _signer(bands: int, rows: int, n: int):
    mult = _multipliers(bands * rows)

    def run(batches):
        bw.release()
        for batch in batches:
            data, offsets = bw.buffers(batch.column("text"))
            set_id, n_set, band, sig = [], [], [], []
            for _, _, d, o in bw.blocks(data, offsets, 1 << 19):
                docs = len(o) - 1
                members = list(_sets(d, o, n))
                sizes = np.array([len(m) for m in members], np.int64)
                full = np.flatnonzero(sizes)
                lows = np.zeros((docs, bands * rows), np.uint64)
                if len(full):
                    flat = np.concatenate([members[i] for i in full])
                    at = np.cumsum(sizes[full]) - sizes[full]
                    for j, m in enumerate(mult):
                        lows[full, j] = np.minimum.reduceat(flat * m, at)
                cut = lows.reshape(docs, bands, rows)
                h = np.zeros((docs, bands), np.uint64)
                for r in range(rows):
                    h = bw.mix(h * np.uint64(0xC2B2AE3D27D4EB4F) + cut[:, :, r])
                set_id += [_digest(m) for m in members]
                n_set.append(sizes)
                band.append(h.view(np.int64))
                sig += [r.tobytes() for r in (lows >> np.uint64(48)).astype(np.uint16)]
            if not n_set:
                continue
            band = np.concatenate(band)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array([a for a, _ in set_id], pa.int64()),
                 pa.array([b for _, b in set_id], pa.int64()),
                 pa.array(np.concatenate(n_set).astype(np.int32)),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(band) + 1, dtype=np.int32) * bands),
                                          pa.array(band.ravel())),
                 pa.array(sig, pa.binary())], names=SIGNED.names)
    return run


def sign(docs: DataFrame, bands: int, rows: int, n: int = SHINGLE) -> DataFrame:
    """Per row: key, class digest (null: no words), set size, band hashes and
    the signature (16 bits a hash).  No shuffle."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.xxhash64(text_or_empty()).alias("text_key"), "text")
    return keyed.mapInArrow(_signer(bands, rows, n), SIGNED)


def _in_cells(batches, key: str):
    """Rows sorted by ``key`` -> one pyarrow table per key value."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        if held is not None:
            t = pa.concat_tables([held, t])
            held = None
        k = t.column(key).to_numpy()
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        at = 0
        for c in cuts:
            yield t.slice(at, c - at)
            at = c
        held = t.slice(at)
    if held is not None and held.num_rows:
        yield held


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Indices of edges (a, b) over n nodes that make a spanning forest."""
    parent = list(range(n))
    keep = []
    for e, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[y] = x
            keep.append(e)
    return np.array(keep, np.int64)


def _sides(cell: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of the left and right block of a cell; whether they are the same."""
    side = cell.column("side").to_numpy()
    if (side == 2).any():
        rows = np.arange(cell.num_rows)
        return rows, rows, True
    return np.flatnonzero(side == 0), np.flatnonzero(side == 1), False


EDGES = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])


def _similar_signatures(passes: np.ndarray):
    def run(batches):
        bw.release()
        u, v = [], []
        for cell in _in_cells(batches, "cell"):
            if cell.num_rows < 2:
                continue
            ids = cell.column("set_id").to_numpy()
            sigs = np.frombuffer(b"".join(cell.column("signature").to_pylist()), np.uint16)
            sigs = sigs.reshape(cell.num_rows, -1)
            left, right, same = _sides(cell)
            pairs = []
            for i, x in enumerate(left):
                to = right[i + 1:] if same else right
                close = passes[(sigs[to] == sigs[x]).sum(axis=1)] if len(to) else np.empty(0, bool)
                pairs.append(np.stack([np.full(int(close.sum()), x), to[close]], 1))
            pairs = np.concatenate(pairs) if pairs else np.empty((0, 2), np.int64)
            keep = pairs[_forest(pairs[:, 0], pairs[:, 1], cell.num_rows)]
            u.append(ids[keep[:, 0]])
            v.append(ids[keep[:, 1]])
            if len(u) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))],
                                                 names=["u", "v"])
                u, v = [], []
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))],
                                             names=["u", "v"])
    return run


FOUND = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType()),
                      T.StructField("links", T.LongType())])


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of every left with every right set, by
    joining the two sides' shingles in bounded pieces."""
    def side(rows):
        h = np.concatenate([sets[i] for i in rows])
        who = np.repeat(np.arange(len(rows)), [len(sets[i]) for i in rows])
        order = np.argsort(h, kind="stable")
        return h[order], who[order]

    ha, wa = side(left)
    hb, wb = side(right)
    out = np.zeros(len(left) * len(right), np.int64)
    lo, hi = np.searchsorted(hb, ha, "left"), np.searchsorted(hb, ha, "right")
    n = hi - lo
    ends = np.cumsum(n)
    at = 0
    while at < len(ha):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + PIECE_PAIRS, "right")))
        k = n[at:to]
        total = int(k.sum())
        if total:
            first = np.repeat(lo[at:to] - (np.cumsum(k) - k), k)
            b = wb[first + np.arange(total)]
            out += np.bincount(np.repeat(wa[at:to], k) * len(right) + b, minlength=len(out))
        at = to
    return out.reshape(len(left), len(right))


def _verify(threshold: float):
    def run(batches):
        bw.release()
        for cell in _in_cells(batches, "cell"):
            ids = cell.column("set_id").to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in cell.column("members").to_pylist()]
            left, right, same = _sides(cell)
            if not len(left) or not len(right):
                continue
            size = np.array([len(s) for s in sets])
            both = _overlaps(sets, left, right)
            either = size[left][:, None] + size[right][None, :] - both
            linked = both >= threshold * either - 1e-9
            if same:
                linked = np.triu(linked, 1)
            a, b = np.nonzero(linked)
            links = np.bincount(left[a], minlength=len(ids)) + np.bincount(right[b], minlength=len(ids))
            keep = _forest(left[a], right[b], len(ids))
            some = np.flatnonzero(links)
            u = np.concatenate([ids[left[a[keep]]], ids[some]])
            v = np.concatenate([ids[right[b[keep]]], ids[some]])
            n = np.concatenate([np.zeros(len(keep), np.int64), links[some]])
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(n)], names=FOUND.names)
    return run


def into_cells(rows: DataFrame, sizes: DataFrame, group: str, cell: int = CELL) -> DataFrame:
    """Deal the members of every group into block-pair cells.

    ``sizes`` has (group, n).  A group of n members has b = ceil(n / cell)
    blocks, a member's block follows from its id, and each pair of blocks is one
    cell: a member goes to b cells, and any two members meet in exactly one.
    ``side`` is 0 or 1 for the two blocks, 2 where a block meets itself."""
    blocks = F.ceil(F.col("n") / cell).cast("int")
    dealt = (rows.join(small(sizes), group)
             .withColumn("_b", blocks)
             .withColumn("_mine", F.pmod(F.xxhash64("set_id", F.lit(17)), F.col("_b")).cast("int"))
             .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_b") - 1))))
    return (dealt.withColumn("cell", F.xxhash64(F.col(group), F.least("_mine", "_other"),
                                                F.greatest("_mine", "_other")))
            .withColumn("side", F.when(F.col("_mine") == F.col("_other"), 2)
                        .when(F.col("_mine") < F.col("_other"), 0).otherwise(1).cast("int"))
            .drop("_b", "_mine", "_other", "n"))


SETS = T.StructType([T.StructField("set_id", T.LongType()), T.StructField("set_check", T.LongType()),
                     T.StructField("members", T.BinaryType())])


def _set_rows(n: int):
    def run(batches):
        for batch in batches:
            data, offsets = bw.buffers(batch.column("text"))
            ids, members = [], []
            for _, _, d, o in bw.blocks(data, offsets):
                for m in _sets(d, o, n):
                    ids.append(_digest(m))
                    members.append(m.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in ids], pa.int64()), pa.array([b for _, b in ids], pa.int64()),
                 pa.array(members, pa.binary())], names=SETS.names)
    return run


def _least_id(key: str, tie: str):
    """The smallest (key, tie) of a group; a null key comes last."""
    return F.min(F.struct(F.col(key).isNull().alias("no_id"), key, tie))


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL,
                 n: int = SHINGLE, cell: int = CELL) -> DataFrame:
    """One row per document: ``doc_id``, ``text_key``, ``class_id`` (smallest
    doc_id that is not null with the same shingle set), ``class_size``, ``n_links`` (other
    classes at or above the threshold), ``group_id`` (smallest doc_id reachable
    over links), ``kept`` (this row stands for its group)."""
    bands, rows = choose_bands(threshold, recall)
    signed = saved(sign(docs, bands, rows, n), "signed")

    # Different sets that share half of their digest are told apart by the other half.
    shared = saved(signed.where("set_id IS NOT NULL").groupBy("set_id")
                   .agg(F.min("set_check").alias("lo"), F.max("set_check").alias("hi"))
                   .where("lo <> hi").select("set_id"), "shared-digests")
    distinct = shared.isEmpty()
    if not distinct:
        signed = saved(settled(signed, shared), "signed")

    # Classes, and for each the one row whose signature stands for it.
    classes = saved(signed.where("set_id IS NOT NULL").groupBy("set_id")
                    .agg(_least_id("doc_id", "text_key").alias("rep"), F.count("*").alias("class_size"))
                    .select("set_id", F.col("rep.doc_id").alias("class_id"),
                            F.col("rep.text_key").alias("rep_key"), "class_size"), "classes")
    rep = classes.select(F.col("set_id").alias("_set"), "class_id", "rep_key")
    reps = signed.join(rep, (F.col("set_id") == F.col("_set")) & F.col("doc_id").eqNullSafe(F.col("class_id"))
                       & (F.col("text_key") == F.col("rep_key")), "left_semi").drop("doc_id", "text_key", "n_set", "set_check")
    # Rows that repeat a document's id and text would stand for their class twice.
    reps = saved(reps.dropDuplicates(["set_id"]), "representatives")
    members = reps.select("set_id", F.posexplode("bands").alias("band", "h")).select(
        "set_id", F.xxhash64("band", "h").alias("bucket"))
    buckets = saved(members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    near = members.join(small(buckets.select("bucket")), "bucket").join(
        reps.select("set_id", "signature"), "set_id")
    cells = into_cells(near, buckets, "bucket", cell).select("cell", "side", "set_id", "signature")
    hints = (cells.repartition("cell").sortWithinPartitions("cell")
             .mapInArrow(_similar_signatures(_passes(threshold, bands * rows)), EDGES))
    clusters = components(hints, "candidates")

    # Verify within every candidate cluster on the full sets.
    sizes = saved(clusters.groupBy("root").agg(F.count("*").alias("n")), "cluster-sizes")
    wanted = saved(clusters.join(classes, clusters["node"] == classes["set_id"])
                   .select("set_id", "root", F.col("class_id").alias("_key_id"),
                           F.col("rep_key").alias("_key_text")), "wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("_key_id"),
                        F.xxhash64(text_or_empty()).alias("_key_text"), "text")
    asked = wanted.select(F.col("_key_id").alias("_id"), F.col("_key_text").alias("_text"))
    texts = texts.join(small(asked), F.col("_key_id").eqNullSafe(F.col("_id"))
                       & (F.col("_key_text") == F.col("_text")), "left_semi")
    sets = texts.select("text").mapInArrow(_set_rows(n), SETS)
    sets = (sets if distinct else settled(sets, shared)).drop("set_check").dropDuplicates(["set_id"])
    sets = sets.join(small(wanted.select("set_id", "root")), "set_id")
    cells = into_cells(sets, sizes, "root", cell).select("cell", "side", "set_id", "members")
    found = saved(cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_verify(threshold), FOUND),
                  "links")
    links = found.where("links > 0").groupBy(F.col("u").alias("set_id")).agg(F.sum("links").alias("n_links"))
    groups = components(found.where("links = 0").select("u", "v"), "groups")

    grouped = (classes.join(small(groups), classes["set_id"] == groups["node"], "left")
               .join(small(saved(links, "link-counts")), "set_id", "left")
               .withColumn("root", F.coalesce("root", "set_id")))
    heads = saved(grouped.where(F.col("node").isNotNull()).groupBy("root")
                  .agg(_least_id("class_id", "set_id").alias("head")), "heads")
    grouped = saved(grouped.join(small(heads), "root", "left")
                    .select("set_id", "class_id", "rep_key", "class_size",
                            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                            F.coalesce("head.class_id", "class_id").alias("group_id"),
                            F.coalesce(F.col("head.set_id") == F.col("set_id"), F.lit(True)).alias("_head")),
                    "grouped")
    out = signed.select("doc_id", "text_key", "set_id").join(small(grouped), "set_id", "left")
    return out.select(
        "doc_id", "text_key", F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("group_id", "doc_id").alias("group_id"),
        (F.col("set_id").isNull() | (F.col("_head") & F.col("doc_id").eqNullSafe(F.col("class_id"))
                                     & (F.col("text_key") == F.col("rep_key")))).alias("kept"))
