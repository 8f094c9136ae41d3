"""Token ids in frequency-ranked, byte-aligned variable-length coding.

Writing:

1. Texts are encoded with the tokenizers library; the end id is appended to each
   document.  The ids are written once as a table.
2. Ids are counted over all documents and ranked by frequency (ties by id), so
   the commonest get the smallest numbers.  The ranking has one entry per id of
   the vocabulary.
3. Documents are range-partitioned by doc_id and sorted.  Each partition is cut
   into segments of whole documents.  A segment holds the ranks in 1 to 4 bytes
   each (little-endian, no leading zero bytes) in one data stream, and the byte
   counts, two bits each, four to a control byte, in a control stream.
4. Segments are written through Spark in partition order, with the ranking and
   the id count of every partition beside them.

Reading takes a control byte's four lengths and total from a 256-entry table,
finds every value's place by a running sum, and assembles values from up to four
byte gathers.

The distinct words of a batch are passed to the library once; a word's ids do
not depend on its neighbours, because the tokenizer's own pre-tokenizer cuts
there.  Batches in which that could fail (text that is not in normal form, a
special token's string, a letter whose lower case is two characters) are cut at
ASCII blanks only.  Where a code point is unassigned in Python's Unicode tables,
whole documents go to the library, whose tables may be newer.

A null or empty text has only the end id.  Rows with equal doc_id stay beside
each other, in the order of a hash of their ids (rows equal in that too have the
same ids); a null doc_id comes first.  An empty table gives empty files and no
rows.  Other columns are not read, so their names do not matter.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storecast.llm import bytewords as bw
from storecast.llm import pretoken as pt
from storecast.llm.common import saved, scratch

END_ID = 2
BLOCK_BYTES = 1 << 20      # text encoded at once: fewer look-ups of the same words
SEGMENT_IDS = 1 << 19      # ids aimed at in one segment (a document is never cut)

IDS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.BinaryType())])
SEGMENT = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("segment", T.IntegerType()),
    T.StructField("first", T.LongType()), T.StructField("doc_ids", T.ArrayType(T.LongType())),
    T.StructField("lengths", T.ArrayType(T.IntegerType())), T.StructField("n_ids", T.LongType()),
    T.StructField("control", T.BinaryType()), T.StructField("data", T.BinaryType())])
READ = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("first", T.LongType()),
                     T.StructField("doc_id", T.LongType()), T.StructField("ids", T.BinaryType())])

# -- the coding ---------------------------------------------------------------

_LENGTHS = np.stack([((np.arange(256) >> (2 * i)) & 3) + 1 for i in range(4)], 1).astype(np.int64)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """uint32 values -> (control bytes, data bytes)."""
    n = len(values)
    code = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-n // 4) * 4, np.uint8)
    padded[:n] = code
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    raw = values.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), raw[np.arange(4) <= code[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` uint32 values of two streams."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(lengths) - lengths
    raw = np.frombuffer(data, np.uint8)
    out = raw[at].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(lengths > k)
        if not len(more):
            break
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


# -- encoding -----------------------------------------------------------------

WORDS_A_CALL = 2_000


class WordIds:
    """Ids of words by the tokenizers library."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_str(tokenizer_json)
        suffix = getattr(self.tok.model, "end_of_word_suffix", None)
        self.ends_word = None           # marks ids that end a word, where the model has such
        if suffix:
            vocab = self.tok.get_vocab(with_added_tokens=False)
            self.ends_word = np.zeros(max(self.tok.get_vocab().values()) + 1, bool)
            self.ends_word[[i for token, i in vocab.items() if token.endswith(suffix)]] = True

    def one_by_one(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        made = self.tok.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return pt.joined([np.array(e.ids, np.uint32) for e in made], np.uint32)

    def together(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """A few calls for words that the pre-tokenizer leaves whole: the ids are
        cut where a word ends.  If those are not as many as the words, the words
        are encoded one by one."""
        if self.ends_word is None:
            return self.one_by_one(words)
        flat, sizes = [], []
        for lo in range(0, len(words), WORDS_A_CALL):
            part = words[lo:lo + WORDS_A_CALL]
            made = self.tok.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0]
            ids = np.array(made.ids, np.uint32)
            end = np.flatnonzero(self.ends_word[ids]) + 1
            size = np.diff(end, prepend=0)
            if len(end) != len(part) or end[-1] != len(ids):
                ids, size = self.one_by_one(part)
            flat.append(ids)
            sizes.append(size)
        return np.concatenate(flat), np.concatenate(sizes)


_BOOKS: dict[int, tuple] = {}
_FOLD = bw.table(b"", fold=True)
_EXACT = bw.table(b"")
_BLANKS = bw.table()


def _plain(block: bytes) -> bool:
    """Whether words of this block may be encoded on their own."""
    if block.isascii():
        return b"<|" not in block
    text = block.decode("utf-8")
    return b"<|" not in block and "İ" not in text and unicodedata.is_normalized("NFC", text)


def encode_block(d: np.ndarray, o: np.ndarray, books: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(ids end to end, ids per document) of one block, without end ids."""
    fine, coarse = books
    cp, at = pt.code_points(d)
    if pt.has_unassigned(cp):
        return coarse.encode([d[a:b].tobytes() for a, b in zip(o[:-1].tolist(), o[1:].tolist())])
    if _plain(d.tobytes()):
        s, e = pt.split_bare(cp, np.searchsorted(at, o[:-1]))
        start, end, book, table = at[s], at[e], fine, _FOLD
    else:
        t = bw.Tokens(d, o, _BLANKS)
        start, end, book, table = t.start, t.end, coarse, _EXACT
    pos, size = book.codes(pt.span_hashes(d, start, end, table), d, start, end)
    total = np.concatenate([[0], np.cumsum(size)])
    return pt.ragged(book.flat, pos, size), np.diff(total[np.searchsorted(start, o)])


def code_books(tokenizer_json: str, tag: int) -> tuple:
    """The worker process's code books for this tokenizer, kept between tasks (a
    module's function is sent by name, so it sees the module's own table)."""
    if tag not in _BOOKS:
        _BOOKS.clear()
        words = WordIds(tokenizer_json)
        _BOOKS[tag] = (pt.CodeBook(words.together, np.uint32, fold=_FOLD), pt.CodeBook(words.one_by_one, np.uint32))
    return _BOOKS[tag]


def _encoder(tokenizer_json: str, tag: int, wide: bool, end_id: int):
    kind = np.uint32 if wide else np.uint16

    def run(batches):
        books = code_books(tokenizer_json, tag)
        for batch in batches:
            data, offsets = bw.buffers(batch.column("text"))
            rows = []
            for _, _, d, o in bw.blocks(data, offsets, BLOCK_BYTES):
                ids, size = encode_block(d, o, books)
                ends = np.cumsum(size)
                ids = np.insert(ids, ends, end_id).astype(kind)
                cut = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])
                rows += [ids[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.binary())], names=IDS.names)
    return run


def _counter(kind):
    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            data, _ = bw.buffers(batch.column("ids"))
            c = np.bincount(np.frombuffer(data.tobytes(), kind))
            if len(c) > len(total):
                total, c = c, total
            total[:len(c)] += c
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])
    return run


def _writer(rank_of: np.ndarray, kind, segment_ids: int):
    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        first, seq, docs, lens, held, size = 0, 0, [], [], [], 0

        def segment():
            control, data = pack(rank_of[np.concatenate(held)])
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([first]),
                 pa.array([docs], pa.list_(pa.int64())), pa.array([lens], pa.list_(pa.int32())),
                 pa.array([size]), pa.array([control], pa.binary()), pa.array([data], pa.binary())],
                names=SEGMENT.names)

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                ids = np.frombuffer(ids, kind)
                if size and size + len(ids) > segment_ids:
                    yield segment()
                    first, seq, docs, lens, held, size = first + size, seq + 1, [], [], [], 0
                docs.append(doc)
                lens.append(len(ids))
                held.append(ids)
                size += len(ids)
        if size:
            yield segment()
    return run


def _reader(id_of: np.ndarray):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = id_of[unpack(row["control"], row["data"], row["n_ids"])].astype("<u4")
                ends = np.cumsum(row["lengths"])
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * len(ends), pa.int32()), pa.array(starts + row["first"]),
                     pa.array(row["doc_ids"], pa.int64()),
                     pa.array([ids[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())], names=READ.names)
    return run


def write_ids(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = END_ID,
              segment_ids: int = SEGMENT_IDS) -> None:
    """Encode ``docs`` (doc_id, text) and write the files under ``path``:
    ``segments``, ``ranking`` (rank, id) and ``parts`` (part, start)."""
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    from tokenizers import Tokenizer
    wide = max(Tokenizer.from_str(tokenizer_json).get_vocab_size() - 1, end_id) > 0xFFFF
    kind = np.uint32 if wide else np.uint16
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _encoder(tokenizer_json, hash(tokenizer_json), wide, end_id), IDS)
    ids = saved(ids, "token-ids")

    counts = ids.select("ids").mapInArrow(_counter(kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # One row per id of the vocabulary: bounded whatever the input.
    ranking = counts.orderBy(F.desc("n"), "id").select("id").toArrow().column(0).to_numpy()
    rank_of = np.zeros(int(ranking.max()) + 1 if len(ranking) else 1, np.uint32)
    rank_of[ranking] = np.arange(len(ranking), dtype=np.uint32)

    ordered = (ids.withColumn("order", F.xxhash64("ids")).repartitionByRange("doc_id", "order")
               .sortWithinPartitions("doc_id", "order").drop("order"))
    segments = ordered.mapInArrow(_writer(rank_of, kind, segment_ids), SEGMENT)
    segments.write.option("compression", "zstd").parquet(f"{path}/segments")
    spark = docs.sparkSession
    spark.createDataFrame(pa.table({"rank": pa.array(np.arange(len(ranking))), "id": pa.array(ranking, pa.int64())})) \
        .coalesce(1).write.parquet(f"{path}/ranking")
    per = spark.read.parquet(f"{path}/segments").groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)     # one row per partition
    per.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")) \
        .coalesce(1).write.parquet(f"{path}/parts")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids before the document), n_tokens and ids (binary,
    little-endian unsigned 32-bit), from the files of ``write_ids``."""
    ranking = spark.read.parquet(f"{path}/ranking").orderBy("rank").select("id").toArrow().column(0).to_numpy()
    segments = spark.read.schema(SEGMENT).parquet(f"{path}/segments")
    docs = segments.mapInArrow(_reader(ranking.astype(np.uint32)), READ)
    parts = F.broadcast(spark.read.parquet(f"{path}/parts"))             # one row per written partition
    return docs.join(parts, "part").select(
        "doc_id", (F.col("start") + F.col("first")).alias("start"),
        (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids")


def encode_to_files(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Write the files to a new shared folder and read them back."""
    path = scratch(docs.sparkSession, "id-files")
    write_ids(docs, tokenizer_path, path, end_id)
    return read_ids(docs.sparkSession, path)
