"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps the measurements
and one bit per failed rule, so a policy (a named, versioned set of rules) is a
mask: applying a policy, comparing two versions or taking a rule away (an
ablation) is bitwise arithmetic on the ledger and never reads a text again.

Edge cases: a null or empty text has no words and no lines; all its counts are
0 and it fails ``too_few_words``.  Repeated rows are measured one by one.  Long
texts are measured whole.  Other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storecast.llm import bytewords as bw

WINDOW = 8
SYMBOLS = b"#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
            "n_upper")
LEDGER = T.StructType([T.StructField("doc_id", T.LongType())]
                      + [T.StructField(m, T.LongType()) for m in MEASURES])

# name -> condition of failure over the measurements; the position is the bit.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbol_share": "2 * n_symbols > n_words",
    "duplicate_lines": "n_lines >= 10 AND 10 * n_dup_lines > 7 * n_lines",
    "long_words": "word_chars > 60 * n_words",
    "upper_case": "n_upper * 100 > 45 * word_chars",
}
BASE = ("too_few_words", "repeated_windows")

# Policies never change once named: a new choice is a new version.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": BASE,
    "v2": BASE + ("symbol_share", "long_words"),
    "v3": BASE + ("symbol_share", "duplicate_lines", "long_words", "upper_case"),
}
CURRENT = "v3"

_WORDS = bw.table()
_LINES = bw.table(b"\n")
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(SYMBOLS)] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_POINT = np.ones(256, np.int64)       # first bytes of code points
_POINT[0x80:0xC0] = 0


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offsets[1:]] - total[offsets[:-1]]


def measure_block(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The measurements of the documents of one block, in ``MEASURES`` order."""
    n = len(offsets) - 1
    words = bw.Tokens(data, offsets, _WORDS)
    word_byte = _WORDS[data] != 0
    n_words = words.counts()

    lines = bw.Tokens(data, offsets, _LINES)
    in_words = np.concatenate([[0], np.cumsum(word_byte)])
    with_word = in_words[lines.end] > in_words[lines.start]
    line_doc, line_hash = lines.doc[with_word], lines.hash[with_word]
    _, later = bw.repeated(line_doc, line_hash)

    gram, first = bw.grams(words, WINDOW)
    twice, _ = bw.repeated(words.doc[first], gram)
    edge = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(edge, first[twice], 1)
    np.add.at(edge, np.minimum(first[twice] + WINDOW, len(words.hash)), -1)
    covered = np.cumsum(edge[:-1]) > 0

    return [n_words, _per_doc(_POINT[data] * word_byte, offsets), _per_doc(_SYMBOL[data], offsets),
            np.bincount(line_doc, minlength=n), np.bincount(line_doc[later], minlength=n),
            np.bincount(words.doc[covered], minlength=n), _per_doc(_UPPER[data], offsets)]


def _measure(batches):
    for batch in batches:
        data, offsets = bw.buffers(batch.column("text"))
        parts = [measure_block(d, o) for _, _, d, o in bw.blocks(data, offsets)]
        if parts:
            cols = [np.concatenate([p[i] for p in parts]).astype(np.int64) for i in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")] + [pa.array(c) for c in cols],
                                             names=LEDGER.names)


def mask_of(rules) -> int:
    """The bit mask of some rules."""
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def failure_bits() -> Column:
    """One long with a bit for every failed rule, over the measurement columns."""
    bits = [F.when(F.expr(cond), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
            for i, cond in enumerate(RULES.values())]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def build_ledger(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, the measurements and ``fail_bits``.
    Reads ``doc_id`` and ``text``; no shuffle."""
    measured = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_measure, LEDGER)
    return measured.withColumn("fail_bits", failure_bits())


def apply_policy(ledger: DataFrame, version: str = CURRENT) -> DataFrame:
    """``kept``: no rule of the policy failed; ``base_failed``: a base rule did."""
    bits = F.col("fail_bits")
    return (ledger.withColumn("base_failed", bits.bitwiseAND(F.lit(mask_of(BASE))) != 0)
                  .withColumn("kept", bits.bitwiseAND(F.lit(mask_of(POLICIES[version]))) == 0))


def ablation(ledger: DataFrame, version: str = CURRENT) -> DataFrame:
    """Per rule of a policy: documents it fails, documents only it fails, and
    documents kept without it.  The ledger is first summed to one row per
    distinct bit pattern (at most two to the number of rules)."""
    rules, mask = POLICIES[version], mask_of(POLICIES[version])
    patterns = ledger.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask_of([r])).cast("long").alias("bit"))
                               for r in rules])).alias("r")
    p = patterns.select("bits", "n", rows).select("bits", "n", "r.*")

    def total(cond):
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")

    has = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return p.groupBy("rule").agg(
        total(has).alias("n_failed"),
        total(F.col("bits") == F.col("bit")).alias("n_only"),
        total((F.col("bits") == 0) | (F.col("bits") == F.col("bit"))).alias("n_kept_without"))
