"""License scan: fixed phrases, and an exact set-similarity join with templates.

A text is lower-cased (A-Z) and cut into words of letters, digits and non-ASCII
characters.

* Phrases: places where a phrase's words stand one after another.
* Templates: a text block (any ``BLOCK`` words in a row, whatever word they
  start at) matches a template if it contains at least ``THRESHOLD`` of the
  template's distinct words.  Only blocks that start at a template word and end
  later than the block before them are looked at: the template words of every
  other block are among theirs.  The join is exact:

  1. the words of all templates are counted over all documents and put in one
     global order, rarest first;
  2. a template is indexed by its prefix only: the first
     |T| - ceil(threshold |T|) + 1 words in that order, as a block that misses
     all of them misses too much;
  3. blocks with too few template words are left out (length filter);
  4. blocks and templates meet on a prefix word; a pair goes on only if the
     words after the meeting point can still reach the threshold (positional
     filter), and is then verified on the full sets.

The template list is a parameter of fixed size: only it, its words' counts and
its index are ever broadcast.

A null or empty text has no words, no labels and score 0.  Repeated rows are
scanned one by one; very long texts whole.  Ties in frequency go by the word.  An
empty table gives no rows.  Only doc_id and text are read, so other columns may
have any name.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storecast.llm import bytewords as bw
from storecast.llm.common import saved, small, text_or_empty

BLOCK = 48
THRESHOLD = 0.8

# The phrases of the contract.
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

# Opening sentences of public license notices (24 words at most,
# so that each lies whole in some block).
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and "
     "associated documentation files", "mit"),
    ("licensed under the apache license version 2 0 you may not use this file except in compliance with "
     "the license", "apache-2"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu "
     "general public license", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided "
     "that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under a creative commons attribution noncommercial license cc by nc", "cc-by-nc"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is "
     "hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]

_WORDS = bw.table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), fold=True)

SCANNED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text_key", T.LongType()),
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.ArrayType(T.StringType())),
    T.StructField("blocks", T.ArrayType(T.ArrayType(T.IntegerType())))])


def _hashes(text: str) -> np.ndarray:
    data, offsets = bw.buffers(pa.array([text]))
    return bw.Tokens(data, offsets, _WORDS).hash


def vocabulary(templates) -> list[str]:
    return sorted({w for text, _ in templates for w in text.split()})


def needed(n: int, threshold: float) -> int:
    """Fewest of ``n`` words that reach the threshold."""
    return math.ceil(threshold * n - 1e-9)


def _counter(vocab: list[str]):
    hashes = np.concatenate([_hashes(w) for w in vocab])
    order = np.argsort(hashes)
    keys = hashes[order]

    def run(batches):
        total = np.zeros(len(vocab), np.int64)
        for batch in batches:
            data, offsets = bw.buffers(batch.column(0))
            for _, _, d, o in bw.blocks(data, offsets):
                h = bw.Tokens(d, o, _WORDS).hash
                i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                total += np.bincount(order[i[keys[i] == h]], minlength=len(vocab))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(vocab))), pa.array(total)], names=["word", "n"])
    return run


def global_order(docs: DataFrame, templates) -> list[str]:
    """The templates' words, rarest over all documents first."""
    vocab = vocabulary(templates)
    counts = (docs.select("text").mapInArrow(_counter(vocab), "word long, n long")
              .groupBy("word").agg(F.sum("n").alias("n")).collect())          # one row per template word
    n = {r.word: r.n for r in counts}
    return sorted(vocab, key=lambda w: (n.get(vocab.index(w), 0), w))


def _scanner(phrases, order: list[str], least: int, prefix_words: set[int], block: int):
    phrase_hashes = [(_hashes(text), label) for text, label in phrases]
    hashes = np.concatenate([_hashes(w) for w in order])
    sort = np.argsort(hashes)
    keys = hashes[sort]
    is_prefix = np.zeros(len(order) + 1, bool)
    is_prefix[list(prefix_words)] = True

    def scan(d, o):
        t = bw.Tokens(d, o, _WORDS)
        n = t.n_docs
        n_words = t.counts()
        begin = np.cumsum(n_words) - n_words
        n_base = np.zeros(n, np.int64)
        low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        labels: list[set] = [set() for _ in range(n)]
        for ph, label in phrase_hashes:
            m = len(t.hash) - len(ph) + 1
            if m <= 0:
                continue
            hit = t.doc[:m] == t.doc[len(ph) - 1:]
            for j, x in enumerate(ph):
                hit &= t.hash[j:j + m] == x
            at = np.flatnonzero(hit)
            doc = t.doc[at]
            np.add.at(n_base, doc, 1)
            np.minimum.at(low, doc, at - begin[doc])
            np.maximum.at(high, doc, at - begin[doc])
            for x in set(doc.tolist()):
                labels[x].add(label)
        # Template words, and for each the block that starts there.
        i = np.minimum(np.searchsorted(keys, t.hash), len(keys) - 1)
        at = np.flatnonzero(keys[i] == t.hash)
        word, doc = sort[i[at]], t.doc[at]
        blocks: list[list] = [[] for _ in range(n)]
        if len(at):
            # Word places with a gap of a block between documents, so that one search finds all ends.
            place = at + doc * block
            end = np.searchsorted(place, place + block)
            widest = np.concatenate([[True], end[1:] > end[:-1]])
            b = np.flatnonzero(widest & (end - np.arange(len(at)) >= least))
            size = end[b] - b
            nth = np.repeat(np.arange(len(b)), size)
            inside = np.arange(len(nth)) - np.repeat(np.cumsum(size) - size - b, size)
            code = np.unique(nth * (len(order) + 1) + word[inside])
            nth, held = code // (len(order) + 1), code % (len(order) + 1)
            distinct = np.bincount(nth, minlength=len(b))
            go = (distinct >= least) & (np.bincount(nth, is_prefix[held], minlength=len(b)) > 0)
            first = np.cumsum(distinct) - distinct
            for k in np.flatnonzero(go).tolist():
                blocks[int(doc[b[k]])].append(held[first[k]:first[k] + distinct[k]].tolist())
        return n_words, n_base, np.where(n_base > 0, low, -1), high, labels, blocks

    def run(batches):
        for batch in batches:
            data, offsets = bw.buffers(batch.column("text"))
            parts = [scan(d, o) for _, _, d, o in bw.blocks(data, offsets)]
            if not parts:
                continue
            n_words, n_base, low, high = (np.concatenate([p[i] for p in parts]) for i in range(4))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(n_words), pa.array(n_base),
                 pa.array(low, mask=low < 0), pa.array(high, mask=high < 0),
                 pa.array([sorted(x) for p in parts for x in p[4]], pa.list_(pa.string())),
                 pa.array([x for p in parts for x in p[5]], pa.list_(pa.list_(pa.int32())))], names=SCANNED.names)
    return run


def scan_licenses(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD,
                  block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, text_key, n_words, n_base, first_word,
    last_word, base_labels, labels (arrays) and score: the largest share of a
    template that a matching block contains, 1 where a phrase stands."""
    spark = docs.sparkSession
    order = global_order(docs, templates)
    rank = {w: i for i, w in enumerate(order)}
    sets = [(sorted({rank[w] for w in text.split()}), label) for text, label in templates]
    index = [(w, k, i, len(s), needed(len(s), threshold))
             for k, (s, _) in enumerate(sets) for i, w in enumerate(s[:len(s) - needed(len(s), threshold) + 1])]
    least = min(needed(len(s), threshold) for s, _ in sets)
    scanned = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                                F.xxhash64(text_or_empty()).alias("text_key"), "text")
                    .mapInArrow(_scanner(phrases, order, least, {x[0] for x in index}, block), SCANNED),
                    "license-scan")

    probes = F.broadcast(spark.createDataFrame(index, "word int, template int, t_at int, t_size int, need int"))
    full = F.broadcast(spark.createDataFrame([(k, s, label) for k, (s, label) in enumerate(sets)],
                                             "template int, t_words array<int>, label string"))
    blocks = (scanned.where(F.size("blocks") > 0)
              .select("doc_id", "text_key", F.posexplode("blocks").alias("block", "words")))
    met = (blocks.select("*", F.posexplode("words").alias("b_at", "word")).join(probes, "word")
           .where((F.size("words") >= F.col("need"))                                             # length
                  & (F.least(F.col("t_size") - F.col("t_at"), F.size("words") - F.col("b_at"))   # position
                     >= F.col("need"))))
    pairs = met.join(full, "template").withColumn("both", F.size(F.array_intersect("words", "t_words"))) \
               .where(F.col("both") >= F.col("need"))
    found = pairs.groupBy("doc_id", "text_key").agg(
        F.collect_set("label").alias("more"), F.max(F.col("both") / F.col("t_size")).alias("share"))
    found = small(saved(found, "license-found")).select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "more", "share")
    empty = F.array().cast("array<string>")
    joined = scanned.drop("blocks").join(
        found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    return joined.select(
        "doc_id", "text_key", "n_words", "n_base", "first_word", "last_word", "base_labels",
        F.sort_array(F.array_union("base_labels", F.coalesce("more", empty))).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))
