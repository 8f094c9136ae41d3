"""Presence-mask search against brute force."""

import math
import random
import re
from collections import Counter

import pytest

from storecast.llm import presence

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    per = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n, total = sum(c > 0 for _, _, c in per), sum(c for _, _, c in per)
    df = Counter(w for _, c, _ in per for w in c)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for doc, c, size in per:
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1)))
                    * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * (25 + 75 * size * n // total)))
                    for w in terms(text) if w in c)
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def random_case(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(120)] + ["Ünï", "漢字", "THE", "the", "a"]

    def text(n):
        return rng.choice([" ", ", ", "\n"]).join(vocab[min(int(rng.expovariate(0.05)), len(vocab) - 1)] for _ in range(n))
    docs = [(i, text(rng.randrange(0, 60))) for i in range(400)] + [(i, "w1 w2 w3 same") for i in range(400, 460)]
    docs += [(None, "w1 w2"), (None, None), (7, "w3 w4"), (7, "w3 w4"), (900, ""), (901, "w5 " * 9000)]
    items = [(i, text(rng.randrange(1, 25))) for i in range(25)]
    items += [(50, " ".join(vocab[:100])), (51, None), (52, ""), (53, "nowhere"), (3, "w1 w2"), (3, "w1 w2"), (None, "w9 w9 w9")]
    return docs, items


@pytest.mark.parametrize("seed,block,item_bytes", [(1, 8192, 8 << 20), (2, 37, 400)])
def test_equals_brute_force(llm, seed, block, item_bytes):
    docs, items = random_case(seed)
    d = llm.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, rank int, score string").repartition(3)
    i = llm.createDataFrame([(*r, 2) for r in items], "item_id long, text string, item int")
    got = presence.ranked_search(d, i, item_bytes=item_bytes, block_docs=block)
    assert rows(got) == brute(docs, items)


def test_long_document_in_pieces(llm, monkeypatch):
    docs = [(1, "alpha beta " * 400), (2, "beta gamma"), (3, "x" * 4000 + " alpha")]
    items = [(1, "alpha beta"), (2, "gamma alpha")]
    data, offsets = presence.bw.buffers(__import__("pyarrow").array([t for _, t in docs]))
    monkeypatch.setattr(presence, "PIECE_BYTES", 300)
    import pyarrow as pa
    vocab = presence.Vocabulary([t for _, t in items])
    out = list(presence._indexer(vocab, 10)([pa.RecordBatch.from_arrays(
        [pa.array([1, 2, 3]), pa.array([t for _, t in docs])], names=["doc_id", "text"])]))
    assert sum(b.column("n_terms").to_pylist()[0] for b in out) == 804
    assert sum(b.column("n_docs").to_pylist()[0] for b in out) == 3


def test_masks_are_evaluated_until_safely_finished():
    """Groups that cannot reach the list are not scored."""
    import numpy as np
    rng = np.random.default_rng(0)
    n = 5000
    members = [np.flatnonzero(rng.random(n) < p) for p in (0.5, 0.5, 0.01, 0.02)]
    row = {"doc_ids": list(range(n)), "sizes": np.full(n, 10, "<i8").tobytes(),
           "terms": np.arange(4, dtype="<u4").tobytes(), "dfs": np.array([len(m) for m in members], "<u4").tobytes(),
           "members": np.concatenate(members).astype("<u4").tobytes(),
           "tfs": np.ones(sum(map(len, members)), "<u4").tobytes()}
    block = presence.Block.read(row, n, 10 * n)
    best = presence.BestList(10)
    scored = presence.search_block(block, np.arange(4), np.array([1, 1, 50, 40]), best)
    assert 10 <= scored < 300 and len(best.rows) == 10
    again = presence.search_block(block, np.arange(4), np.array([1, 1, 50, 40]), best)
    assert again <= scored


def test_empty_tables(llm, empty):
    items = llm.createDataFrame([(1, "a b")], "item_id long, text string")
    assert presence.ranked_search(empty, items).count() == 0
    assert presence.ranked_search(items.withColumnRenamed("item_id", "doc_id"), items.where("item_id > 5")).count() == 0
