"""Classifiers against plain models of unhashed features, and the pipeline against a plain one."""

import base64
import collections
import hashlib
import itertools
import math
import os
import random
import re

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

from storecast.llm import bytewords, curriculum, exactdedup, langid, toxicity

LETTERS = "abcdefghijklmnopqrst"


def made_words(rnd, letters, n):
    """Words without a repeated letter, so without a repeated n-gram."""
    return ["".join(rnd.sample(letters, rnd.randint(3, 7))) for _ in range(n)]


def grams(word, orders):
    w = f"^{word}$"
    return [(k, w[i:i + k]) for k in orders for i in range(len(w) - k + 1)]


def block(texts):
    return bytewords.buffers(pa.array(texts, pa.string()))


# -- toxicity ---------------------------------------------------------------------------

def test_toxicity_equals_a_dense_model(monkeypatch):
    monkeypatch.setattr(toxicity, "BITS", 22)
    rnd = random.Random(5)
    clean, foul = made_words(rnd, LETTERS, 40), made_words(rnd, LETTERS[::-1], 8)
    texts, y = [], []
    for i in range(30):
        words = rnd.choices(clean, k=12) + (rnd.choices(foul, k=2) if i % 3 == 0 else [])
        texts.append(" ".join(words))
        y.append(int(i % 3 == 0))
    model = toxicity.NbLinear().fit(texts, y, epochs=25)

    sets = [set(t.split()) for t in texts]
    names = sorted({g for s in sets for w in s for g in grams(w, toxicity.ORDERS)})
    at = {g: i for i, g in enumerate(names)}

    def row(words):
        x = np.zeros(len(names))
        for w in words:
            for g in grams(w, toxicity.ORDERS):
                if g in at:
                    x[at[g]] += 1
        return x

    x, y = np.array([row(s) for s in sets]), np.array(y, float)
    smooth, size = toxicity.SMOOTH, 1 << 22
    toxic, other = y @ x + smooth, (1 - y) @ x + smooth
    unseen = (size - len(names)) * smooth
    ratio = np.log(toxic / (toxic.sum() + unseen)) - np.log(other / (other.sum() + unseen))
    scaled, beta = x * ratio, np.zeros(len(names))
    bias = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    m, v, mb, vb = 0 * beta, 0 * beta, 0.0, 0.0
    for step in range(1, 26):
        err = y - 1 / (1 + np.exp(-(scaled @ beta + bias)))
        g, gb = scaled.T @ err / len(y) - toxicity.PENALTY * beta, err.mean()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        a, b = 1 - 0.9 ** step, 1 - 0.99 ** step
        beta += toxicity.RATE * (m / a) / (np.sqrt(v / b) + 1e-8)
        bias += toxicity.RATE * (mb / a) / (math.sqrt(vb / b) + 1e-8)
    asked = texts + [" ".join(rnd.choices(clean, k=5) + [foul[0].upper()]), "", "12 34", None]
    want = [1 / (1 + np.exp(-(row(set((t or "").lower().split())) @ (beta * ratio) + bias))) for t in asked]
    got = model.score(*block(asked))
    assert np.abs(got - want).max() < 5e-3
    assert max(got) > 0.9 and min(got) < 0.1 and got[-1] == got[-2] == got[-3]


# -- language ---------------------------------------------------------------------------

def lang_features(word):
    out = grams(word, langid.ORDERS)
    for k in langid.AFFIXES:
        if len(word) >= k:
            out += [("prefix", word[:k]), ("suffix", word[-k:])]
    return [*out, ("word", word)]


def by_enumeration(e, t):
    """Posterior of every word, expected moves (first move from a uniform start) by all label paths."""
    n, labels = e.shape
    post, moves = np.zeros_like(e), np.zeros((labels, labels))
    total = 0.0
    for path in itertools.product(range(labels), repeat=n + 1):
        p = math.prod(t[path[i], path[i + 1]] * e[i, path[i + 1]] for i in range(n))
        total += p
        for i in range(n):
            post[i, path[i + 1]] += p
            moves[path[i], path[i + 1]] += p
    return post / total, moves / total


def test_language_equals_a_dense_field(monkeypatch):
    monkeypatch.setattr(langid, "BITS", 20)
    rnd = random.Random(8)
    names = ["de", "en", "fr"]
    vocab = {n: made_words(rnd, LETTERS[4 * i:4 * i + 12], 10) for i, n in enumerate(names)}
    texts, langs = [], []
    for i in range(12):
        lang = names[i % 3]
        texts.append(" ".join(rnd.choices(vocab[lang], k=rnd.randint(1, 4))))
        langs.append(lang)
    epochs = 4
    model = langid.Crf(names).fit(texts, langs, epochs)

    feats = sorted({f for t in texts for w in t.split() for f in lang_features(w)}, key=str)
    at = {f: i for i, f in enumerate(feats)}

    def row(word):
        x = np.zeros(len(feats))
        for f in lang_features(word):
            if f in at:
                x[at[f]] += 1
        return x

    chains = [(np.array([row(w) for w in t.split()]), names.index(g)) for t, g in zip(texts, langs)]
    total = sum(len(x) for x, _ in chains)
    weight, trans = np.zeros((len(feats), 3)), np.zeros((3, 3))
    g2w, g2t = np.full_like(weight, 1e-8), np.full_like(trans, 1e-8)
    for _ in range(epochs):
        gw, gt, t = 0 * weight, 0 * trans, np.exp(trans)
        for x, gold in chains:
            post, moves = by_enumeration(np.exp(x @ weight), t)
            one = np.zeros((len(x), 3))
            one[:, gold] = 1
            gw += x.T @ (one - post)
            # Labelled moves; the unlabelled start is what the model expects before the first label.
            gt[gold, gold] += len(x) - 1
            gt[:, gold] += t[:, gold] / t[:, gold].sum()
            gt -= moves
        gw, gt = gw / total - langid.PENALTY * weight, gt / total - 1e-3 * trans
        g2w += gw * gw
        g2t += gt * gt
        weight += langid.RATE * gw / np.sqrt(g2w)
        trans += langid.RATE * gt / np.sqrt(g2t)
    mixed = [" ".join(rnd.choices(vocab[a], k=2) + rnd.choices(vocab[b], k=3)) for a, b in itertools.product(names, names)]
    asked = texts + mixed + ["unseen qzj", "1 2", None]
    got = model.predict(*block(asked))
    for i, text in enumerate(asked):
        words = re.findall("[a-z]+", text or "")
        assert got[2][i] == len(words)
        if not words:
            assert (got[0][i], got[1][i], got[3][i]) == ("und", 0, 0)
            continue
        post, _ = by_enumeration(np.exp(np.array([row(w) for w in words]) @ weight), np.exp(trans))
        mass = post.sum(axis=0)
        assert abs(got[1][i] - mass.max() / len(words)) < 1e-3
        if np.sort(mass)[-1] - np.sort(mass)[-2] > 1e-3:
            assert got[0][i] == names[mass.argmax()]
        if (np.sort(post, axis=1)[:, -1] - np.sort(post, axis=1)[:, -2]).min() > 1e-3:
            assert got[3][i] == (np.diff(post.argmax(axis=1)) != 0).sum()


def test_rare_language_is_in_the_sample(llm):
    rows = [(i, f"text {i}", "en") for i in range(600)] + [(600, "ein satz", "de"), (601, None, "fr"), (600, "ein satz", "de")]
    docs = llm.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.fit_sample(docs, F.col("lang"), F.lit(True), 30, 1000)
    assert 1 <= len(got) <= 30 and ("ein satz", "de") in got and all(t is not None for t, _ in got)
    order = [r.doc_id for r in docs.select("doc_id").where("doc_id < 600").orderBy(
        F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(20).collect()]
    assert {f"text {i}" for i in order} <= {t for t, _ in got}
    assert langid.fit_sample(docs.limit(0), F.col("lang"), F.lit(True), 30, 1000) == []


# -- hot ids ------------------------------------------------------------------------------

def plain_targets(sizes, weights=curriculum.WEIGHTS, budget=curriculum.BUDGET, cap=curriculum.CAP):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = budget * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] >= cap * sizes[s]]
        if not over:
            out.update({s: level * weight[s] for s in free})
            break
        for s in over:
            out[s] = float(cap * sizes[s])
            left -= out[s]
            free.remove(s)
    return out


def plain_mix(rows):
    """(doc_id, source, text) -> multiset of (doc_id, source, size, passes)."""
    def size(text):
        return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))

    def seeded(i):
        return int(hashlib.md5(f"{curriculum.SEED}:{'' if i is None else i}".encode()).hexdigest()[:15], 16)

    sizes = collections.Counter()
    for _, s, t in rows:
        sizes[s] += size(t)
    target = plain_targets(sizes)
    out, at = collections.Counter(), collections.Counter()
    for i, s, t in sorted(rows, key=lambda r: (seeded(r[0]), -1 if r[0] is None else r[0], size(r[2]))):
        n = sum(at[s] + k * sizes[s] + size(t) / 2 < target[s] for k in range(curriculum.CAP))
        at[s] += size(t)
        out[i, s, size(t), n] += 1
    return out


def test_mix_of_hot_ids_equals_plain_mix(llm):
    rnd = random.Random(4)
    rows = [(rnd.choice([None, None, 7, 7, i]), rnd.choice(["a", "a", "b", None, "c"]), "w " * rnd.choice([0, 1, 5, 5, 60]))
            for i in range(900)]
    docs = llm.createDataFrame(rows, "doc_id long, source string, text string").withColumn("_row", F.lit(1)).withColumn(
        "position", F.lit("x"))
    want = plain_mix(rows)
    for slice_rows, parts in ((100_000, 3), (9, 5)):
        got = curriculum.mix(docs.repartition(parts), slice_rows=slice_rows).collect()
        assert collections.Counter((r.doc_id, r.source, r.size, r.passes) for r in got) == want


def test_slices_are_bounded_whatever_the_id(llm):
    docs = llm.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.lit("a b").alias("text"))
    rows = curriculum.sized(docs).withColumn("_row", F.monotonically_increasing_id())
    sizes = [r["count"] for r in curriculum._sliced(rows, 100).groupBy("_slice").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) < 400


def test_copies_without_an_id_keep_one_row(llm):
    texts = ["same  text"] * 400 + ["same text"] * 300 + ["other"] * 50
    docs = llm.createDataFrame([(None if i % 2 else 5, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    out = exactdedup.exact_dedup(docs)
    kept = out.where("kept").collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in kept) == [(None, None, 50), (None, None, 700)]
    assert out.count() == len(texts) and "Window" not in out._jdf.queryExecution().optimizedPlan().toString()


# -- pipeline -----------------------------------------------------------------------------

def near(a, b):
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    return len(grams(a) & grams(b)) >= 0.8 * len(grams(a) | grams(b))


def test_pipeline_equals_a_plain_one(llm, tmp_path):
    import corpus_pipeline as cp
    rnd = random.Random(12)
    vocab = {"en": made_words(rnd, LETTERS[:10], 400), "xx": made_words(rnd, LETTERS[10:], 400)}
    rows = []

    def add(text, lang, source):
        rows.append((len(rows), text, lang, source))

    for k in range(40):
        lang = ["en", "en", "xx"][k % 3]
        words = rnd.choices(vocab[lang], k=rnd.randint(40, 90))
        add(" ".join(words), lang, f"s{k % 4}" if k % 4 else None)
        if k % 5 == 0:                  # a copy up to blanks, a near copy
            add("\n".join(words), lang, "s1")
            add(" ".join([*words[:-1], "1999"]), lang, "s2")
    for text in (None, "", " \n", "12 345", "...", "# 1"):
        add(text, "en", "s3")
    cols = "doc_id long, text string, lang string, source string, position string"
    llm.createDataFrame([(*r, "p") for r in rows], cols).repartition(3).write.parquet(os.path.join(tmp_path, "documents.parquet"))

    at = [r for r in rows if r[1] and re.search("[a-z]", r[1])]
    seen, kept = set(), []
    for r in at:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r[1])
        if key not in seen:
            kept.append(r)
            seen.add(key)
    at = []
    for r in kept:                      # groups are one original and one near copy: no chains
        if not any(near(r[1], o[1]) for o in at):
            at.append(r)
    assert len(at) == 40 and len(kept) == 48
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(cp.BYTE_RANKS, "rb"))}
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = {r[0]: r[1] for r in at}
    want = collections.Counter()
    for (i, _, _, passes), n in plain_mix([(r[0], r[3], r[1]) for r in at]).items():
        if passes:
            want[i, tuple(coder.encode_ordinary(text[i])), hashlib.sha256(text[i].encode()).hexdigest()] += n * passes
    got = cp.run(llm, str(tmp_path)).collect()
    assert collections.Counter((r.doc_id, tuple(r.ids), r.decoded_sha256) for r in got) == want
    assert all(r.n_tokens == len(r.ids) for r in got)
