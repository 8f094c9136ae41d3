"""Operators against brute force, libraries and exact round trips."""

import base64
import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from storecast.llm import (bytebpe, bytewords, chat, curriculum, exactdedup, freqcode, langid, licenses, neardup,
                           pretoken, rules, toxicity)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# -- word splitting and the rule ledger ---------------------------------------

PIECES = ["'", "s", "re", "LL", " ", "\n", " ", "é", "1", "!", "漢", "́", "A", "😀", "#", "b c"]


def noise(seed, n, size=60):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, size))) for _ in range(n)]


def test_split_spaced_is_the_pattern():
    import regex
    texts = [None, ""] + noise(1, 800)
    data, offsets = bytewords.buffers(pa.array(texts))
    cp, at = pretoken.code_points(data)
    starts = at[pretoken.split_spaced(cp, np.searchsorted(at, offsets[:-1]))]
    raw = data.tobytes()
    got = [raw[a:b].decode() for a, b in zip(starts, np.append(starts[1:], len(raw)))]
    assert got == [m for t in texts for m in regex.findall(P.PATTERN, t or "")]


def brute_measures(text):
    words = WORD.findall(text)
    windows = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return [len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines),
            len(lines) - len(set(lines)), len(covered), sum("A" <= c <= "Z" for c in text)]


def test_ledger_equals_brute_force(llm, odd, empty):
    for row in rows_of(rules.build_ledger(odd).where("doc_id < 20").distinct()):
        texts = [r.text or "" for r in odd.where(F.col("doc_id") == row["doc_id"]).collect()]
        assert [row[m] for m in rules.MEASURES] in [brute_measures(t) for t in texts]
    texts = noise(2, 300, 200)
    data, offsets = bytewords.buffers(pa.array(texts))
    got = np.concatenate([np.array(rules.measure_block(d, o)).T for _, _, d, o in bytewords.blocks(data, offsets, 400)])
    assert got.tolist() == [brute_measures(t) for t in texts]
    assert rules.apply_policy(rules.build_ledger(empty)).count() == 0


def test_ablation_counts(llm, odd):
    ledger = rules.apply_policy(rules.build_ledger(odd), "v2")
    bits = [r.fail_bits for r in ledger.collect()]
    for r in rules.ablation(ledger, "v2").collect():
        bit, mask = rules.mask_of([r.rule]), rules.mask_of(rules.POLICIES["v2"])
        assert r.n_failed == sum(bool(b & bit) for b in bits)
        assert r.n_only == sum(b & mask == bit for b in bits)
        assert r.n_kept_without == sum(b & mask & ~bit == 0 for b in bits)


# -- tokenizers -----------------------------------------------------------------

@pytest.fixture(scope="module")
def reference_bpe():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_library(llm, odd, empty, reference_bpe):
    docs = odd.select("doc_id", "text").unionByName(llm.createDataFrame(
        [(100 + i, t) for i, t in enumerate(noise(3, 300))], "doc_id long, text string"))
    want = collections.Counter((r.doc_id, tuple(reference_bpe.encode_ordinary(r.text or "")), (r.text or "").encode())
                               for r in docs.collect())
    for made in (bytebpe.encode_decode(docs, RANKS), bytebpe.decode(bytebpe.encode(docs, RANKS), RANKS)):
        assert collections.Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in made.collect()) == want
    assert bytebpe.encode_decode(empty, RANKS).count() == 0


def test_higher_order_form_equals_library(llm, reference_bpe):
    texts = noise(4, 60) + ["", "thinking aloud"]
    docs = llm.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    bpe = bytebpe.ByteBPE(llm, RANKS, P.PATTERN)
    for r in docs.select("text", bpe.encode(F.col("text")).alias("ids")).withColumn(
            "back", bpe.decode(F.col("ids"))).collect():
        assert r.ids == ",".join(map(str, reference_bpe.encode_ordinary(r.text)))
        assert bytes(r.back).decode() == r.text


def test_variable_length_coding_round_trip():
    values = np.array([0, 1, 255, 256, 65535, 65536, 2 ** 24 - 1, 2 ** 24, 2 ** 32 - 1, 7], np.uint32)
    for n in range(len(values) + 1):
        assert freqcode.unpack(*freqcode.pack(values[:n]), n).tolist() == values[:n].tolist()


def test_id_files_equal_library(llm, odd):
    tok = Tokenizer.from_file(WORDS)
    docs = odd.select("doc_id", "text").unionByName(llm.createDataFrame(
        [(500 - i, t) for i, t in enumerate(noise(5, 300))], "doc_id long, text string"))
    got = freqcode.encode_to_files(docs, WORDS).collect()
    want = collections.Counter((r.doc_id, tuple(tok.encode(r.text or "", add_special_tokens=False).ids + [2]))
                               for r in docs.collect())
    assert collections.Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    got = sorted(got, key=lambda r: r.start)
    assert [r.start for r in got] == list(itertools.accumulate([0] + [r.n_tokens for r in got]))[:-1]
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)


def test_id_files_of_an_empty_table(llm, empty):
    assert freqcode.encode_to_files(empty, WORDS).count() == 0


# -- classifiers ------------------------------------------------------------------

def test_forward_backward_equals_plain_recursion():
    rng = np.random.default_rng(0)
    chain, scores, trans = np.sort(rng.integers(0, 5, 600)), rng.normal(size=(600, 3)), rng.normal(size=(3, 3))
    post = langid.forward_backward(scores, trans, langid.Pieces(chain))[0]
    for c in np.unique(chain):
        e, t = np.exp(scores[chain == c]), np.exp(trans)
        a, b, p = np.zeros_like(e), np.ones_like(e), np.ones(3) / 3
        for i in range(len(e)):
            p = (p @ t) * e[i]
            p /= p.sum()
            a[i] = p
        for i in range(len(e) - 2, -1, -1):
            b[i] = t @ (e[i + 1] * b[i + 1])
            b[i] /= b[i].sum()
        q = a * b / (a * b).sum(1, keepdims=True)
        assert np.abs(q - post[chain == c]).max() < 1e-4


def test_language_accuracy_and_edges(llm, odd, empty):
    docs = llm.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = langid.held_out(5, 0)
    model = langid.train(docs, ~held)
    rows = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(held).collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.95
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    out = langid.identify(odd, model).collect()
    assert len(out) == odd.count()
    assert all((r.lang_pred == "und") == (r.n_words == 0) and 0 <= r.score <= 1 for r in out)
    assert langid.identify(empty, langid.train(empty, ~held)).count() == 0
    assert langid.accept(odd, model).columns == odd.columns


def test_toxicity_held_out(llm, odd, empty):
    docs = llm.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = llm.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = langid.held_out(3, 1)
    model = toxicity.train(docs, labels, ~held)
    rows = toxicity.score(docs, model).join(labels, "doc_id").where(held).collect()
    hit = np.mean([r.score >= 0.7 for r in rows if r.toxic == 1])
    false = np.mean([r.score >= 0.7 for r in rows if r.toxic == 0])
    assert hit > 0.85 and false < 0.01
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, model).collect())
    none = toxicity.train(empty, labels.limit(0), ~held)
    assert {r.score for r in toxicity.score(odd, none).collect()} == {0.0}


# -- deduplication ------------------------------------------------------------------

def test_filters_lose_nothing():
    rng = np.random.default_rng(1)
    fps = np.unique(rng.integers(0, 2 ** 64, 5000, dtype=np.uint64))
    n = rng.integers(1, 9, len(fps)).astype(np.uint64)
    for bits in (0, 3):
        slices = fps >> np.uint64(64 - bits) if bits else np.zeros(len(fps), np.uint64)
        for s in np.unique(slices).tolist():
            own = slices == s
            back = exactdedup.decode_filter(s, *exactdedup.encode_filter(fps[own], n[own], bits), bits)
            assert (back[0] == fps[own]).all() and (back[1] == n[own]).all()


def test_exact_dedup(llm, odd, empty):
    got = collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in
                              exactdedup.exact_dedup(odd).collect())
    groups = collections.defaultdict(list)
    for r in odd.collect():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")].append(r.doc_id)
    want = collections.Counter()
    for text, ids in groups.items():
        low = None if None in ids else min(ids)
        want.update((i, low, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids)
    assert got == want
    assert exactdedup.exact_dedup(odd).where("kept").count() == len(groups)
    assert exactdedup.exact_dedup(empty).count() == 0


def shingles(text):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_jaccard_join_equals_all_pairs(llm):
    rnd = random.Random(7)
    base = [[f"w{rnd.randint(0, 500)}" for _ in range(120)] for _ in range(6)]
    texts = []
    for b in base:
        for _ in range(14):
            t = list(b)
            for _ in range(rnd.randint(0, 4)):
                t[rnd.randrange(len(t))] = f"x{rnd.randint(0, 99)}"
            texts.append(" ".join(t))
    texts += [None, "", "a b", "a b", "a b c"]
    docs = llm.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    first = {}
    for i, s in sets.items():
        first.setdefault(s or ("none", i), i)
    cls = {i: first[s or ("none", i)] for i, s in sets.items()}
    reps = sorted(set(cls.values()))
    links, root = collections.Counter(), {i: i for i in reps}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in itertools.combinations(reps, 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
            links.update([a, b])
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    for cell in (256, 5):            # one cell, and many cells
        for r in neardup.jaccard_join(docs, cell=cell).collect():
            c = cls[r.doc_id]
            assert (r.class_id, r.n_links, r.group_id, r.kept) == (c, links[c], find(c), find(c) == r.doc_id)


def test_jaccard_join_edges(llm, odd, empty):
    assert neardup.jaccard_join(odd).count() == odd.count()
    assert neardup.jaccard_join(empty).count() == 0
    bands, rows = neardup.choose_bands(0.8, 0.999)
    assert 1 - (1 - 0.8 ** rows) ** bands >= 0.999


# -- chat, licenses, mix ---------------------------------------------------------------

def test_escape_round_trip():
    rnd = random.Random(9)
    bits = [*chat.CONTROL, "\\", "<", "[", "/s>", "|", "x", "\n", "[INS", "T]"]
    for _ in range(3000):
        t = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 8)))
        assert chat.unescape(chat.escape(t)) == t
        assert not any(c in chat.escape(t) for c in chat.CONTROL)


def test_chat_parts_and_read_back(llm):
    content = ('[{"type":"text","text":"see <|image|>"},{"type":"image","ref":"a.png","width":56,"height":30},'
               '{"type":"document","ref":"d","parts":[{"type":"audio","ref":"b","seconds":2}]}]')
    rows = llm.createDataFrame([(1, 1, "assistant", "a\\</s>", None), (1, 0, "user", None, content),
                                (1, 1, "assistant", "a\\</s>", None), (None, None, None, None, None)],
                               "conv_id long, turn long, role string, text string, content string")
    made = {r.conv_id: r for r in chat.format_chats(rows).collect()}
    assert [(a.kind, a.ref, a.tokens) for a in made[1].attachments] == [("image", "a.png", 4), ("document", "d", 0),
                                                                        ("audio", "b", 50)]
    assert made[1].attachment_tokens == 54
    back = {r.conv_id: r for r in chat.read_chats(chat.format_chats(rows)).collect()}
    assert back[1].loss_texts == ["a\\</s>", "a\\</s>"]
    assert back[1].turns[0].text.startswith("see <|image|>")
    assert back[None].turns[0].text == ""
    assert chat.format_chats(rows.limit(0)).count() == 0


def test_license_edges(llm, odd, empty):
    docs = odd.select("doc_id", "text").unionByName(llm.createDataFrame(
        [(900, "x Under the MIT license, y"), (901, "This work is licensed under the GNU General Public License ver 3"),
         (902, "under the mité license")], "doc_id long, text string"))
    out = {r.doc_id: r for r in licenses.scan_licenses(docs).collect() if r.doc_id and r.doc_id >= 900}
    assert (out[900].n_base, out[900].first_word, out[900].labels) == (1, 1, ["mit"])
    assert out[901].labels == ["gpl-3"] and 0.8 <= out[901].score < 1
    assert out[902].n_base == 0 and out[902].labels == []
    assert licenses.scan_licenses(docs).count() == docs.count()
    assert licenses.scan_licenses(empty).count() == 0


def test_mix_meets_targets(llm, odd, empty):
    docs = llm.read.parquet("/root/testdata/sf0.1/documents.parquet")
    out = curriculum.mix(docs).toPandas()
    per = out.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), size=("size", "sum"))
    assert ((per.taken - per.target).abs() <= out["size"].max()).all()
    assert (out.taken <= 2 * out["size"]).all() and abs(per.target.sum() - 1.5 * out["size"].sum()) < 1
    assert out.positions.map(lambda p: all(0 <= t <= 1 for t in p)).all()
    assert curriculum.mix(odd).count() == odd.count()
    assert curriculum.mix(empty).count() == 0


def test_schedule_inverse():
    rnd = random.Random(3)
    for _ in range(200):
        a, b, t = rnd.uniform(0.1, 2), rnd.uniform(0.1, 2), rnd.random()
        share = (a * t + (b - a) * t * t / 2) / ((a + b) / 2)
        root = (a * a + 2 * (b - a) * share * (a + b) / 2) ** 0.5
        assert abs((root - a) / (b - a) - t) < 1e-6 if abs(a - b) > 1e-3 else True


def test_pipeline_stages_keep_columns(llm, odd, empty):
    import corpus_pipeline as cp
    for docs in (odd, empty):
        at = docs
        for name, stage in cp.STAGES[:-1]:
            at = stage(llm, at, "")
            assert at.columns == docs.columns, name
        cp.STAGES[-1][1](llm, at, "").count()
