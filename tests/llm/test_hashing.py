"""Word hashes on structured input, code books on hash collisions, and code
points newer than Python's Unicode tables."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from storecast.llm import bytebpe, bytewords as bw, charfeat, freqcode, langid, neardup, pretoken as pt, rules

WORD = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def parity_word(n: int, a: str, b: str) -> str:
    return "".join(b if bin(i).count("1") & 1 else a for i in range(n))


def swapped() -> list[str]:
    out = []
    for n in (1024, 4096):
        out += [parity_word(n, "a", "b"), parity_word(n, "b", "a")]
    return out + ["a" * 65536 + "b" * 65536, "b" * 65536 + "a" * 65536]


@pytest.fixture(scope="module")
def libraries():
    import tiktoken
    from tokenizers import Tokenizer
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return (Tokenizer.from_file(WORD), tiktoken.Encoding(
        "t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}))


def ids_by_library(tok, text):
    return tok.encode(text, add_special_tokens=False).ids


def check_ids(llm, libraries, texts):
    word, byte = libraries
    docs = llm.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in bytebpe.encode(docs, RANKS).collect():
        assert r.ids == byte.encode_ordinary(texts[r.doc_id])
    for r in freqcode.encode_to_files(docs, WORD).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == ids_by_library(word, texts[r.doc_id]) + [freqcode.END_ID]


def test_ids_of_structured_words(llm, libraries):
    check_ids(llm, libraries, swapped())


def test_ids_of_all_code_points(llm, libraries):
    rng = random.Random(5)
    texts = ["".join(chr(c) if not 0xD800 <= (c := rng.randrange(0x110000)) < 0xE000 else "x"
                     for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    texts += ["".join(chr(rng.choice([97, 65, 32, 46, 49, rng.randrange(0x10D40, 0x10D90)])) for _ in range(40))
              for _ in range(100)]
    check_ids(llm, libraries, texts)


def test_structured_lines_and_sets():
    words = swapped()
    for a, b in zip(words[::2], words[1::2]):
        data, offsets = bw.buffers(__import__("pyarrow").array([a + "\n" + b, a, b]))
        made = dict(zip(rules.MEASURES, rules.measure_block(data, offsets)))
        assert made["n_dup_lines"].tolist() == [0, 0, 0]
        members = list(neardup._sets(data, offsets, 5))
        assert neardup._digest(members[1]) != neardup._digest(members[2])
        letters = charfeat.LetterWords(data, offsets)
        assert len(letters.hash) == 2


def test_code_book_tells_words_of_one_hash_apart(monkeypatch):
    book = pt.CodeBook(lambda ws: pt.joined([np.frombuffer(w, np.uint8).astype(np.int32) for w in ws], np.int32))
    rng = np.random.default_rng(1)
    for _ in range(20):
        words = [bytes(rng.integers(97, 100, rng.integers(1, 4)).astype(np.uint8)) for _ in range(50)]
        data = np.frombuffer(b"".join(words), np.uint8)
        size = np.array([len(w) for w in words])
        end = np.cumsum(size)
        weak = np.array([len(w) for w in words], np.uint64)
        at, n = book.codes(weak, data, end - size, end)
        assert [bytes(book.flat[a:a + k].astype(np.uint8)) for a, k in zip(at, n)] == words


def test_equal_digest_halves_stay_apart(llm, monkeypatch):
    """Sets whose ids collide are different classes, by the other half."""
    import struct
    monkeypatch.setattr(neardup, "_digest", lambda m: (None, None) if not len(m) else (
        7, struct.unpack("<q", hashlib.blake2b(m.tobytes(), digest_size=8).digest())[0]))
    same = "one two three four five six seven eight nine ten"
    docs = llm.createDataFrame([(1, same), (2, same), (3, "alpha beta gamma delta epsilon zeta"), (4, None)],
                               "doc_id long, text string")
    signed = neardup.sign(docs, 2, 2).toPandas()
    assert set(signed.set_id.dropna()) == {7}
    got = {r.doc_id: (r.class_id, r.class_size) for r in neardup.jaccard_join(docs).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 1), 4: (4, 1)}


def test_clashing_columns_and_null_ids(llm):
    docs = llm.createDataFrame(
        [(i, f"some words of the text number {i} and more of them here", "en" if i % 2 else "de", f"s{i % 3}", i, 1.5, 2)
         for i in range(12)] + [(None, "a row without id", None, None, None, None, None)],
        "doc_id long, text string, lang string, source string, _id long, position double, _label int")
    model = langid.train(docs, ~langid.held_out())
    assert langid.identify(docs, model).count() == 13
    assert docs.select(langid.held_out().alias("h")).where("h is null").count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(llm, docs, "").columns == docs.columns


def test_order_of_equal_ids_is_fixed(llm):
    docs = llm.createDataFrame([(1, f"text {i}") for i in range(40)] + [(None, "x"), (None, "y")],
                               "doc_id long, text string")
    runs = [sorted((r.doc_id or -1, r.start, bytes(r.ids)) for r in
                   freqcode.encode_to_files(docs.repartition(k), WORD).collect()) for k in (1, 7)]
    assert runs[0] == runs[1]
