"""The streaming transducer against the tokenizers library and against whole-word merging."""

import json
import random

import numpy as np
import public_tokenizers
import pytest

from storecast.llm import transducer as td
from storecast.llm.queries import WORD_TOKENIZER


@pytest.fixture(scope="module")
def coder():
    return td.coder(open(WORD_TOKENIZER, encoding="utf-8").read())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(WORD_TOKENIZER)


def texts():
    rng = random.Random(11)
    out = [None, "", " \n", "The quick brown fox's they'RE 'LL 12345 naïve ΣΑΣ İstanbul K Å <|endoftext|>x<|startoftext|>",
           "á̧ é", "z" * 3000, "ab" * 5000, "é" * 700, "word " * 3000, "日本語テキスト" * 300,
           "".join(rng.choice("etaoinshr") for _ in range(20_000))]
    for _ in range(300):
        kind = rng.randrange(3)
        pool = [chr(c) for c in (range(32, 127) if kind == 0 else range(0x20, 0x500) if kind == 1 else
                                 [rng.randrange(0x110000) for _ in range(60)]) if not 0xD800 <= c < 0xE000]
        out.append("".join(rng.choice(pool) for _ in range(rng.randrange(1, 200))))
    return out


def test_equals_the_library(llm, library):
    rows = texts()
    docs = llm.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in td.encode_decode(docs, WORD_TOKENIZER).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(rows):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert list(got[i].ids) == ids, (i, t)
        assert got[i].decoded == library.decode(ids, skip_special_tokens=False), (i, t)


def test_windows_equal_whole_words(coder):
    """Small windows (bounded by the lookahead) against one window for the whole word."""
    encoder, _ = coder
    t, m = encoder.transducer, encoder.m
    rng = random.Random(2)
    for k in range(60):
        n = rng.randrange(1, 4 * m.window)
        alphabet = rng.choice(["ab", "etaoin shrdlu".replace(" ", ""), "in", "xyz123", "aeiou"])
        word = "".join(rng.choice(alphabet) for _ in range(n)).encode()
        whole = t._fold_one(np.frombuffer(word, np.uint8), True).tolist()
        stream, got = td.Stream(t), []
        at = 0
        while at < n:
            step = rng.randrange(1, 700)
            got += stream.feed(word[at:at + step]).tolist()
            assert len(stream.held) <= m.window
            at += step
        got += stream.finish().tolist()
        assert got == whole
        flat, size = t.encode([word, b"in", word])
        assert flat.tolist() == whole + t.encode([b"in"])[0].tolist() + whole


def test_lookahead_is_sufficient_and_refuses_improper_lists():
    """Over small random proper lists: a token's end never depends on symbols beyond the lookahead."""
    rng = random.Random(4)
    for _ in range(40):
        symbols, merges, made = list("abc"), [], set("abc")
        for _ in range(8):
            u, v = rng.choice(symbols), rng.choice(symbols)
            if u + v not in made and len(u + v) <= 6:
                merges.append((u, v))
                symbols.append(u + v)
                made.add(u + v)
        k = td.sufficient_lookahead(merges, len)

        def encode(word):
            parts = list(word)
            for u, v in merges:
                i = 0
                while i < len(parts) - 1:
                    if parts[i] == u and parts[i + 1] == v:
                        parts[i:i + 2] = [u + v]
                    i += 1
            return parts
        for _ in range(60):
            word = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 25)))
            cut = rng.randrange(len(word) + 1)
            other = word[:cut] + "".join(rng.choice("abc") for _ in range(rng.randrange(0, 20)))
            one, two = encode(word), encode(other)
            end = 0
            for a in one:
                end += len(a)
                if end + k > cut:
                    break
                assert two and two.pop(0) == a
    with pytest.raises(ValueError):
        td.sufficient_lookahead([("ab", "c"), ("a", "b")], len)


def test_pieces_of_a_long_document(coder, library, monkeypatch):
    monkeypatch.setattr(td, "PIECE_BYTES", 500)
    encoder, decoder = coder
    from storecast.llm import bytewords as bw
    import pyarrow as pa
    for t in ["It's a lóng text 123 with words " * 200, "x" * 5000 + " end", "<|endoftext|> é " * 300]:
        (ids, size), = encoder.documents(*bw.buffers(pa.array([t])))
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids
        assert decoder.text(ids, 7) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_decoder_holds_back_unfinished_code_points(coder):
    encoder, _ = coder
    plain = td.Decoder(encoder.m, plain=True)
    raw = "naïve 漢 😀".encode()
    inner = encoder.m.inner
    parts = [plain.feed(inner[[b]]) for b in raw]
    assert "".join(parts) + plain.finish() == "naïve 漢 😀"
    assert "" in parts
    plain.begin()
    assert plain.feed(inner[[0xF0, 0x9F]]) + plain.finish() == "�"
    text = "one two's 3"
    (ids, _), = encoder.documents(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    assert plain.text(ids) == "one two 's 3 "


def test_odd_rows_and_empty_table(odd, empty, library):
    got = td.encode_decode(odd, WORD_TOKENIZER).collect()
    assert len(got) == odd.count()
    want = sorted(str((r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect())
    assert sorted(str((r.doc_id, list(r.ids))) for r in got) == want
    assert td.encode_decode(empty, WORD_TOKENIZER).count() == 0
