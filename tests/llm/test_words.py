"""Word hashes and word-wise encoding of the tokenizer operators."""

import numpy as np
import public_tokenizers

from storecast.llm import bytewords as bw
from storecast.llm import freqcode, pretoken


def test_span_hashes_agree_between_running_sums_and_plain_sums(monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 50_000).astype(np.uint8)
    start = np.sort(rng.choice(49_000, 9_000, replace=False))
    end = np.minimum(np.append(start[1:], 49_500), start + 9)
    table = bw.table(b"", fold=True)
    by_sums = pretoken.span_hashes(data, start, end, table)
    monkeypatch.setattr(pretoken, "SUMMED_BYTES", 0)
    assert (by_sums == pretoken.span_hashes(data, start, end, table)).all()
    assert len(pretoken.span_hashes(data, start[:0], end[:0], table)) == 0


def test_words_encoded_together_equal_words_encoded_alone():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        ids = freqcode.WordIds(f.read())
    words = [w.encode() for w in ["hello", "wrld", "'s", "7", "été", "漢字", "#&$", "z" * 300, "unforeseeable"]] * 300
    for got, want in zip(ids.together(words), ids.one_by_one(words)):
        assert (got == want).all()
    # Words that the pre-tokenizer would cut: encoded one by one, sizes still right.
    cut = [b"two words", b"a1b", b"one"]
    for got, want in zip(ids.together(cut), ids.one_by_one(cut)):
        assert (got == want).all()
