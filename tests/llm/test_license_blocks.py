"""The license join against brute force over every window."""

import random

from storecast.llm import licenses


def brute(words, threshold=licenses.THRESHOLD, block=licenses.BLOCK):
    labels, share = set(), 0.0
    for text, label in licenses.TEMPLATES:
        t = set(text.split())
        for at in range(max(1, len(words) - block + 1)):
            both = len(t & set(words[at:at + block]))
            if both >= licenses.needed(len(t), threshold):
                labels.add(label)
                share = max(share, both / len(t))
    return labels, share


def test_every_offset_and_gap_equals_brute_force(llm):
    rng = random.Random(3)
    texts = []
    for k in range(400):
        text, _ = licenses.TEMPLATES[k % len(licenses.TEMPLATES)]
        notice = []
        for w in text.split():
            notice += [f"gap{rng.randrange(50)}"] * (rng.random() < rng.choice([0, 0.3, 0.9, 1.0])) + [w]
        if rng.random() < 0.5:
            notice = [w for w in notice if rng.random() > 0.12]
        if rng.random() < 0.2:
            rng.shuffle(notice)
        texts.append(" ".join(["pad"] * (k % 61) + notice + ["the of in", "tail"] * rng.randrange(3)))
    texts += [None, "", "the " * 500, " ".join(t for t, _ in licenses.TEMPLATES) * 3]
    docs = llm.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.scan_licenses(docs, phrases=[]).collect():
        words = (texts[r.doc_id] or "").split()
        labels, share = brute(words)
        assert set(r.labels) == labels, (r.doc_id, texts[r.doc_id])
        assert abs(r.score - share) < 1e-12


def test_license_columns_and_empty_table(llm):
    docs = llm.createDataFrame([(1, "cc by nc", 1, "x")], "doc_id long, text string, template int, words string")
    assert licenses.scan_licenses(docs).collect()[0].base_labels == ["cc-by-nc"]
    assert licenses.scan_licenses(docs.where("doc_id > 1")).count() == 0
