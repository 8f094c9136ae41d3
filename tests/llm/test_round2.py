"""Text operators: cases from the review of round 2."""

import random

import numpy as np
from pyspark.sql import functions as F

from storecast.llm import chat, neardup
from storecast.llm.queries import QUERIES

from ..conftest import SF_SMALL


def test_jaccard_join_null_ids(llm):
    rnd = random.Random(3)

    def text():
        return [f"w{rnd.randint(0, 9999)}" for _ in range(120)]

    def near(words):
        return [*words[:60], "changed", *words[61:]]

    a, b, c = text(), text(), text()
    rows = [(None, a), (5, a), (6, a), (9, near(a)), (None, b), (None, b), (12, near(b)), (None, c), (None, near(c))]
    docs = llm.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    for cell in (256, 1):
        got = [(r.doc_id, r.class_id, r.class_size, r.n_links, r.group_id, r.kept)
               for r in neardup.jaccard_join(docs, cell=cell).collect()]
        of_c = [r for r in got if r[0] is None and r[4] is None]
        assert sorted(r for r in got if r not in of_c and r[0] is not None) == [
            (5, 5, 3, 1, 5, True), (6, 5, 3, 1, 5, False), (9, 9, 1, 1, 5, False), (12, 12, 1, 1, 12, True)]
        assert sorted((r for r in got if r[0] is None and r not in of_c), key=str) == [
            (None, 5, 3, 1, 5, False), (None, None, 2, 1, 12, False), (None, None, 2, 1, 12, False)]
        assert len(of_c) == 2 and all(r[1:5] == (None, 1, 1, None) for r in of_c)
        assert sorted(r[5] for r in of_c) == [False, True]


def test_recall_counts_the_signature_filter():
    bands, rows = neardup.choose_bands(0.8, 0.999)
    joint = neardup.joint_recall(0.8, bands, rows)
    assert 0.999 <= joint <= 1 - (1 - 0.8 ** rows) ** bands
    rng = np.random.default_rng(11)
    equal = rng.random((200_000, bands, rows)) < 0.8
    found = equal.all(axis=2).any(axis=1) & neardup._passes(0.8, bands * rows)[equal.sum(axis=(1, 2))]
    assert abs(found.mean() - joint) < 4e-4
    assert neardup.choose_bands(1.0)[0] == 1


def test_chat_query_shows_recorded_attachment_tokens(llm, monkeypatch):
    content = '[{"type":"image","ref":"a.png","width":56,"height":30}]'
    rows = llm.createDataFrame([(1, 0, "user", None, content)],
                               "conv_id long, turn long, role string, text string, content string")
    assert chat.read_chats(chat.format_chats(rows)).first().attachment_tokens == 4
    made = chat.format_turns
    monkeypatch.setattr(chat, "format_turns", lambda r: made(r).withColumn("attachment_tokens", F.lit(7).cast("long")))
    got = QUERIES["op6_chat_format"](llm, SF_SMALL).select("n_turns", "attachment_tokens").collect()
    assert got and all(r.attachment_tokens == 7 * r.n_turns for r in got)
