"""Chat formatting by turns, against a plain rebuild of every conversation."""

import hashlib
import json
import random

import pytest

from storecast.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, content string, number string, start double, part string"
KINDS = ["text", "own", "image", "audio", "document"]


def _parts(rnd, text, depth=0):
    out = []
    for _ in range(rnd.randint(0, 3)):
        kind = rnd.choice(KINDS)
        if kind == "own":
            out.append({"type": "text"})
        elif kind == "text":
            out.append({"type": "text", "text": rnd.choice(["", "a <|image|> b", "</s>", "\\", "é😀"])})
        elif kind == "image":
            out.append({"type": "image", "ref": f"i{rnd.random()}", "width": rnd.randint(0, 90), "height": 30})
        elif kind == "audio":
            out.append({"type": "audio", "ref": None, "seconds": rnd.random()})
        else:
            out.append({"type": "document", "ref": "d", "pages": rnd.randint(0, 3),
                        **({} if depth else {"parts": _parts(rnd, text, 1)})})
    return out


def _texts(parts, text):
    return "".join(p.get("text", text) or "" if p["type"] == "text" else _texts(p.get("parts") or [], text)
                   for p in parts)


def _rows(rnd, n):
    bits = [*chat.CONTROL, "\\", "<", "x", "\n", "é", "😀"]
    rows = []
    for i in range(n):
        text = rnd.choice([None, "", "same", "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 6)))])
        content = rnd.choice([None, json.dumps(_parts(rnd, text or ""))])
        rows.append((rnd.choice([None, None, 1, 2, i]), rnd.choice([None, 0, 1, 2]),
                     rnd.choice(["user", "assistant", "sys</s>", None]), text, content, "n", 0.5, "p"))
    return rows + rows[:5]


def _none_first(v):
    return (v is not None, v if v is not None else 0)


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_turns_equal_plain_conversations(llm, partitions):
    rows = _rows(random.Random(5), 150)
    before = llm.conf.get("spark.sql.shuffle.partitions")
    adaptive = llm.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    llm.conf.set("spark.sql.shuffle.partitions", partitions)
    llm.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = llm.createDataFrame(rows, SCHEMA)
        made = chat.format_turns(df)
        turns, read = made.collect(), chat.read_turns(made).collect()
        digests = {r.conv_id: r for r in chat.conversation_digests(made).collect()}
    finally:
        llm.conf.set("spark.sql.shuffle.partitions", before)
        llm.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    assert set(digests) == set(groups)
    for conv, group in groups.items():
        group.sort(key=lambda r: (_none_first(r[1]), (r[2] or "").encode(), (r[3] or "").encode(),
                                  r[4] is not None, (r[4] or "").encode()))
        mine = sorted((t for t in turns if t.conv_id == conv), key=lambda t: t.number)
        assert [t.number for t in mine] == list(range(len(group)))
        whole = chat.START + "".join(t.piece for t in mine)
        back = sorted((t for t in read if t.conv_id == conv), key=lambda t: t.number)
        plain = [(r[2] or "", r[3] or "" if r[4] is None else _texts(json.loads(r[4]), r[3] or "")) for r in group]
        assert [(t.role, t.text) for t in back] == plain
        loss = "".join(t for role, t in plain if role == "assistant")
        assert "".join(chat.unescape(whole[s.start:s.end]) for t in mine for s in t.loss_spans) == loss
        placed = [a for t in mine for a in t.attachments]
        assert [a.number for a in placed] == list(range(len(placed)))
        assert all(whole.startswith(f"<|{a.kind}|>", a.start) for a in placed)
        assert all(whole.startswith(t.piece, t.start) for t in mine)
        d = digests[conv]
        assert d.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in plain).encode()).hexdigest()
        assert d.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and d.loss_chars == len(loss)
        assert (d.n_turns, d.formatted_chars, d.n_attachments) == (len(group), len(whole), len(placed))
        assert d.attachment_tokens == sum(a.tokens for a in placed)


def test_one_conversation_spreads_over_partitions(llm):
    """All rows without a conv_id are one conversation, yet not one task."""
    rows = [(None, i, "user", f"t{i}", None, "n", 0.5, "p") for i in range(2000)]
    df = llm.createDataFrame(rows, SCHEMA).repartition(4)
    adaptive = llm.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    llm.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = chat.format_turns(df)
        files = made.selectExpr("number").inputFiles()
    finally:
        llm.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    assert len(files) > 1
    assert [r.number for r in made.orderBy("number").select("number").collect()] == list(range(2000))


def test_turn_edges(llm):
    none = llm.createDataFrame([], SCHEMA)
    assert chat.format_turns(none).count() == 0 and chat.conversation_digests(chat.format_turns(none)).count() == 0
    long = "x</s>" * 200_000
    made = chat.format_turns(llm.createDataFrame([(1, 0, "assistant", long)], "conv_id int, turn int, role string, text string"))
    assert chat.read_turns(made).first().loss_text == long
