"""Chat formatting with typed content parts.

A turn's content is a list of typed parts: text, image, audio, or a document
that may hold parts of its own.  A visitor walks the parts in order and flattens
them: text is escaped and written out, every attachment becomes one placeholder
numbered in order, and its reference, place and expanded token count are
recorded.  The template marks the turns::

    <s><|turn|>user<|text|>[INST] ... [/INST]</s><|turn|>assistant<|text|>...</s>

Inside texts and roles a backslash is doubled and every control string gets a
backslash after its first character, so the output can be cut at its control
strings and each text restored exactly.  Assistant bodies are under the loss
mask, given as code point spans of the output.

Rows of a conversation are ordered by turn, then role and text; a null turn
comes first, a null role or text is empty, repeated rows are repeated turns.  A
null conv_id is a conversation of its own.  Content that is not a list of parts is
refused.  Columns of other names are ignored, whatever they are called; an empty
table gives an empty one.

``format_turns`` keeps every turn a row: rows are range-partitioned by their order
within and between conversations, so one conversation (or all rows without a
conv_id) spreads over many tasks, and places in the conversation come from running
totals of the partitions.  A turn must fit in a row, a conversation need not.  Rows
of equal conv_id, turn, role and first 64 characters stay in one task.
``conversation_digests`` reads turns back from the output alone and hashes each
conversation in order with constant memory; SHA-256 of a conversation is one chain,
so that step alone passes a conversation through one task.  ``format_chats`` gives
a conversation as one value, for conversations that fit in a row.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from storecast.llm.common import saved

START, TURN, TEXT, END = "<s>", "<|turn|>", "<|text|>", "</s>"
ASK, ASKED = "[INST] ", " [/INST]"
KINDS = ("image", "audio", "document")
CONTROL = [START, TURN, TEXT, END, "[INST]", "[/INST]", "<|/document|>", *[f"<|{k}|>" for k in KINDS]]
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROL))
_ESCAPED = re.compile(r"\\(\\)?")
LOSS_ROLE = "assistant"
ASK_ROLE = "user"

# Tokens an attachment expands to.
IMAGE_PATCH = 28          # pixels along a patch side; one token a patch
AUDIO_TOKENS = 25         # per second
DOCUMENT_TOKENS = 600     # per page, for documents given by reference only

CHAT = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("formatted", T.StringType()),
    T.StructField("loss_spans", T.ArrayType(T.StructType([
        T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    T.StructField("attachments", T.ArrayType(T.StructType([
        T.StructField("number", T.IntegerType()), T.StructField("turn", T.IntegerType()),
        T.StructField("kind", T.StringType()), T.StructField("ref", T.StringType()),
        T.StructField("start", T.IntegerType()), T.StructField("tokens", T.LongType())]))),
    T.StructField("attachment_tokens", T.LongType())])
BACK = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("formatted_chars", T.LongType()),
    T.StructField("turns", T.ArrayType(T.StructType([
        T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))),
    T.StructField("loss_texts", T.ArrayType(T.StringType())), T.StructField("attachment_tokens", T.LongType())])


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1] or "", text)


class PartVisitor:
    """Flattens the parts of one conversation in order."""

    def __init__(self):
        self.out: list[str] = []
        self.at = 0
        self.attachments: list[dict] = []
        self.turn = 0

    def put(self, s: str) -> None:
        self.out.append(s)
        self.at += len(s)

    def visit(self, part: dict) -> None:
        method = getattr(self, f"visit_{part.get('type')}", None)
        if method is None:
            raise ValueError(f"unknown content part: {part.get('type')!r}")
        method(part)

    def visit_text(self, part: dict) -> None:
        self.put(escape(part.get("text") or ""))

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"number": len(self.attachments), "turn": self.turn, "kind": kind,
                                 "ref": part.get("ref"), "start": self.at, "tokens": int(tokens)})
        self.put(f"<|{kind}|>")

    def visit_image(self, part: dict) -> None:
        across, down = (-(-int(part.get(k) or 0) // IMAGE_PATCH) for k in ("width", "height"))
        self.attach("image", part, max(1, across * down))

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, max(1, -(-int(1000 * float(part.get("seconds") or 0)) * AUDIO_TOKENS // 1000)))

    def visit_document(self, part: dict) -> None:
        inner = part.get("parts")
        self.attach("document", part, 0 if inner else max(1, int(part.get("pages") or 1)) * DOCUMENT_TOKENS)
        for p in inner or []:
            self.visit(p)
        self.put("<|/document|>")


def format_one(turns: list[dict]) -> tuple[str, list[dict], list[dict]]:
    """(formatted, loss spans, attachments) of ordered turns, each with role and
    text, or content (a JSON list of parts)."""
    v, spans = PartVisitor(), []
    v.put(START)
    for i, t in enumerate(turns):
        role = t.get("role") or ""
        v.turn = i
        v.put(TURN + escape(role) + TEXT)
        if role == ASK_ROLE:
            v.put(ASK)
        begin = v.at
        content = t.get("content")
        for part in [{"type": "text", "text": t.get("text")}] if content is None else json.loads(content):
            v.visit(part)
        if role == LOSS_ROLE:
            spans.append({"start": begin, "end": v.at})
        if role == ASK_ROLE:
            v.put(ASKED)
        v.put(END)
    return "".join(v.out), spans, v.attachments


def read_one(formatted: str, spans: list[dict]) -> tuple[list[dict], list[str]]:
    """(turns, texts under the loss mask), from the output alone.  Attachment
    placeholders read back as they stand."""
    turns = []
    for piece in formatted[len(START):].split(TURN)[1:]:
        role, body = piece.split(TEXT, 1)
        body = body[:-len(END)]
        if role == ASK_ROLE:
            body = body[len(ASK):-len(ASKED)]
        turns.append({"role": unescape(role), "text": unescape(body)})
    return turns, [unescape(formatted[s["start"]:s["end"]]) for s in spans]


def _formatter(batches):
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            formatted, spans, attachments = format_one(row["turns"])
            rows.append({"conv_id": row["conv_id"], "formatted": formatted, "loss_spans": spans,
                         "attachments": attachments, "attachment_tokens": sum(a["tokens"] for a in attachments)})
        yield pa.RecordBatch.from_pylist(rows, schema=_CHAT_ARROW)


def _back(batches):
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            turns, loss = read_one(row["formatted"], row["loss_spans"])
            rows.append({"conv_id": row["conv_id"], "formatted_chars": len(row["formatted"]), "turns": turns,
                         "loss_texts": loss, "attachment_tokens": row["attachment_tokens"]})
        yield pa.RecordBatch.from_pylist(rows, schema=_BACK_ARROW)


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_ATTACHED = pa.struct([("number", pa.int32()), ("turn", pa.int32()), ("kind", pa.string()), ("ref", pa.string()),
                       ("start", pa.int32()), ("tokens", pa.int64())])
_CHAT_ARROW = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(_SPAN)),
                         ("attachments", pa.list_(_ATTACHED)), ("attachment_tokens", pa.int64())])
_BACK_ARROW = pa.schema([("conv_id", pa.int64()), ("formatted_chars", pa.int64()),
                         ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))),
                         ("loss_texts", pa.list_(pa.string())), ("attachment_tokens", pa.int64())])


def format_chats(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, and optionally content) -> one row
    per conversation: formatted, loss_spans, attachments, attachment_tokens."""
    fields = ["turn", "role", "text"] + (["content"] if "content" in rows.columns else [])
    turns = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(
        F.sort_array(F.collect_list(F.struct(*fields))).alias("turns"))
    return turns.mapInArrow(_formatter, CHAT)


def read_chats(formatted: DataFrame) -> DataFrame:
    """Turns and texts under the loss mask, read back from the output; the
    attachments' tokens as they were recorded."""
    return formatted.select("conv_id", "formatted", "loss_spans", "attachment_tokens").mapInArrow(_back, BACK)


# -- by turns ---------------------------------------------------------------------------

SORT_CHARS = 64           # characters of a text that the range partitioning compares
_PLACE = re.compile("|".join(re.escape(f"<|{k}|>") for k in (*KINDS, "/document")))

PLACED = T.ArrayType(T.StructType([
    T.StructField("number", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("ref", T.StringType()),
    T.StructField("start", T.LongType()), T.StructField("tokens", T.LongType())]))
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
TURNS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("number", T.LongType()),
    T.StructField("piece", T.StringType()), T.StructField("start", T.LongType()), T.StructField("loss_spans", SPANS),
    T.StructField("attachments", PLACED), T.StructField("attachment_tokens", T.LongType())])
READ_TURNS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("number", T.LongType()), T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("loss_text", T.StringType())])
DIGESTS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()),
    T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
    T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()),
    T.StructField("n_attachments", T.LongType()), T.StructField("attachment_tokens", T.LongType())])

_LONG_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_TURNS_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("number", pa.int64()), ("piece", pa.string()), ("start", pa.int64()),
    ("loss_spans", _LONG_SPANS),
    ("attachments", pa.list_(pa.struct([("number", pa.int64()), ("kind", pa.string()), ("ref", pa.string()),
                                        ("start", pa.int64()), ("tokens", pa.int64())]))),
    ("attachment_tokens", pa.int64())])
_READ_ARROW = pa.schema([("conv_id", pa.int64()), ("number", pa.int64()), ("role", pa.string()), ("text", pa.string()),
                         ("loss_text", pa.string())])
_DIGESTS_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                            ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
                            ("n_attachments", pa.int64()), ("attachment_tokens", pa.int64())])


class TurnVisitor(PartVisitor):
    """Flattens one turn.  Only text parts of a loss role are under the mask; a
    text part without a text of its own stands for the row's text."""

    def __init__(self, role: str, text: str):
        super().__init__()
        self.text, self.masked, self.spans = text, role == LOSS_ROLE, []

    def visit_text(self, part: dict) -> None:
        begin = self.at
        self.put(escape(part.get("text", self.text) or ""))
        if self.masked and self.at > begin:
            self.spans.append((begin, self.at))


def format_turn(role: str, text: str, content: str | None) -> TurnVisitor:
    v = TurnVisitor(role, text)
    v.put(TURN + escape(role) + TEXT + (ASK if role == ASK_ROLE else ""))
    for part in [{"type": "text"}] if content is None else json.loads(content):
        v.visit(part)
    v.put((ASKED if role == ASK_ROLE else "") + END)
    return v


def read_turn(piece: str) -> tuple[str, str]:
    """(role, text) of a formatted turn; placeholders are left out of the text."""
    role, body = piece[len(TURN):-len(END)].split(TEXT, 1)
    if role == ASK_ROLE:
        body = body[len(ASK):-len(ASKED)]
    return unescape(role), "".join(unescape(t) for t in _PLACE.split(body))


def read_loss(piece: str, start: int, spans: list[dict]) -> str:
    """The text under the loss mask of a formatted turn that begins at ``start``."""
    return "".join(unescape(piece[s["start"] - start:s["end"] - start]) for s in spans)


def _turner(batches):
    """Sorted rows to formatted turns; numbers and places count from the first
    row of the conversation in this partition."""
    part, conv, at = TaskContext.get().partitionId(), object(), [0, 0, 0]
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            if row["conv_id"] != conv:
                conv, at = row["conv_id"], [0, 0, 0]
            number, start, placed = at
            v = format_turn(row["role"], row["text"], row.get("content"))
            rows.append({
                "conv_id": conv, "part": part, "number": number, "piece": "".join(v.out), "start": start,
                "loss_spans": [{"start": start + a, "end": start + b} for a, b in v.spans],
                "attachments": [{"number": placed + a["number"], "kind": a["kind"], "ref": a["ref"],
                                 "start": start + a["start"], "tokens": a["tokens"]} for a in v.attachments],
                "attachment_tokens": sum(a["tokens"] for a in v.attachments)})
            at = [number + 1, start + v.at, placed + len(v.attachments)]
        yield pa.RecordBatch.from_pylist(rows, schema=_TURNS_ARROW)


def _turn_reader(batches):
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            role, text = read_turn(row["piece"])
            loss = read_loss(row["piece"], row["start"], row["loss_spans"]) if row["loss_spans"] else None
            rows.append({"conv_id": row["conv_id"], "number": row["number"], "role": role, "text": text, "loss_text": loss})
        yield pa.RecordBatch.from_pylist(rows, schema=_READ_ARROW)


class _Digest:
    """Running digests of one conversation."""

    def __init__(self, conv_id):
        self.row = {"conv_id": conv_id, "n_turns": 0, "loss_chars": 0, "formatted_chars": len(START),
                    "n_attachments": 0, "attachment_tokens": 0}
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, row: dict) -> None:
        role, text = read_turn(row["piece"])
        loss = read_loss(row["piece"], row["start"], row["loss_spans"])
        self.turns.update(f"{role}\n{text}\n".encode())
        self.loss.update(loss.encode())
        for name, n in (("n_turns", 1), ("loss_chars", len(loss)), ("formatted_chars", len(row["piece"])),
                        ("n_attachments", row["n_attachments"]), ("attachment_tokens", row["attachment_tokens"])):
            self.row[name] += n

    def done(self) -> dict:
        return {**self.row, "turns_sha256": self.turns.hexdigest(), "loss_sha256": self.loss.hexdigest()}


def _digester(batches):
    now, known = None, False
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            if not known or row["conv_id"] != now.row["conv_id"]:
                if known:
                    rows.append(now.done())
                now, known = _Digest(row["conv_id"]), True
            now.add(row)
        yield pa.RecordBatch.from_pylist(rows, schema=_DIGESTS_ARROW)
    if known:
        yield pa.RecordBatch.from_pylist([now.done()], schema=_DIGESTS_ARROW)


def _moved(spans: str, by: dict[str, Column], schema: T.ArrayType) -> Column:
    """An array of structs with ``by`` added to its fields of those names."""
    return F.transform(spans, lambda s: F.struct(*[
        (s[f.name] + by[f.name] if f.name in by else s[f.name]).alias(f.name) for f in schema.elementType.fields]))


def format_turns(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, and optionally content) -> one row per
    turn: conv_id, number (from 0), piece (the formatted turn), start (its place in
    the conversation), loss_spans, attachments and attachment_tokens.  A formatted
    conversation is ``START`` and its pieces in order; all places count from there."""
    with_content = "content" in rows.columns
    rows = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"), *(["content"] if with_content else []))
    ordered = (rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, SORT_CHARS))
               .sortWithinPartitions("conv_id", "turn", "role", "text", *(["content"] if with_content else [])))
    made = saved(ordered.drop("turn").mapInArrow(_turner, TURNS), "chat-turns")

    # What a conversation holds in earlier partitions.  Only the first conversation of
    # a partition can have begun in another, so at most one row per partition is left.
    totals = made.groupBy("conv_id", "part").agg(
        F.count("*").alias("n"), F.sum(F.length("piece")).alias("chars"), F.sum(F.size("attachments")).alias("placed"))
    before = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(F.col("conv_id").alias("__conv"), F.col("part").alias("__part"),
                            *[F.sum(c).over(before).alias(f"__{c}") for c in ("n", "chars", "placed")]).where("__n > 0")
    out = made.join(F.broadcast(carried), F.col("conv_id").eqNullSafe(F.col("__conv"))
                    & (F.col("part") == F.col("__part")), "left")
    chars = F.coalesce("__chars", F.lit(0)) + len(START)
    return out.select(
        "conv_id", (F.col("number") + F.coalesce("__n", F.lit(0))).alias("number"), "piece",
        (F.col("start") + chars).alias("start"),
        _moved("loss_spans", {"start": chars, "end": chars}, SPANS).alias("loss_spans"),
        _moved("attachments", {"number": F.coalesce("__placed", F.lit(0)), "start": chars}, PLACED).alias("attachments"),
        "attachment_tokens")


def read_turns(made: DataFrame) -> DataFrame:
    """Role, text and the text under the loss mask (null if none) of every turn,
    read back from the output of ``format_turns``."""
    return made.select("conv_id", "number", "piece", "start", "loss_spans").mapInArrow(_turn_reader, READ_TURNS)


def conversation_digests(made: DataFrame) -> DataFrame:
    """One row per conversation, read back from the output of ``format_turns``:
    n_turns, turns_sha256 (role, line feed, text, line feed of every turn),
    loss_chars, loss_sha256, formatted_chars, n_attachments, attachment_tokens."""
    return (made.select("conv_id", "number", "piece", "start", "loss_spans", "attachment_tokens",
                        F.size("attachments").alias("n_attachments"))
            .repartition("conv_id").sortWithinPartitions("conv_id", "number").mapInArrow(_digester, DIGESTS))
