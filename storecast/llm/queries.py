"""Registered queries of the text operators, and their DuckDB oracles."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from storecast.llm import (bytebpe, chat, curriculum, exactdedup, freqcode, hardneg, langid, licenses, neardup, presence, rules,
                           toxicity, transducer)
from storecast.llm.common import start

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def query(name: str, sql: str | None = None):
    def deco(fn):
        def job(spark: SparkSession, sf_dir: str) -> DataFrame:
            start(spark)
            return fn(lambda table: spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet")))
        job.__name__, job.__doc__ = name, fn.__doc__
        QUERIES[name] = job
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@query("op1_language_id")
def op1(table):
    """Language of every document by the word-level CRF."""
    docs = table("documents")
    held = langid.held_out(5, 0)
    model = langid.train(docs, ~held)
    return langid.identify(docs, model).select(
        "doc_id", held.alias("held_out"), "lang_pred", "score", "n_words", "n_switches")


@query("op2_frequency_coded_ids")
def op2(table):
    """Token ids through the frequency-coded files and back."""
    return freqcode.encode_to_files(table("documents"), WORD_TOKENIZER, freqcode.END_ID).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op3_toxicity")
def op3(table):
    """Toxicity score of every document by the naive Bayes scaled n-gram classifier."""
    docs = table("documents")
    held = langid.held_out(3, 1)
    model = toxicity.train(docs, table("labels"), ~held)
    return toxicity.score(docs, model).select(
        "doc_id", held.alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


OP4_SQL = f"""
WITH s AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('{curriculum.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS o
  FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size,
             row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS rnk FROM s GROUP BY source),
c AS (SELECT *, [5, 2, 1][(rnk % 3 + 1)::INT]::BIGINT AS w, source_size * 2 AS cap,
             (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM p),
g AS (SELECT *, (budget - coalesce(sum(cap) OVER r1, 0)::DOUBLE) / (sum(w) OVER r2)::DOUBLE AS share,
             row_number() OVER (ORDER BY cap::DOUBLE / w::DOUBLE, rnk) AS k
      FROM c WINDOW r1 AS (ORDER BY cap::DOUBLE / w::DOUBLE, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                    r2 AS (ORDER BY cap::DOUBLE / w::DOUBLE, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (SELECT share AS level FROM g WHERE share * w < cap ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, rnk, least(cap::DOUBLE, coalesce((SELECT level FROM l) * w, cap::DOUBLE)) AS target
      FROM g),
r AS (SELECT s.doc_id, s.size, t.source_size, t.target, t.rnk,
             coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.o, s.doc_id, s.size
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, (ahead + size / 2.0::DOUBLE < target)::INT AS one,
             (ahead + source_size + size / 2.0::DOUBLE < target)::INT AS two,
             [1.0, 0.5, 1.5][(rnk % 3 + 1)::INT]::DOUBLE AS a, [1.0, 1.5, 0.5][(rnk % 3 + 1)::INT]::DOUBLE AS b,
             CASE WHEN target > 0 THEN least(1.0::DOUBLE, ahead::DOUBLE / target) ELSE 0.0::DOUBLE END AS share FROM r)
SELECT doc_id, size, source_size, target, (size * (one + two))::BIGINT AS taken, (one + two)::BIGINT AS passes,
       CASE WHEN one = 1 THEN (CASE WHEN a = b THEN share
         ELSE (sqrt(a * a + 2 * (b - a) * (share * (a + b) / 2)) - a) / (b - a) END) + 0.0::DOUBLE END AS position
FROM x
"""


@query("op4_curriculum_mix", OP4_SQL)
def op4(table):
    """Every document's part in the mix, sorted by its first training position."""
    mixed = curriculum.mix(table("documents"))
    return (mixed.select("doc_id", "size", "source_size", "target", "taken", "passes",
                         F.try_element_at("positions", F.lit(1)).alias("position"))
            .orderBy("position", "doc_id"))


@query("op5_byte_bpe")
def op5(table):
    """Byte-level BPE ids and decoded bytes of every document, as digests."""
    return bytebpe.encode_decode(table("documents"), BYTE_RANKS).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def _sql_escape(col: str) -> str:
    out = f"replace({col}, '\\', '\\\\')"
    for c in chat.CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


# The attachment that a user turn of the query gets, by (conv_id + turn) mod 4, from
# its number of characters n: an image, audio, a document by reference, a document
# that holds an image and audio.  SQL counts of tokens and placeholder characters.
_KIND = "CASE WHEN role = 'user' THEN ((conv_id + turn) % 4 + 4) % 4 END"
_N = "length(text)"
_PLACES = {k: len(f"<|{k}|>") for k in (*chat.KINDS, "/document")}
_DOC_CHARS = _PLACES["document"] + _PLACES["/document"]

OP6_SQL = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
c AS (
  SELECT *,
         CASE {_KIND} WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 3 ELSE 0 END AS placed,
         CASE {_KIND} WHEN 0 THEN {_PLACES["image"]} WHEN 1 THEN {_PLACES["audio"]} WHEN 2 THEN {_DOC_CHARS}
              WHEN 3 THEN {_DOC_CHARS + _PLACES["image"] + _PLACES["audio"]} ELSE 0 END AS place_chars,
         CASE {_KIND} WHEN 0 THEN greatest(1, (({_N} + 27) // 28) * (1 + turn))
              WHEN 1 THEN greatest(1, (((125 * {_N}) // 2) * 25 + 999) // 1000)
              WHEN 2 THEN 600 * (1 + {_N} // 1000)
              WHEN 3 THEN greatest(1, (({_N} + 27) // 28) * 2) + 25 * (1 + turn) ELSE 0 END AS tokens
  FROM r)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       ({len(chat.START)} + sum({len(chat.TURN + chat.TEXT + chat.END)} + length({_sql_escape('role')})
         + length({_sql_escape('text')}) + place_chars
         + CASE WHEN role = 'user' THEN {len(chat.ASK + chat.ASKED)} ELSE 0 END))::BIGINT AS formatted_chars,
       sum(placed)::BIGINT AS n_attachments, sum(tokens)::BIGINT AS attachment_tokens
FROM c GROUP BY conv_id
"""


def typed_parts(rows: DataFrame) -> DataFrame:
    """``rows`` with a content: the row's text, and after it, for user turns, an
    attachment of each kind in turn with sizes taken from the row."""
    n, turn = F.length(F.coalesce("text", F.lit(""))), F.col("turn")
    ref = F.concat_ws("/", F.lit("conv"), "conv_id", "turn")

    def part(kind: str, **sizes) -> Column:
        return F.to_json(F.struct(F.lit(kind).alias("type"), ref.alias("ref"), *[v.alias(k) for k, v in sizes.items()]))

    def listed(*parts) -> Column:
        return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))

    inner = listed(part("image", width=n, height=F.lit(56)), part("audio", seconds=1 + turn))
    attachments = [
        part("image", width=n, height=28 * (1 + turn)),
        part("audio", seconds=n / 16),
        part("document", pages=1 + F.floor(n / 1000)),
        F.concat(F.regexp_replace(part("document"), "}$", ""), F.lit(',"parts":'), inner, F.lit("}")),
    ]
    kind = F.pmod(F.col("conv_id") + turn, F.lit(len(attachments)))
    own = F.lit('{"type":"text"}')                   # the row's text, not copied
    content = F.when((F.col("role") == "user") & kind.isNotNull(), F.coalesce(
        *[F.when(kind == k, listed(own, a)) for k, a in enumerate(attachments)]))
    return rows.withColumn("content", content)


@query("op6_chat_format", OP6_SQL)
def op6(table):
    """Conversations with typed parts formatted by turns and read back from the
    output, as digests."""
    rows = table("conversations").select("conv_id", "turn", "role", "text")
    spark = rows.sparkSession
    probe = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame(
        [(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string"))
    return chat.conversation_digests(chat.format_turns(typed_parts(rows)))


OP7_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS raw,
                  regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents),
k AS (SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
             row_number() OVER (PARTITION BY t ORDER BY doc_id, raw) AS n FROM d)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, n = 1 AS kept, sha256(t) AS text_sha256 FROM k
"""


@query("op7_exact_dedup", OP7_SQL)
def op7(table):
    """Exact duplicate groups by counting quotient filters and byte verification."""
    return exactdedup.exact_dedup(table("documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


_W = "[^\\x20\\x09-\\x0D]+"
_LEDGER_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i
      FROM (SELECT r, regexp_extract_all(t, '{_W}') AS ws FROM d)),
g AS (SELECT r, i, word, {', '.join(f"lead(word, {k}) OVER (PARTITION BY r ORDER BY i) AS w{k}" for k in range(1, 8))}
      FROM w),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, word, {', '.join(f'w{k}' for k in range(1, 8))}) AS c
      FROM g WHERE w7 IS NOT NULL),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM h, (SELECT unnest(range(8)) AS j) WHERE c > 1 GROUP BY r),
l AS (SELECT r, line FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '{_W}')),
ln AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM l GROUP BY r),
ww AS (SELECT r, count(*) AS n, sum(length(word)) AS chars FROM w GROUP BY r),
m AS (SELECT doc_id, coalesce(ww.n, 0)::BIGINT AS n_words, coalesce(ww.chars, 0)::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
             coalesce(n_lines, 0)::BIGINT AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_upper
      FROM d LEFT JOIN ww USING (r) LEFT JOIN rep USING (r) LEFT JOIN ln USING (r)),
b AS (SELECT *, ({' + '.join(f"CASE WHEN {cond} THEN {1 << i} ELSE 0 END" for i, cond in enumerate(rules.RULES.values()))})::BIGINT
             AS fail_bits FROM m)
"""
OP8_SQL = f"""{_LEDGER_SQL}SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits,
       (fail_bits & {rules.mask_of(rules.BASE)}) <> 0 AS base_failed,
       (fail_bits & {rules.mask_of(rules.POLICIES[rules.CURRENT])}) = 0 AS kept
FROM b
"""


@query("op8_rule_ledger", OP8_SQL)
def op8(table):
    """The rule ledger of every document with the current policy applied."""
    return rules.apply_policy(rules.build_ledger(table("documents"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "fail_bits",
        "base_failed", "kept")


_RULE_SQL = " UNION ALL ".join(
    f"SELECT '{r}' AS rule, {rules.mask_of([r])} AS bit" for r in rules.POLICIES[rules.CURRENT])
ABLATION_SQL = f"""{_LEDGER_SQL.rstrip()},
p AS (SELECT fail_bits & {rules.mask_of(rules.POLICIES[rules.CURRENT])} AS bits FROM b), r AS ({_RULE_SQL})
SELECT rule, count(*) FILTER (bits & bit <> 0)::BIGINT AS n_failed, count(*) FILTER (bits = bit)::BIGINT AS n_only,
       count(*) FILTER (bits = 0 OR bits = bit)::BIGINT AS n_kept_without
FROM p, r GROUP BY rule
"""


@query("rule_ablation", ABLATION_SQL)
def rule_ablation(table):
    """Per rule of the current policy: documents it fails, documents only it fails,
    documents kept without it; bitwise over the ledger, summed by bit pattern first."""
    return rules.ablation(rules.build_ledger(table("documents")))


_T = [(k, sorted(set(text.split())), label) for k, (text, label) in enumerate(licenses.TEMPLATES)]
_NEED = {k: licenses.needed(len(ws), licenses.THRESHOLD) for k, ws, _ in _T}
_PHRASE = [(text.split(), label) for text, label in licenses.PHRASES]
_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP9_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r,
                  regexp_extract_all(translate(coalesce(text, ''), '{_AZ}', '{_AZ.lower()}'),
                                     '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM d),
g AS (SELECT r, i, word, {', '.join(f"lead(word, {k}) OVER (PARTITION BY r ORDER BY i) AS w{k}" for k in range(1, 4))}
      FROM w),
hit AS ({' UNION ALL '.join(
    f"SELECT r, i, '{label}' AS label FROM g WHERE word = '{ws[0]}' AND "
    + ' AND '.join(f"w{k} = '{x}'" for k, x in enumerate(ws) if k) for ws, label in _PHRASE)}),
base AS (SELECT r, count(*) AS n, min(i) AS lo, max(i) AS hi, list(DISTINCT label) AS ls FROM hit GROUP BY r),
t(k, word, size, need, label) AS (VALUES {', '.join(
    f"({k}, '{x}', {len(ws)}, {_NEED[k]}, '{label}')" for k, ws, label in _T for x in ws)}),
tw AS (SELECT r, word, i FROM w WHERE word IN (SELECT word FROM t)),
v AS (SELECT a.r, a.i AS win, b.word FROM tw a JOIN tw b ON a.r = b.r AND b.i BETWEEN a.i AND a.i + {licenses.BLOCK - 1}),
c AS (SELECT r, win, k, label, size, need, count(DISTINCT v.word) AS n FROM v JOIN t USING (word)
      GROUP BY r, win, k, label, size, need HAVING count(DISTINCT v.word) >= need),
more AS (SELECT r, list(DISTINCT label) AS ls, max(n::DOUBLE / size::DOUBLE) AS share FROM c GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word,
       hi::BIGINT AS last_word, array_to_string(list_sort(coalesce(base.ls, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.ls, []), coalesce(more.ls, [])))), ',') AS labels,
       CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN more USING (r)
"""


@query("op9_license_scan", OP9_SQL)
def op9(table):
    """License phrases and templates found in every document."""
    return licenses.scan_licenses(table("documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score")


OP10_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_W}') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w0, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT doc_id, w0, {', '.join(f"lead(w0, {k}) OVER (PARTITION BY doc_id ORDER BY i) AS w{k}" for k in range(1, 5))}
      FROM w),
s AS (SELECT DISTINCT doc_id, concat_ws(' ', w0, w1, w2, w3, w4) AS gram FROM g WHERE w4 IS NOT NULL
      UNION SELECT doc_id, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND 4),
k AS (SELECT doc_id, md5(string_agg(gram, chr(1) ORDER BY gram)) AS key, count(*) AS n FROM s GROUP BY doc_id),
cl AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY key) AS class_id, count(*) OVER (PARTITION BY key) AS class_size
       FROM k),
rep AS (SELECT s.doc_id, s.gram, cl.n FROM s JOIN cl USING (doc_id) WHERE cl.class_id = cl.doc_id),
rare AS (SELECT gram FROM rep GROUP BY gram HAVING count(*) > 1),
pr AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS shared
       FROM rep a JOIN rep b ON a.gram = b.gram AND a.doc_id < b.doc_id WHERE a.gram IN (SELECT gram FROM rare)
       GROUP BY ALL),
e AS (SELECT a, b FROM pr WHERE shared >= {neardup.THRESHOLD} * (na + nb - shared) - 1e-9),
sym AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(x, y) AS (SELECT a, a FROM sym UNION SELECT reach.x, sym.b FROM reach JOIN sym ON reach.y = sym.a),
root AS (SELECT x, min(y) AS group_id FROM reach GROUP BY x),
ln AS (SELECT a, count(*) AS n_links FROM sym GROUP BY a)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(class_size, 1)::BIGINT AS class_size,
       coalesce(n_links, 0)::BIGINT AS n_links, coalesce(root.group_id, class_id, d.doc_id) AS group_id,
       coalesce(root.group_id, class_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN cl ON d.doc_id = cl.doc_id LEFT JOIN root ON cl.class_id = root.x LEFT JOIN ln ON cl.class_id = ln.a
"""


@query("op10_ngram_jaccard_join", OP10_SQL)
def op10(table):
    """Near-duplicate classes, links and groups of all documents."""
    return neardup.jaccard_join(table("documents")).select(
        "doc_id", "class_id", "class_size", "n_links", "group_id", "kept")


@query("op11_streaming_bpe")
def op11(table):
    """BPE ids and decoded text of every document by the bounded-lookahead transducer, as digests."""
    return transducer.encode_decode(table("documents"), WORD_TOKENIZER).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


_TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
OP12_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r,
                  regexp_extract_all(translate(coalesce(text, ''), '{_AZ}', '{_AZ.lower()}'), '{_TERM}') AS ws
           FROM documents),
s AS (SELECT count(*)::BIGINT AS nn, sum(len(ws))::BIGINT AS ll FROM d WHERE len(ws) > 0),
p AS (SELECT r, word, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ws) AS word FROM d) GROUP BY ALL),
q AS (SELECT item_id, i, word, count(*)::BIGINT AS k
      FROM (SELECT item_id, row_number() OVER () AS i,
                   unnest(regexp_extract_all(translate(text, '{_AZ}', '{_AZ.lower()}'), '{_TERM}')) AS word
            FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
f AS (SELECT word, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
      FROM p, s GROUP BY word, nn),
m AS (SELECT r, doc_id, 25 + (75 * len(ws)::BIGINT * nn) // ll AS m FROM d, s WHERE len(ws) > 0),
x AS (SELECT item_id, i, r, sum(k * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM q JOIN p USING (word) JOIN f USING (word) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank
      FROM x JOIN m USING (r) WHERE score > 0) WHERE rank <= {presence.TOP}
"""


@query("op12_ranked_search", OP12_SQL)
def op12(table):
    """The ten best documents of every benchmark item, by presence-mask groups."""
    return presence.ranked_search(table("documents"), table("benchmark")).select("item_id", "rank", "doc_id", "score")


OP13_SQL = f"""
WITH r AS (SELECT row_number() OVER () AS i, vec_id, embedding,
                  CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT i, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM r),
s AS (SELECT a.i AS ai, a.vec_id AS anchor_id, a.label = b.label AS same, b.i AS bi, b.vec_id,
             list_dot_product(a.v, b.v)::BIGINT AS score
      FROM e a JOIN e b ON a.i <> b.i WHERE a.vec_id % 50 = 0),
p AS (SELECT ai, anchor_id, bi, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY ai ORDER BY score DESC, vec_id, bi) <= {hardneg.POSITIVES})
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.ai, p.bi ORDER BY score DESC, vec_id, s.bi))::INT AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.ai = s.ai AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.ai, p.bi ORDER BY score DESC, vec_id, s.bi) <= {hardneg.NEGATIVES}
"""


@query("op13_hard_negatives", OP13_SQL)
def op13(table):
    """Hard negatives of every fiftieth vector, by threshold joins; a seventh of the labels is shifted first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table("embeddings").select("vec_id", label.alias("label"), "embedding")
    return hardneg.hard_negatives(rows, F.col("vec_id") % 50 == 0)


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five pipeline stages over ``documents``."""
    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = _pipeline
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
