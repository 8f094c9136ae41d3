"""Registered queries: similarity search, question filters, context and prompt."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from storecast.functions.vectors import cosine
from storecast.operators import cellindex as ci
from storecast.operators.joins import broadcast_if_small
from storecast.plans import search as se
from storecast.plans.catalog import query
from storecast.session import work_path
from storecast.sources import fixtures as fx

SEARCH_CTES = r"""
qf as (select qid, text, qvec,
              try_cast(nullif(regexp_extract(lower(text), 'store\s+(\d+)', 1), '') as int) f_store,
              nullif(regexp_extract(text, '(\d{4})-(\d{2})-(\d{2})', 0), '') f_date
       from r_question_vectors),
idx as (select id, "values", store_nbr, family, text, cast(date as varchar) date_str from r_vectors),
scored as (select q.qid, i.id, i.text, i.store_nbr, i.family,
                  case when list_cosine_similarity(cast(q.qvec as double[]), cast(i."values" as double[])) = 'nan'::double
                       then 0 else list_cosine_similarity(cast(q.qvec as double[]), cast(i."values" as double[])) end score
           from qf q join idx i on (q.f_store is null or i.store_nbr = q.f_store)
                              and (q.f_date is null or i.date_str = q.f_date)
           where q.qvec is not null),
found as (select * from (select *, row_number() over (partition by qid order by score desc, id) rank from scored)
          where rank <= 30),
nomatch as (select * from qf where qvec is not null and (f_store is not null or f_date is not null)
                                and qid not in (select qid from found)),
fb as (select * from (select *, row_number() over (partition by qid order by score desc, id) rank
                      from (select e.qid, i.id, i.text, i.store_nbr, i.family,
                                   list_cosine_similarity(cast(e.qvec as double[]), cast(i."values" as double[])) score
                            from nomatch e, idx i))
       where rank <= 10),
sugg as (select qid, list_sort(list_distinct(list(store_nbr))) stores,
                list_sort(list_distinct(list(family))) families,
                substring(min_by(text, rank), 1, 200) sample
         from fb where rank <= 5 group by qid),
ftext as (select qid, case when f_store is null and f_date is null then null
                      else '{' || concat_ws(', ', case when f_store is not null then '''store_nbr'': ' || cast(f_store as varchar) end,
                                                  case when f_date is not null then '''date'': ''' || f_date || '''' end) || '}' end filters
          from qf),
ctx as (select q.qid, q.text, count(*) n_found,
               '# RETRIEVED SALES RECORDS' || chr(10) || chr(10)
               || coalesce('Filters applied: ' || ft.filters || chr(10) || chr(10), '')
               || 'Found ' || cast(count(*) as varchar) || ' relevant records:' || chr(10) || chr(10)
               || coalesce(string_agg(case when f.rank <= 20 then '**Record ' || cast(f.rank as varchar) || ':**' || chr(10)
                                       || f.text || chr(10) || chr(10) end, '' order by f.rank), '') context
        from qf q join found f using (qid) join ftext ft using (qid) group by q.qid, q.text, ft.filters)"""

# The prompt's text, as in ``search.PROMPT_HEAD`` and ``PROMPT_INSTRUCTIONS``.
PROMPT_SQL = ("'You are an expert Retail Data Analyst with access to a comprehensive sales database.' || chr(10) || chr(10)"
              " || 'RETRIEVED DATA:' || chr(10) || context || chr(10) || chr(10) || 'USER QUESTION: ' || text"
              " || chr(10) || chr(10) || 'INSTRUCTIONS:' || chr(10)"
              " || '1. Analyze the retrieved records carefully.' || chr(10)"
              " || '2. Answer the user''s question based ONLY on the data provided above.' || chr(10)"
              " || '3. Be specific - cite dates, stores, sales figures, and other details.' || chr(10)"
              " || '4. If the data doesn''t fully answer the question, say so and provide what you can.' || chr(10)"
              " || '5. Use a professional, concise tone.' || chr(10)"
              " || '6. Format numbers with commas (e.g., $1,234.56).' || chr(10) || chr(10)"
              " || 'ANSWER:' || chr(10)")


@query("question_filters", r"""
select qid, try_cast(nullif(regexp_extract(lower(text), 'store\s+(\d+)', 1), '') as int) f_store,
       nullif(regexp_extract(text, '(\d{4})-(\d{2})-(\d{2})', 0), '') f_date
from r_questions""")
def question_filters(t):
    """Store number and date parsed from each question (null = none)."""
    return se.with_filters(fx.r_questions(t)).select("qid", "f_store", "f_date")


@query("cosine_scores", """
select v.id, v.family, round(list_cosine_similarity(cast(v."values" as double[]), c.c), 6) score
from r_vectors v join (select family, list(m order by pos) c
                       from (select family, pos, avg(x) m
                             from (select family, cast(unnest("values") as double) x,
                                          generate_subscripts("values", 1) pos from r_vectors)
                             group by family, pos)
                       group by family) c using (family)""")
def cosine_scores(t):
    """cosine of each vector with the mean vector of its family.  The
    mean is a vector aggregation (partial sums per partition)."""
    v = fx.r_vectors(t).select("id", "family", "values")
    cent = (v.select("family", array_to_vector("values").alias("_v")).groupBy("family")
             .agg(Summarizer.mean(F.col("_v")).alias("_m"))
             .select("family", vector_to_array("_m").alias("centroid")))
    # One row per family; broadcast when its counted size is small, so vectors stay where they are.
    j = v.join(broadcast_if_small(cent.checkpoint(eager=True)), "family")
    return j.select("id", "family", F.round(cosine(F.col("values"), F.col("centroid")), 6).alias("score"))


@query("topk_search", """
select qid, id, round(score, 6) score, rank from (
  select *, row_number() over (partition by qid order by score desc, id) rank from (
    select q.qid, i.id, list_cosine_similarity(cast(q.qvec as double[]), cast(i."values" as double[])) score
    from qf q, idx i where q.qvec is not null)) where rank <= 5""", extra=SEARCH_CTES)
def topk_search(t):
    """L4/M8: unfiltered top-5 matches of every question."""
    r = se.search_unfiltered(fx.r_question_vectors(t), fx.r_vectors(t), k=se.TOP_DEFAULT)
    return r.select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query("topk_batch", "select qid, id, round(score, 6) score, rank from found", extra=SEARCH_CTES)
def topk_batch(t):
    """Top-30 per question with its parsed filters (if any)."""
    r = se.retrieve(fx.r_question_vectors(t), fx.r_vectors(t))
    return r.select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query("topk_filtered", """
select f.qid, f.id, f.store_nbr, round(f.score, 6) score, f.rank
from found f join qf q using (qid) where q.f_store is not null or q.f_date is not null""",
       extra=SEARCH_CTES)
def topk_filtered(t):
    """Matches of the questions that carry a store and/or date filter."""
    qv = fx.r_question_vectors(t)
    r = se.retrieve(qv, fx.r_vectors(t))
    filtered = se.with_filters(qv).where(F.col("f_store").isNotNull() | F.col("f_date").isNotNull())
    return r.join(filtered.select("qid"), "qid", "left_semi").select(
        "qid", "id", "store_nbr", F.round("score", 6).alias("score"), "rank")


@query("search_fallback", "select qid, id, round(score, 6) score, rank from fb", extra=SEARCH_CTES)
def search_fallback(t):
    """M9: unfiltered top-10 for questions whose filtered search found nothing."""
    qv, idx = fx.r_question_vectors(t), fx.r_vectors(t)
    fb = se.fallback(qv, idx, se.retrieve(qv, idx))
    return fb.select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query("search_suggestions", "select qid, stores, families, sample from sugg", extra=SEARCH_CTES)
def search_suggestions(t):
    """Stores, families and a 200-character sample from the fallback."""
    qv, idx = fx.r_question_vectors(t), fx.r_vectors(t)
    return se.suggestions(se.fallback(qv, idx, se.retrieve(qv, idx)))


@query("search_context", "select qid, n_found, context from ctx", extra=SEARCH_CTES)
def search_context(t):
    """the context text (header, filters, count, first 20 records)."""
    qv = fx.r_question_vectors(t)
    found = se.retrieve(qv, fx.r_vectors(t))
    return se.context(found, qv).select("qid", "n_found", "context")


ANSWER_SQL = f"""
select qid, {PROMPT_SQL} prompt, cast(null as varchar) message from ctx
union all
select s.qid, cast(null as varchar),
       'I couldn''t find records matching your exact filters (' || ft.filters
       || '), but I found similar data. Try asking about stores ['
       || array_to_string(list_transform(s.stores, x -> cast(x as varchar)), ', ')
       || '] or product families like ' || array_to_string(s.families, ', ') || '.'
from sugg s join ftext ft using (qid)
union all
select qid, cast(null as varchar), 'I couldn''t find any relevant records for your question'
       || coalesce(' with filters: ' || filters, '') || '. Try rephrasing or asking about a different topic.'
from ftext where qid not in (select qid from ctx) and qid not in (select qid from sugg)""".replace("x -> cast", "lambda x: cast")


@query("prompt_table", ANSWER_SQL, extra=SEARCH_CTES)
def prompt_table(t):
    """Per question, the model prompt, or the fallback answer when the
    filtered search is empty."""
    return se.answer_table(fx.r_question_vectors(t), fx.r_vectors(t))


def _one_sql(shape: int) -> str:
    return f"""select * from ({ANSWER_SQL}) where qid = (
  select min(qid) from r_question_vectors where qvec is not null and qid // 1000 % 4 = {shape})"""


def _answer_one(t, shape: int):
    """One stored question (the first of a kind, see ``fixtures.r_questions``)
    against a stored copy of the whole index."""
    kind = F.floor(F.col("qid") / 1000) % 4
    q = (fx.r_question_vectors(t).where(F.col("qvec").isNotNull() & (kind == shape)).orderBy("qid").limit(1).collect())
    path = work_path(t.spark, "answer-index", uuid.uuid4().hex)
    fx.r_vectors(t).write.parquet(path)
    index = t.spark.read.parquet(path)
    if not q:
        return t.spark.createDataFrame([], "qid long, prompt string, message string")
    return se.answer_one(index, q[0].qid, q[0].text, q[0].qvec)


@query("answer_one", _one_sql(3), extra=SEARCH_CTES)
def answer_one(t):
    """The answer to a single question without filters."""
    return _answer_one(t, 3)


@query("answer_one_store", _one_sql(0), extra=SEARCH_CTES)
def answer_one_store(t):
    """The answer to a single question about a store."""
    return _answer_one(t, 0)


@query("answer_one_day", _one_sql(1), extra=SEARCH_CTES)
def answer_one_day(t):
    """The answer to a single question about a day."""
    return _answer_one(t, 1)


CELLS = 16


def _cell_index(t) -> ci.CellIndex:
    v = fx.r_vectors(t).select("id", "values")
    return ci.build(v, ci.fit_centroids(v, CELLS), work_path(t.spark, "cells", uuid.uuid4().hex))


@query("topk_index", """
select qid, id, round(score, 6) score, rank from (
  select *, row_number() over (partition by qid order by score desc, id) rank from (
    select q.qid, i.id, list_cosine_similarity(cast(q.qvec as double[]), cast(i."values" as double[])) score
    from qf q, idx i where q.qvec is not null)) where rank <= 5""", extra=SEARCH_CTES)
def topk_index(t):
    """L4/M8: the same top-5 from the pruned cell index."""
    found, _ = ci.search(_cell_index(t), fx.r_question_vectors(t).select("qid", "qvec"), se.TOP_DEFAULT)
    return found.select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query("topk_probes", """
select count(*) n, true enough from (
  select q.qid, row_number() over (partition by q.qid order by i.id) rank from qf q, idx i where q.qvec is not null)
where rank <= 5""", extra=SEARCH_CTES)
def topk_probes(t):
    """M8: the approximate search with as many probes as a recall of 0.9 needs,
    measured against the exact search of every question."""
    index, q = _cell_index(t), fx.r_question_vectors(t).select("qid", "qvec")
    exact = ci.search(index, q, se.TOP_DEFAULT)[0].checkpoint(eager=True)
    probes, _ = ci.choose_probes(index, q, exact, se.TOP_DEFAULT)
    r = ci.recall(exact, ci.probe_search(index, q, se.TOP_DEFAULT, probes))
    return r.select("n", (F.col("recall") >= 0.9).alias("enough"))


@query("questions_answered", "select qid, true answered from r_questions")
def questions_answered(t):
    """Every question has a prompt or a message, with or without a vector."""
    a = se.answer_table(fx.r_question_vectors(t), fx.r_vectors(t))
    return a.select("qid", (F.col("prompt").isNotNull() | F.col("message").isNotNull()).alias("answered"))
