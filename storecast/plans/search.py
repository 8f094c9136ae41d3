"""Question filters, filtered top-k retrieval with fallback, context
and prompt text, all as batch jobs over a question table."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storecast.functions.text import filters_text, question_date, question_store
from storecast.functions.vectors import cosine
from storecast.operators.topk import topk

TOP_FILTERED = 30      # retrieved per question (source value)
TOP_FALLBACK = 10      # unfiltered retry when the filtered search is empty
TOP_CONTEXT = 20       # records written into the context
TOP_SUGGEST = 5        # matches scanned for suggestions
PREVIEW_CHARS = 200
TOP_DEFAULT = 5        # the client's default top_k

# Fixed text of the context and prompt (fixed values).
CONTEXT_HEADER = "# RETRIEVED SALES RECORDS\n\n"
PROMPT_HEAD = ("You are an expert Retail Data Analyst with access to a comprehensive sales database.\n\n"
               "RETRIEVED DATA:\n")
PROMPT_INSTRUCTIONS = (
    "\n\nINSTRUCTIONS:\n"
    "1. Analyze the retrieved records carefully.\n"
    "2. Answer the user's question based ONLY on the data provided above.\n"
    "3. Be specific - cite dates, stores, sales figures, and other details.\n"
    "4. If the data doesn't fully answer the question, say so and provide what you can.\n"
    "5. Use a professional, concise tone.\n"
    "6. Format numbers with commas (e.g., $1,234.56).\n\n"
    "ANSWER:\n")

FILTERS_LABEL, FOUND_LABEL, FOUND_TAIL = "Filters applied: ", "Found ", " relevant records:\n\n"
FALLBACK_HEAD = "I couldn't find records matching your exact filters ("
FALLBACK_STORES = "), but I found similar data. Try asking about stores "
FALLBACK_FAMILIES = " or product families like "

FILTERS = (("f_store", "store_nbr"), ("f_date", "date_str"))
CARRY = ("text", "store_nbr", "family")


def with_filters(questions: DataFrame) -> DataFrame:
    """Store number and date parsed from the question text."""
    return questions.withColumn("f_store", question_store(F.col("text"))) \
                    .withColumn("f_date", question_date(F.col("text")))


def searchable(index: DataFrame) -> DataFrame:
    return index.select("id", "values", "store_nbr", "family", "text",
                        F.col("date").cast("string").alias("date_str"))


def _with_records(matches: DataFrame, index: DataFrame) -> DataFrame:
    """The matched records' columns.  Cells score ids and vectors only, and the
    matches (at most k a question) fetch their records afterwards."""
    return matches.select("qid", "id", "score", "rank").join(searchable(index).select("id", *CARRY), "id")


def retrieve(questions: DataFrame, index: DataFrame, k: int = TOP_FILTERED) -> DataFrame:
    """Per question, top-k with its filters (if any)."""
    q = with_filters(questions).select("qid", "qvec", "f_store", "f_date")
    return _with_records(topk(q, searchable(index), k, filters=FILTERS), index)


def search_unfiltered(questions: DataFrame, index: DataFrame, k: int = TOP_DEFAULT) -> DataFrame:
    return _with_records(topk(questions.select("qid", "qvec"), searchable(index), k), index)


def fallback(questions: DataFrame, index: DataFrame, found: DataFrame,
             k: int = TOP_FALLBACK) -> DataFrame:
    """M9: questions that had a filter and no match, searched without filters."""
    q = with_filters(questions)
    empty = (q.where(F.col("f_store").isNotNull() | F.col("f_date").isNotNull())
              .join(found.select("qid").distinct(), "qid", "left_anti"))
    return search_unfiltered(empty, index, k)


def suggestions(fb: DataFrame) -> DataFrame:
    """Sorted distinct stores and families in the first 5 fallback
    matches, and the first match's text cut to 200 characters."""
    top = fb.where(F.col("rank") <= TOP_SUGGEST)
    return top.groupBy("qid").agg(
        F.sort_array(F.collect_set("store_nbr")).alias("stores"),
        F.sort_array(F.collect_set("family")).alias("families"),
        F.substring(F.min_by("text", "rank"), 1, PREVIEW_CHARS).alias("sample"))


def context(found: DataFrame, questions: DataFrame) -> DataFrame:
    """header, filters line, count and the first 20 records per question."""
    per_q = found.groupBy("qid").agg(
        F.count(F.lit(1)).alias("n_found"),
        F.sort_array(F.collect_list(F.when(F.col("rank") <= TOP_CONTEXT,
                                           F.struct("rank", "text")))).alias("recs"))
    body = F.array_join(F.transform("recs", lambda r: F.concat(
        F.lit("**Record "), r["rank"].cast("string"), F.lit(":**\n"), r["text"], F.lit("\n\n"))), "")
    q = with_filters(questions).select("qid", "text", "f_store", "f_date")
    ft = filters_text(F.col("f_store"), F.col("f_date"))
    ctx = F.concat(F.lit(CONTEXT_HEADER),
                   F.when(ft.isNotNull(), F.concat(F.lit(FILTERS_LABEL), ft, F.lit("\n\n")))
                    .otherwise(F.lit("")),
                   F.lit(FOUND_LABEL), F.col("n_found").cast("string"), F.lit(FOUND_TAIL), body)
    return q.join(per_q, "qid").select("qid", "text", "n_found", ctx.alias("context"))


def prompt_text(context_col, question_col):
    """The full prompt for the language model."""
    return F.concat(F.lit(PROMPT_HEAD), context_col, F.lit("\n\nUSER QUESTION: "), question_col,
                    F.lit(PROMPT_INSTRUCTIONS))


def fallback_message(questions: DataFrame, sugg: DataFrame) -> DataFrame:
    """The answer text when the filtered search is empty but unfiltered is not."""
    q = with_filters(questions).select("qid", "f_store", "f_date")
    j = q.join(sugg, "qid")
    stores = F.concat(F.lit("["), F.array_join(F.transform("stores", lambda s: s.cast("string")), ", "),
                      F.lit("]"))
    msg = F.concat(
        F.lit(FALLBACK_HEAD),
        filters_text(F.col("f_store"), F.col("f_date")),
        F.lit(FALLBACK_STORES), stores,
        F.lit(FALLBACK_FAMILIES), F.array_join("families", ", "), F.lit("."))
    return j.select("qid", msg.alias("message"))


# The answer when nothing at all was found.
NO_RECORDS_HEAD = "I couldn't find any relevant records for your question"
NO_RECORDS_FILTERS = " with filters: "
NO_RECORDS_TAIL = ". Try rephrasing or asking about a different topic."


def no_records_text(store: Column, date: Column) -> Column:
    """The last answer, with the filters if there are any."""
    any_filter = store.isNotNull() | date.isNotNull()
    return F.concat(F.lit(NO_RECORDS_HEAD),
                    F.when(any_filter, F.concat(F.lit(NO_RECORDS_FILTERS), filters_text(store, date)))
                    .otherwise(F.lit("")), F.lit(NO_RECORDS_TAIL))


def answer_table(questions: DataFrame, index: DataFrame) -> DataFrame:
    """Per question: the prompt when records were found, else the fallback message."""
    # The context and the fallback both read the matches (at most k rows per
    # question), so the scoring runs once and is cut from its lineage.
    found = retrieve(questions, index).checkpoint(eager=True)
    ctx = context(found, questions)
    prompts = ctx.select("qid", prompt_text(F.col("context"), F.col("text")).alias("prompt"),
                         F.lit(None).cast("string").alias("message"))
    fb = fallback(questions, index, found)
    msgs = fallback_message(questions, suggestions(fb)).select(
        "qid", F.lit(None).cast("string").alias("prompt"), "message")
    rest = (with_filters(questions).join(prompts.select("qid").unionByName(msgs.select("qid")), "qid", "left_anti")
            .select("qid", F.lit(None).cast("string").alias("prompt"),
                    no_records_text(F.col("f_store"), F.col("f_date")).alias("message")))
    return prompts.unionByName(msgs).unionByName(rest)


# -- one question at a time ------------------------------------------------------------

ONE_FOUND = pa.schema([("qid", pa.int64()), ("id", pa.string()), ("score", pa.float64()), ("rank", pa.int32()),
                       ("text", pa.string()), ("store_nbr", pa.int32()), ("family", pa.string())])


def search_one(index: DataFrame, qvec: Sequence[float], k: int, store: int | None = None,
               date: str | None = None) -> list[dict]:
    """The top ``k`` records for one vector, ties by id: at most k rows.

    The filters are literals, so they reach the scan of a stored index.  The first
    pass reads id, vector and filter columns and keeps k rows per task; the second
    reads the other columns of the k winners, its list of ids pushed to the scan.
    Nothing is shuffled.  A null vector in the index is no match."""
    rows = index.where(F.col("values").isNotNull())
    if store is not None:
        rows = rows.where(F.col("store_nbr") == F.lit(store))
    if date is not None:
        rows = rows.where(F.col("date") == F.lit(date).try_cast("date"))
    score = cosine(F.col("values"), F.lit([float(x) for x in qvec]))
    best = rows.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k).collect()
    if not best:
        return []
    records = {r.id: r for r in index.where(F.col("id").isin([r.id for r in best]))
               .select("id", "text", F.col("store_nbr").cast("int").alias("store_nbr"), "family").collect()}
    return [{"id": r.id, "score": r.score, "rank": i, "text": records[r.id].text,
             "store_nbr": records[r.id].store_nbr, "family": records[r.id].family} for i, r in enumerate(best, 1)]


def answer_one(index: DataFrame, qid: int, text: str, qvec: Sequence[float] | None) -> DataFrame:
    """``answer_table`` for a single question (one row: qid, prompt, message), by two
    narrow scans of the index and no shuffle of it; with filters that match nothing,
    two more scans for the fallback.  The texts are written by the same functions, on
    at most ``TOP_FILTERED`` rows."""
    spark = index.sparkSession
    # Arrow tables of a few rows become local relations: no job and no Python worker.
    question = spark.createDataFrame(pa.table({"qid": pa.array([qid], pa.int64()), "text": [text]}))
    parsed = with_filters(question).first()
    null = F.lit(None).cast("string")

    def matches(rows: list[dict]) -> DataFrame:
        return spark.createDataFrame(pa.Table.from_pylist([{"qid": qid, **r} for r in rows], schema=ONE_FOUND))

    filtered = parsed.f_store is not None or parsed.f_date is not None
    found = [] if qvec is None else search_one(index, qvec, TOP_FILTERED, parsed.f_store, parsed.f_date)
    if found:
        return context(matches(found), question).select(
            "qid", prompt_text(F.col("context"), F.col("text")).alias("prompt"), null.alias("message"))
    similar = search_one(index, qvec, TOP_FALLBACK) if filtered and qvec is not None else []
    if similar:
        return fallback_message(question, suggestions(matches(similar))).select("qid", null.alias("prompt"), "message")
    return with_filters(question).select(
        "qid", null.alias("prompt"), no_records_text(F.col("f_store"), F.col("f_date")).alias("message"))
