"""The store-sales inputs, derived from the driver's parquet tables.

The reference reads five CSV files and a key-value stream.  These functions
derive the same shapes from the star-schema test tables (see FIXTURES.md) so
that every job reads real, growing data.  ``fixture_sql.py`` holds the same
views as DuckDB SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storecast.functions.text import record_text
from storecast.sources.tables import Tables

# Fixed parameters of the fixture views (they shape the data, not the checks).
QUESTION_MONTH = "2001-07"       # dates written into questions and vector records
VECTOR_EPOCH = "2001-07-01"      # first record date of the vector fixture

# Rows of one partition where a large line item table is counted; up to FEW_PARTS
# of them Spark chooses.
PART_ROWS = 200_000
FEW_PARTS = 8

# What-if scenarios (name, oil, transactions, promo, holiday): fixed values.
SCENARIOS = (
    ("baseline", 45.0, 1500, 0, 0),
    ("oil_shock", 110.0, 1500, 0, 0),
    ("promo_push", 45.0, 1500, 1, 0),
    ("holiday_rush", 60.0, 4000, 1, 1),
)


def r_sales(t: Tables) -> DataFrame:
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                           "l_extendedprice", "l_discount")
    o = t.orders.select("o_orderkey", "o_orderdate")
    p = t.part.select("p_partkey", "p_type")
    j = (li.join(o, li.l_orderkey == o.o_orderkey)
           .join(p, li.l_partkey == p.p_partkey))
    return j.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_id"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.col("l_suppkey").cast("int").alias("store_nbr"),
        F.col("p_type").alias("family"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)").alias("sales"),
        F.round(F.col("l_discount") * 100).cast("int").alias("onpromotion"),
    )


def r_stores(t: Tables) -> DataFrame:
    s = t.supplier.select("s_suppkey", "s_nationkey")
    n = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    r = t.region.select("r_regionkey", "r_name")
    j = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.select(
        F.col("s_suppkey").cast("int").alias("store_nbr"),
        F.col("n_name").alias("city"),
        F.col("r_name").alias("state"),
        F.chr((F.lit(65) + F.col("s_suppkey") % 5).cast("int")).alias("type"),
    )


def r_oil(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderdate", "o_totalprice").where(F.weekday("o_orderdate") < 5)
    g = o.groupBy("o_orderdate").agg(F.min("o_totalprice").alias("p"))
    return g.select(
        F.col("o_orderdate").cast("date").alias("date"),
        F.when(F.dayofmonth("o_orderdate") == 4, F.lit(None))
         .otherwise(F.col("p").cast("decimal(18,2)")).alias("dcoilwtico"),
    )


def r_holidays(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    o = t.orders.select("o_orderdate")
    national = (o.where(((F.month(d) == 1) & (F.dayofmonth(d) == 1))
                        | ((F.month(d) == 12) & F.dayofmonth(d).isin(24, 25)))
                 .select(d.cast("date").alias("date"), F.lit("National").alias("locale"),
                         (F.year(d) % 4 == 0).alias("transferred"))
                 .distinct())
    local = (o.where((F.month(d) == 12) & (F.dayofmonth(d) == 25))
              .select(d.cast("date").alias("date"), F.lit("Local").alias("locale"),
                      F.lit(False).alias("transferred"))
              .distinct())
    return national.unionByName(local)


def r_transactions(t: Tables) -> DataFrame:
    li = t.lineitem.select("l_orderkey", "l_suppkey").where(F.col("l_suppkey") % 10 != 3)
    o = t.orders.select("o_orderkey", "o_orderdate")
    parts = -(-t.lineitem.count() // PART_ROWS)
    if parts > FEW_PARTS:
        # A task holds the distinct orders of its rows: their number must not grow with the table.
        li, o = li.repartition(parts, "l_orderkey"), o.repartition(parts, "o_orderkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return (j.groupBy(F.col("o_orderdate").cast("date").alias("date"),
                      F.col("l_suppkey").cast("int").alias("store_nbr"))
             .agg(F.count_distinct("o_orderkey").alias("transactions")))


def r_stream(t: Tables) -> DataFrame:
    e = t.events
    eid = F.col("event_id")
    return e.select(
        eid.alias("msg_id"),
        F.when(eid % 97 == 0, F.lit(None)).otherwise(F.col("event_type")).alias("family"),
        F.when(eid % 101 == 0, F.lit("not-a-date"))
         .otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("date"),
        (F.col("user_id") % 100).cast("int").alias("store_nbr"),
        F.when(eid % 103 == 0, F.lit(None).cast("decimal(18,2)"))
         .otherwise(F.col("value").cast("decimal(18,2)")).alias("sales"),
        (eid % 3).cast("int").alias("onpromotion"),
    )


WIRE_FIELDS = ("date", "store_nbr", "family", "sales", "onpromotion")


def r_stream_wire(t: Tables) -> DataFrame:
    """The stream as it is on the wire: every field a nullable string."""
    s = r_stream(t)
    return s.select("msg_id", *[F.col(c).cast("string").alias(c) for c in WIRE_FIELDS])


def r_buffer(t: Tables) -> DataFrame:
    """JSON payloads of the valid stream messages (what the stream job buffers)."""
    from storecast.operators.events import valid_events
    w = valid_events(r_stream_wire(t))
    return w.select("msg_id", F.to_json(F.struct(*WIRE_FIELDS)).alias("payload"))


def r_vector_records(t: Tables) -> DataFrame:
    """Sales-like records for the vector fixture, one per ``embeddings`` row."""
    e = t.embeddings.select("vec_id", "embedding", "label")
    rec = e.select(
        F.col("vec_id"),
        F.col("embedding").alias("values"),
        F.date_add(F.lit(VECTOR_EPOCH).cast("date"), (F.col("vec_id") % 31).cast("int")).alias("date"),
        (F.col("vec_id") % 100).cast("int").alias("store_nbr"),
        F.concat(F.lit("FAMILY "), F.col("label").cast("string")).alias("family"),
        ((F.col("vec_id") % 97) * F.lit(10.25).cast("decimal(4,2)")).cast("decimal(18,2)").alias("sales"),
        (F.col("vec_id") % 3).cast("int").alias("onpromotion"),
    )
    stores = r_stores(t).select("store_nbr", "city", "state")
    return rec.join(stores, "store_nbr", "left")


def r_vectors(t: Tables) -> DataFrame:
    """The vector index: id, values and the metadata the search filters on."""
    rec = r_vector_records(t)
    return rec.select(
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("id"),
        "values", "date", "store_nbr", "family", "sales", "city", "state", "onpromotion",
        record_text(F.col("date"), F.col("store_nbr"), F.col("city"), F.col("family"),
                    F.col("sales"), F.col("onpromotion")).alias("text"),
    )


def _question_suffix(conv: Column) -> Column:
    store = (conv % 100).cast("string")
    day = F.lpad(((conv * 7 % 31) + 1).cast("string"), 2, "0")
    date = F.concat(F.lit(QUESTION_MONTH + "-"), day)
    k = conv % 4
    return (F.when(k == 0, F.concat(F.lit(" What about store "), store, F.lit("?")))
             .when(k == 1, F.concat(F.lit(" What sold on "), date, F.lit("?")))
             .when(k == 2, F.concat(F.lit(" Sales in Store  "), store, F.lit(" on "), date, F.lit("?")))
             .otherwise(F.lit("")))


def r_questions(t: Tables) -> DataFrame:
    c = t.conversations.where(F.col("role") == "user")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("qid"),
        F.col("conv_id"),
        F.concat(F.col("text"), _question_suffix(F.col("conv_id"))).alias("text"),
    )


def r_question_vectors(t: Tables) -> DataFrame:
    """Questions with a query vector.  The test vectors are not text embeddings,
    so each conversation takes the ``embeddings`` row with ``vec_id = conv_id``; a
    question without one keeps its row with a null vector."""
    q = r_questions(t)
    e = t.embeddings.select(F.col("vec_id"), F.col("embedding").alias("qvec"))
    return q.join(e, q.conv_id == e.vec_id, "left").select("qid", "text", "qvec")


def r_requests(t: Tables) -> DataFrame:
    """Scoring requests: each sold (store, family, day) one week later, promo flag."""
    s = r_sales(t)
    return s.select(
        "store_nbr", "family",
        F.date_add("date", 7).alias("date"),
        (F.col("onpromotion") > 5).cast("int").alias("promo"),
    ).distinct()


def r_scenarios(spark) -> DataFrame:
    return spark.createDataFrame(
        list(SCENARIOS), "scenario string, oil double, transactions int, promo int, holiday int")
