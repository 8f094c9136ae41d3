"""The feature table - history plus fresh buffered rows, oil carried over
the calendar, stores, holidays and transactions joined, calendar columns and
label codes added."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storecast.functions.calendar import calendar_columns
from storecast.operators import encode, fill, joins
from storecast.operators.events import decode_payload
from storecast.sources import fixtures as fx
from storecast.sources.tables import Tables

# The model's features and their order.
FEATURES = ("store_nbr", "family_encoded", "onpromotion", "transactions", "dcoilwtico",
            "is_holiday", "city_encoded", "state_encoded", "type_encoded", "day_of_week",
            "month", "year", "day_of_month")
TARGET = "sales"
SPLIT_DATE = "2001-01-01"
ROW_KEYS = ("order_id", "line_no", "part_id", "msg_id")


def history(t: Tables) -> DataFrame:
    return fx.r_sales(t)


def fresh(buffer: DataFrame) -> DataFrame:
    """Buffered stream rows as sales rows."""
    d = decode_payload(buffer)
    return d.withColumn("sales", F.col("sales").cast("decimal(18,4)"))


def union_fresh(hist: DataFrame, new: DataFrame) -> DataFrame:
    """Union by column name; columns missing on one side become null."""
    return hist.unionByName(new, allowMissingColumns=True)


def oil_by_day(t: Tables) -> DataFrame:
    return fill.resample_daily_ffill(fx.r_oil(t))


def oil_filled(facts: DataFrame, t: Tables) -> DataFrame:
    return fill.fill_over_dates(facts.select("date"), oil_by_day(t))


def fact_keys(facts: DataFrame) -> DataFrame:
    """The distinct dates, stores and families of the facts, each in rows of its own.

    All three come from one pass over the facts; partial aggregation collapses
    them map-side, as each set is bounded by its domain and not by the fact (the
    pairs of stores and families are not: they grow with the fact).  The result is
    cut from its lineage with a reliable checkpoint, so the oil fill and the code
    fit both read it and neither reads the facts again.
    """
    null = {"date": F.lit(None).cast("date"), "store_nbr": F.lit(None).cast("int"), "family": F.lit(None).cast("string")}

    def key(kind):
        value = F.col(kind).cast("int") if kind == "store_nbr" else F.col(kind)
        return F.struct(F.lit(kind).alias("kind"), *[(value if c == kind else none).alias(c) for c, none in null.items()])
    return facts.select(F.inline(F.array(*[key(c) for c in null]))).distinct().checkpoint(eager=True)


def key_values(keys: DataFrame, kind: str) -> DataFrame:
    return keys.where(F.col("kind") == kind).select(kind)


def checked_stores(t: Tables) -> DataFrame:
    """The store table, broadcast-hinted when its size check passes (the
    check runs once per build, and every store join reuses its outcome)."""
    return joins.broadcast_if_small(fx.r_stores(t))


def joined(t: Tables, facts: DataFrame | None = None, dedupe_holidays: bool = False,
           keys: DataFrame | None = None, stores: DataFrame | None = None,
           transactions: bool = True) -> DataFrame:
    """Facts with oil, stores, holiday flag, transactions and calendar columns.

    The transaction side is one row per (date, store) (it is an aggregate on
    those keys), so its join adds a column and never repeats a row.  Readers
    that do not use the column pass ``transactions=False`` and skip it.
    """
    if facts is None:
        facts = facts_of(t)
    if keys is None:
        keys = fact_keys(facts)
    if stores is None:
        stores = checked_stores(t)
    oil = fill.fill_over_dates(key_values(keys, "date"), oil_by_day(t))
    # The transaction join is the only side that may be too large to broadcast;
    # it runs first, so if it has to shuffle, the facts cross the shuffle narrow
    # and before the holiday fan-out.  The broadcast joins stay in one stage.
    j = joins.join_transactions(facts, fx.r_transactions(t)) if transactions else facts
    j = j.join(F.broadcast(oil), "date", "left")
    j = joins.join_stores(j, stores, checked=False)
    j = joins.join_holidays(j, fx.r_holidays(t), dedupe=dedupe_holidays)
    return j.withColumns(calendar_columns(F.col("date")))


def code_inputs(keys: DataFrame, stores: DataFrame) -> DataFrame:
    """The encoded columns' distinct values as the joined table holds them, from a narrow input.

    Every join after the facts is a left join, and the holiday fan-out only
    repeats rows, so the joined table's families are those of the facts, and its
    values of city, state and type those of the facts' distinct stores joined to
    the stores.  Reading these gives the same codes without computing the oil,
    holiday and transaction joins first.
    """
    families = encode.distinct_values(key_values(keys, "family"), ["family"])
    placed = joins.join_stores(key_values(keys, "store_nbr"), stores, checked=False)
    return families.unionByName(encode.distinct_values(placed, [c for c in encode.ENCODED_COLUMNS if c != "family"]))


def fit_feature_codes(t: Tables, keys: DataFrame, stores: DataFrame | None = None, materialize: bool = True) -> DataFrame:
    if stores is None:
        stores = checked_stores(t)
    codes = encode.rank_codes(code_inputs(keys, stores))
    return codes.checkpoint(eager=True) if materialize else codes


def facts_of(t: Tables) -> DataFrame:
    return union_fresh(history(t), fresh(fx.r_buffer(t)))


def feature_table(t: Tables, dedupe_holidays: bool = False, codes: DataFrame | None = None) -> DataFrame:
    facts = facts_of(t)
    keys = fact_keys(facts)
    stores = checked_stores(t)
    if codes is None:
        codes = fit_feature_codes(t, keys, stores)
    j = joined(t, facts, dedupe_holidays=dedupe_holidays, keys=keys, stores=stores)
    out = encode.apply_codes(j, codes)
    cols = [*ROW_KEYS, "date", "store_nbr", "family", "sales", "onpromotion", "dcoilwtico",
            "city", "state", "type", "is_holiday", "transactions", "day_of_week", "month",
            "year", "day_of_month", "family_encoded", "city_encoded", "state_encoded", "type_encoded"]
    return out.select(*cols)


def with_split(df: DataFrame, split_date: str = SPLIT_DATE, test_date: str | None = None) -> DataFrame:
    """``train`` before the split date, ``validate`` on or after it.  With
    ``test_date``, rows on or after it are ``test``: the patience rule then
    tunes on ``validate`` and the error is reported on rows it never saw (the
    source tunes and reports on the same rows, which stays the default)."""
    d = F.col("date")
    split = F.when(d < F.lit(split_date).cast("date"), "train")
    if test_date is not None:
        split = split.when(d < F.lit(test_date).cast("date"), "validate").otherwise("test")
    else:
        split = split.otherwise("validate")
    return df.withColumn("split", split)


def daily_series(features: DataFrame) -> DataFrame:
    """A2: company total per day: sum of sales (0 when all null), mean oil,
    max holiday flag; renamed to ds / y."""
    return features.groupBy(F.col("date").alias("ds")).agg(
        F.coalesce(F.sum("sales"), F.lit(0)).cast("decimal(38,4)").alias("y"),
        F.avg("dcoilwtico").cast("decimal(18,2)").alias("dcoilwtico"),
        F.max("is_holiday").alias("is_holiday"))
