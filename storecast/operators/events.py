"""Sales events: validation, typing, defaults, JSON buffer and the counter rollup.

Input is the wire form: ``msg_id`` plus nullable string fields
``date, store_nbr, family, sales, onpromotion``.  Everything is a column
expression, so a batch table and a streaming DataFrame take the same path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storecast.functions.calendar import GRAINS, parse_date, period_key

WIRE_SCHEMA = T.StructType([
    T.StructField("msg_id", T.LongType()),
    T.StructField("date", T.StringType()),
    T.StructField("store_nbr", T.StringType()),
    T.StructField("family", T.StringType()),
    T.StructField("sales", T.StringType()),
    T.StructField("onpromotion", T.StringType()),
])

PAYLOAD_SCHEMA = T.StructType([f for f in WIRE_SCHEMA.fields if f.name != "msg_id"])

SALES_TYPE = "decimal(18,2)"


def _present(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def has_keys(w: DataFrame) -> Column:
    """Family and date are present and non-empty."""
    return _present(F.col("family")) & _present(F.col("date"))


def date_ok() -> Column:
    """The date string parses as ``%Y-%m-%d``."""
    return parse_date(F.col("date")).isNotNull()


def sales_ok() -> Column:
    """Missing sales default to 0; present sales must be a number that the
    typed column holds (NaN, infinities and out-of-range values are rejected)."""
    return F.col("sales").isNull() | F.col("sales").try_cast(SALES_TYPE).isNotNull()


def valid_events(w: DataFrame) -> DataFrame:
    """Events that update counters and go to the buffer."""
    return w.where(has_keys(w) & date_ok() & sales_ok())


def rejected_events(w: DataFrame) -> DataFrame:
    """Events skipped or quarantined, with the reason."""
    reason = (F.when(~has_keys(w), F.lit("missing_key"))
               .when(~date_ok(), F.lit("bad_date"))
               .when(~sales_ok(), F.lit("bad_sales")))
    return w.withColumn("reason", reason).where(F.col("reason").isNotNull())


def bad_date_events(w: DataFrame) -> DataFrame:
    """P2 rejects: keys present, date unparseable."""
    return w.where(has_keys(w) & ~date_ok())


def typed_events(w: DataFrame) -> DataFrame:
    """wire strings to typed columns; unparseable values become null."""
    return w.select(
        "msg_id", "family",
        parse_date(F.col("date")).alias("date"),
        F.col("store_nbr").try_cast("int").alias("store_nbr"),
        F.col("sales").try_cast(SALES_TYPE).alias("sales"),
        F.col("onpromotion").try_cast("int").alias("onpromotion"),
    )


def with_defaults(w: DataFrame) -> DataFrame:
    """Missing sales -> 0.00; missing store -> '?'."""
    return w.select(
        "msg_id", "family", "date",
        F.coalesce(F.col("store_nbr"), F.lit("?")).alias("store"),
        F.coalesce(F.col("sales").try_cast(SALES_TYPE), F.lit(0).cast(SALES_TYPE)).alias("sales"),
    )


def counter_rows(valid: DataFrame) -> DataFrame:
    """One row per (grain, family, period) contribution of each valid event."""
    d = parse_date(F.col("date"))
    sales = F.coalesce(F.col("sales").try_cast(SALES_TYPE), F.lit(0).cast(SALES_TYPE))
    grains = F.array(*[F.struct(F.lit(g).alias("grain"), period_key(g, d).alias("period"))
                       for g in GRAINS])
    return valid.select("msg_id", "family", sales.alias("sales"), F.inline(grains))


def counter_key(grain: Column, family: Column, period: Column) -> Column:
    return F.concat(F.lit("feature:sales_"), grain, F.lit(":"), family, F.lit(":"), period)


def counter_rollup(valid: DataFrame) -> DataFrame:
    """A1: sum of sales per (grain, family, period).  Partial aggregation runs
    map-side, so the shuffle carries one row per key and partition."""
    rows = counter_rows(valid)
    agg = rows.groupBy("grain", "family", "period").agg(
        F.sum("sales").cast("decimal(38,2)").alias("value"))
    return agg.withColumn("key", counter_key(F.col("grain"), F.col("family"), F.col("period")))


def events_quality(w: DataFrame) -> DataFrame:
    """Message counts by outcome, one row."""
    keys, dok, sok = has_keys(w), date_ok(), sales_ok()
    n = lambda cond: F.count(F.when(cond, 1)).alias
    return w.agg(
        F.count(F.lit(1)).alias("total"),
        n(keys & dok & sok)("processed"),
        n(~keys)("missing_key"),
        n(keys & ~dok)("bad_date"),
        n(keys & dok & ~sok)("bad_sales"),
        n(keys & dok & F.col("sales").isNull())("defaulted_sales"),
    )


def to_payload(valid: DataFrame) -> DataFrame:
    """The raw event as a JSON string, keyed by ``msg_id``."""
    fields = [f.name for f in PAYLOAD_SCHEMA.fields]
    return valid.select("msg_id", F.to_json(F.struct(*fields)).alias("payload"))


def decode_payload(buf: DataFrame) -> DataFrame:
    """JSON payload back to typed sales rows (the training buffer form)."""
    p = F.from_json(F.col("payload"), PAYLOAD_SCHEMA)
    return buf.select("msg_id", p.alias("p")).select(
        "msg_id",
        parse_date(F.col("p.date")).alias("date"),
        F.col("p.store_nbr").try_cast("int").alias("store_nbr"),
        F.col("p.family").alias("family"),
        F.col("p.sales").try_cast(SALES_TYPE).alias("sales"),
        F.col("p.onpromotion").try_cast("int").alias("onpromotion"),
    )


def flat_to_map(flat: Column) -> Column:
    """F8: ``[k1, v1, k2, v2, ...]`` to a map (the stream's field list)."""
    keys = F.filter(flat, lambda _, i: i % 2 == 0)
    vals = F.filter(flat, lambda _, i: i % 2 == 1)
    return F.map_from_arrays(keys, vals)


def wire_fields_array(w: DataFrame) -> Column:
    """The flat field list a stream message carries (null fields left out)."""
    names = [f.name for f in PAYLOAD_SCHEMA.fields]
    pairs = F.array(*[F.array(F.lit(n), F.col(n)) for n in names])
    return F.flatten(F.filter(pairs, lambda p: p[1].isNotNull()))
