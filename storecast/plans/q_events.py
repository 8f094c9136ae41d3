"""Registered queries: stream events as a batch table."""

from __future__ import annotations

from pyspark.sql import functions as F

from storecast.functions.calendar import parse_date, period_key
from storecast.operators import events as ev
from storecast.plans.catalog import query
from storecast.sources import fixtures as fx


COUNTER_SQL = """
select grain, family, period, cast(sum(s) as decimal(38,2)) value,
       'feature:sales_' || grain || ':' || family || ':' || period key
from (select 'daily' grain, family, strftime(pdate, '%Y-%m-%d') period,
             coalesce(cast(sales as decimal(18,2)), 0) s from r_valid
      union all
      select 'weekly', family, strftime(pdate, '%Y-W%U'), coalesce(cast(sales as decimal(18,2)), 0) from r_valid
      union all
      select 'monthly', family, strftime(pdate, '%Y-%m'), coalesce(cast(sales as decimal(18,2)), 0) from r_valid)
group by grain, family, period"""


@query("counter_rollup", COUNTER_SQL)
def counter_rollup(t):
    """Batch twin of the live counters: sum of sales per grain/family/period."""
    return ev.counter_rollup(ev.valid_events(fx.r_stream_wire(t)))


@query("events_valid", """
select msg_id, date, store_nbr, family, sales, onpromotion from r_valid""")
def events_valid(t):
    """Events with a family, a date, a parseable date and numeric sales."""
    return ev.valid_events(fx.r_stream_wire(t)).select(
        "msg_id", "date", "store_nbr", "family", "sales", "onpromotion")


@query("events_bad_date", """
select msg_id, date, store_nbr, family, sales, onpromotion
from r_stream_checked where has_keys and pdate is null""")
def events_bad_date(t):
    """P2 rejects: key fields present but the date does not parse."""
    return ev.bad_date_events(fx.r_stream_wire(t)).select(
        "msg_id", "date", "store_nbr", "family", "sales", "onpromotion")


@query("events_rejects", """
select msg_id, date, store_nbr, family, sales, onpromotion,
       case when not has_keys then 'missing_key' when pdate is null then 'bad_date'
            else 'bad_sales' end reason
from r_stream_checked where not (has_keys and pdate is not null and sales_ok)""")
def events_rejects(t):
    """Quarantine table: every skipped message with its reason."""
    return ev.rejected_events(fx.r_stream_wire(t))


@query("events_defaults", """
select msg_id, family, date, coalesce(store_nbr, '?') store,
       coalesce(try_cast(sales as decimal(18,2)), cast(0 as decimal(18,2))) sales
from r_stream_wire""")
def events_defaults(t):
    """Missing sales -> 0.00, missing store -> '?'."""
    return ev.with_defaults(fx.r_stream_wire(t))


@query("events_typed", """
select msg_id, family,
       case when regexp_full_match(date, '[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}')
            then cast(try_strptime(date, '%Y-%m-%d') as date) end date,
       try_cast(store_nbr as int) store_nbr, try_cast(sales as decimal(18,2)) sales,
       try_cast(onpromotion as int) onpromotion
from r_stream_wire""")
def events_typed(t):
    """wire strings to typed columns with try-casts."""
    return ev.typed_events(fx.r_stream_wire(t))


@query("parse_dates", """
select msg_id, date date_text, pdate parsed from r_stream_checked""")
def parse_dates(t):
    """strict date parse of every stream date string."""
    w = fx.r_stream_wire(t)
    return w.select("msg_id", F.col("date").alias("date_text"),
                    parse_date(F.col("date")).alias("parsed"))


@query("period_keys", """
select distinct pdate date, strftime(pdate, '%Y-%m-%d') day_key,
       strftime(pdate, '%Y-W%U') week_key, strftime(pdate, '%Y-%m') month_key
from (select cast(o_orderdate as date) pdate from orders)""")
def period_keys(t):
    """day, Sunday-week and month keys for every order date."""
    d = t.orders.select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    return d.select("date", period_key("daily", F.col("date")).alias("day_key"),
                    period_key("weekly", F.col("date")).alias("week_key"),
                    period_key("monthly", F.col("date")).alias("month_key"))


@query("events_quality", """
select count(*) total,
       count(*) filter (where has_keys and pdate is not null and sales_ok) processed,
       count(*) filter (where not has_keys) missing_key,
       count(*) filter (where has_keys and pdate is null) bad_date,
       count(*) filter (where has_keys and pdate is not null and not sales_ok) bad_sales,
       count(*) filter (where has_keys and pdate is not null and sales is null) defaulted_sales
from r_stream_checked""")
def events_quality(t):
    """Counts of processed, skipped and defaulted messages."""
    return ev.events_quality(fx.r_stream_wire(t))


@query("buffer_append", """
select msg_id, try_cast(payload->>'store_nbr' as int) store_nbr, payload->>'family' family,
       try_cast(payload->>'sales' as decimal(18,2)) sales from r_buffer""")
def buffer_append(t):
    """Valid events as JSON payloads (checked through their decoded fields)."""
    p = ev.to_payload(ev.valid_events(fx.r_stream_wire(t)))
    d = F.from_json("payload", ev.PAYLOAD_SCHEMA)
    return p.select("msg_id", d["store_nbr"].try_cast("int").alias("store_nbr"),
                    d["family"].alias("family"), d["sales"].try_cast("decimal(18,2)").alias("sales"))


@query("buffer_decode", """
select msg_id, cast(try_strptime(payload->>'date', '%Y-%m-%d') as date) date,
       try_cast(payload->>'store_nbr' as int) store_nbr, payload->>'family' family,
       try_cast(payload->>'sales' as decimal(18,2)) sales,
       try_cast(payload->>'onpromotion' as int) onpromotion
from r_buffer""")
def buffer_decode(t):
    """JSON encode then decode back to typed sales rows."""
    return ev.decode_payload(fx.r_buffer(t))


@query("flat_to_map", """
select msg_id, m['date'] date, m['family'] family, m['sales'] sales, cardinality(m) n_fields
from (select msg_id, map_from_entries(list_filter([
        {'k': 'date', 'v': date}, {'k': 'store_nbr', 'v': store_nbr}, {'k': 'family', 'v': family},
        {'k': 'sales', 'v': sales}, {'k': 'onpromotion', 'v': onpromotion}], lambda x: x.v is not null)) m
      from r_stream_wire)""")
def flat_to_map(t):
    """F8: the flat [k, v, k, v...] field list of each message to a map."""
    w = fx.r_stream_wire(t)
    m = ev.flat_to_map(ev.wire_fields_array(w))
    return w.select("msg_id", m.alias("m")).select(
        "msg_id", F.col("m")["date"].alias("date"), F.col("m")["family"].alias("family"),
        F.col("m")["sales"].alias("sales"), F.size("m").alias("n_fields"))


@query("clip_predictions", """
select msg_id, cast(greatest(cast(sales as decimal(18,2)) - 25, 0) as decimal(18,2)) clipped
from r_valid where sales is not null""")
def clip_predictions(t):
    """Negative predictions clipped to zero (prediction = sales - 25)."""
    v = ev.typed_events(ev.valid_events(fx.r_stream_wire(t))).where(F.col("sales").isNotNull())
    return v.select("msg_id", F.greatest(F.col("sales") - 25, F.lit(0)).cast("decimal(18,2)").alias("clipped"))
