"""Registered queries: record loads, ordering operators and index tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from storecast.operators import ordering
from storecast.operators.ordering import newest_by_key, tail_rows
from storecast.operators.sample import draw_with_replacement
from storecast.plans import features as ft
from storecast.plans import records as rc
from storecast.plans.catalog import query
from storecast.session import work_path
from storecast.sources import fixtures as fx

REC_CTES = """
rec as (select s.*, st.city, st.state, st.type from r_sales s left join r_stores st using (store_nbr)),
recs as (select order_id, line_no, part_id,
                cast(date as varchar) || '_' || cast(store_nbr as varchar) || '_' || replace(family, ' ', '_')
                  || '_' || cast(order_id as varchar) || '-' || cast(line_no as varchar) || '-'
                  || cast(part_id as varchar) || '-' || cast(store_nbr as varchar) id,
                cast(date as varchar) date, store_nbr, family, cast(sales as double) sales,
                'On ' || cast(date as varchar) || ', Store ' || cast(store_nbr as varchar)
                  || case when city is not null then ' in ' || city else '' end
                  || ' sold ' || family || ' with sales of $' || cast(cast(sales as decimal(18,2)) as varchar)
                  || case when coalesce(onpromotion <> 0, true) then ' (on promotion)' else '' end text,
                city, state, onpromotion, cast(null as int) is_holiday, date real_date
         from rec),
ranked as (select *, row_number() over (order by real_date desc, order_id desc, line_no desc,
                                                 part_id desc, store_nbr desc) rn from recs),
kept as (select * from ranked where rn <= 500000),
newest as (select * from recs where real_date > (select max(real_date) from recs) - 1)"""

REC_COLS = "id, date, store_nbr, family, sales, text, city, state, onpromotion, is_holiday"


@query("record_text", "select order_id, line_no, part_id, text from recs", extra=REC_CTES)
def record_text(t):
    """the sentence for every sale with its store."""
    recs = rc.to_records(rc.sales_with_stores(t), keep=("order_id", "line_no", "part_id"))
    return recs.select("order_id", "line_no", "part_id", "text")


@query("record_id", "select order_id, line_no, part_id, id from recs", extra=REC_CTES)
def record_id(t):
    """``{date}_{store}_{family}_{row key}``."""
    recs = rc.to_records(rc.sales_with_stores(t), keep=("order_id", "line_no", "part_id"))
    return recs.select("order_id", "line_no", "part_id", "id")


@query("vector_metadata", f"select {REC_COLS} from recs", extra=REC_CTES)
def vector_metadata(t):
    """the metadata fields of every record (absent optional -> null)."""
    return rc.to_records(rc.sales_with_stores(t))


@query("latest_n", "select order_id, line_no, part_id, store_nbr, real_date date from kept",
       extra=REC_CTES)
def latest_n(t):
    """L1: the newest 500,000 sales (date, then row key, descending)."""
    return rc.newest(t).select("order_id", "line_no", "part_id", "store_nbr", "date")


@query("renumber", """
select order_id, line_no, part_id, cast((select count(*) from kept) - rn as bigint) idx from kept""",
       extra=REC_CTES)
def renumber(t):
    """L2: the selected rows renumbered from 0 in ascending order."""
    return renumbered(t, rc.NEWEST_RECORDS)


def renumbered(t, n: int):
    rows = fx.r_sales(t).select("date", *rc.TIE_COLS)
    return ordering.latest_n(rows, n, "date", rc.TIE_COLS).select("order_id", "line_no", "part_id", "idx")


@query("renumber_20k", """
select order_id, line_no, part_id, cast(least(20000, (select count(*) from recs)) - rn as bigint) idx
from ranked where rn <= 20000""", extra=REC_CTES)
def renumber_20k(t):
    """L1/L2 with N below the row count: the newest 20,000 sales, renumbered."""
    return renumbered(t, 20_000)


@query("initial_load", f"select {REC_COLS} from recs", extra=REC_CTES)
def initial_load(t):
    """Records of all sales (up to the vector)."""
    return rc.initial_load(t)


@query("latest_days", "select order_id, line_no, part_id, real_date date, city from newest",
       extra=REC_CTES)
def latest_days(t):
    """Sales of the last day (``date > max(date) - 1``)."""
    return rc.latest_days(rc.sales_with_stores(t)).select(
        "order_id", "line_no", "part_id", "date", "city")


@query("daily_load", f"select {REC_COLS} from newest", extra=REC_CTES)
def daily_load(t):
    """C4: records of the last day's sales."""
    return rc.daily_load(t)


@query("load_summary", """
select count(*) n_rows, min(real_date) min_date, max(real_date) max_date from recs""",
       extra=REC_CTES)
def load_summary(t):
    """A4: size and date range of the initial load."""
    s = rc.initial_selection(t)
    return s.agg(F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("min_date"),
                 F.max("date").alias("max_date"))


@query("buffer_trim", """
select msg_id, payload->>'family' family, try_cast(payload->>'sales' as decimal(18,2)) sales
from r_buffer order by msg_id desc limit 100001""")
def buffer_trim(t):
    """L3: keep the newest 100,001 buffered events (inclusive trim)."""
    return trimmed(t, 100_001)


def trimmed(t, keep: int):
    kept = newest_by_key(fx.r_buffer(t), keep, "msg_id")
    d = F.from_json("payload", "family string, sales string")
    return kept.select("msg_id", d["family"].alias("family"),
                       d["sales"].try_cast("decimal(18,2)").alias("sales"))


@query("buffer_trim_2k", """
select msg_id, payload->>'family' family, try_cast(payload->>'sales' as decimal(18,2)) sales
from r_buffer order by msg_id desc limit 2001""")
def buffer_trim_2k(t):
    """L3 with ``keep`` below the row count: the newest 2,001 buffered events."""
    return trimmed(t, 2_001)


@query("history_tail", """
select ds, y from (select date ds, cast(coalesce(sum(sales), 0) as decimal(38,4)) y
                   from r_sales group by date) order by ds desc limit 60""")
def history_tail(t):
    """The last 60 days of the daily history."""
    s = fx.r_sales(t)
    daily = s.groupBy(F.col("date").alias("ds")).agg(
        F.coalesce(F.sum("sales"), F.lit(0)).cast("decimal(38,4)").alias("y"))
    return tail_rows(daily, 60, "ds")


VEC_CTES = """
upd as (select 'v' || cast(vec_id // 2 as varchar) id, vec_id src, 1 gen,
               cast(sales + 1 as decimal(18,2)) sales from r_vector_records),
cur as (select 'v' || cast(vec_id as varchar) id, vec_id src, 0 gen, sales from r_vector_records),
merged as (select * from (select *, row_number() over (partition by id order by gen desc, src desc) r
                          from (select * from cur union all select * from upd)) where r = 1)"""


@query("vector_upsert", "select id, src, gen, sales from merged", extra=VEC_CTES)
def vector_upsert(t):
    """Re-keyed records upserted into the index; same id keeps the newest
    (within the batch, the last by source id)."""
    rec = fx.r_vector_records(t)
    cur = rec.select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("id"),
                     F.col("vec_id").alias("src"), F.lit(0).alias("gen"), "sales")
    new = rec.select(F.concat(F.lit("v"), (F.col("vec_id") / 2).cast("bigint").cast("string")).alias("id"),
                     F.col("vec_id").alias("src"), F.lit(1).alias("gen"),
                     (F.col("sales") + 1).cast("decimal(18,2)").alias("sales"))
    return rc.upsert(cur, new, order_col="src")


@query("vector_stats", """
select count(*) total_vectors, cast(max(len("values")) as int) dimension,
       cast(count(*) / 1000000 as decimal(18,6)) index_fullness from r_vectors""")
def vector_stats(t):
    """Vector count, dimension and fullness of the index."""
    return rc.index_stats(fx.r_vectors(t))


@query("scenario_impact", """
select store_nbr, family, cast(sum(sales) as decimal(38,4)) total_base,
       cast(sum(round(case when onpromotion = 1 then sales * 1.5 else sales end, 2)) as decimal(38,4)) total_scenario,
       cast(sum(round(case when onpromotion = 1 then sales * 1.5 else sales end, 2)) - sum(sales) as decimal(38,4)) diff,
       cast(round(case when sum(sales) > 0
                  then (sum(round(case when onpromotion = 1 then sales * 1.5 else sales end, 2)) - sum(sales))
                       / sum(sales) * 100 else 0 end, 4) as decimal(18,4)) pct
from r_sales group by store_nbr, family""")
def scenario_impact(t):
    """Impact of the promotion uplift rule per store and family (totals,
    difference, percent; 0 percent when the base is not positive)."""
    from storecast.operators.scenario import impact, promo_uplift
    s = fx.r_sales(t)
    tot = s.groupBy("store_nbr", "family").agg(
        F.sum("sales").cast("decimal(38,4)").alias("total_base"),
        F.sum(promo_uplift(F.col("sales"), F.col("onpromotion"))).cast("decimal(38,4)").alias("total_scenario"))
    out = impact(tot)
    return out.select("store_nbr", "family", "total_base", "total_scenario",
                      F.col("diff").cast("decimal(38,4)").alias("diff"),
                      F.round(F.col("pct"), 4).cast("decimal(18,4)").alias("pct"))


@query("bootstrap_sample", """
select d.draw, s.store_nbr, s.family, s.onpromotion, s.sales,
       round(case when s.onpromotion = 1 then s.sales * 1.5 else s.sales end, 2) simulated
from (select i draw, ('0x' || substr(md5('42-' || cast(i as varchar)), 1, 15))::bigint
                     % (select count(*) from r_sales) pos
      from range(0, (select count(*) // 100 from r_sales)) r(i)) d
join (select *, row_number() over (order by md5(cast(order_id as varchar) || '-' || cast(line_no as varchar) || '-'
                                                || cast(part_id as varchar) || '-' || cast(store_nbr as varchar))) - 1 pos
      from r_sales) s using (pos)""")
def bootstrap_sample(t):
    """One draw per 100 sales, exactly, seeded and with replacement, with
    the promo uplift applied to each (the producer's draw, as one job)."""
    from storecast.operators.scenario import promo_uplift
    # The sales are read several times: written once, their joins are made once.
    path = work_path(t.spark, "sales", uuid.uuid4().hex)
    fx.r_sales(t).write.parquet(path)
    s = t.spark.read.parquet(path)
    drawn = draw_with_replacement(s, rc.row_key(), s.count() // 100, seed=42)
    return drawn.select("draw", "store_nbr", "family", "onpromotion", "sales").withColumn(
        "simulated", promo_uplift(F.col("sales"), F.col("onpromotion")))


@query("embed_records")
def embed_records(t):
    """M7: record texts to 384-dim unit vectors (hashed terms, IDF weights)."""
    from storecast.models.embed import embed, fit_embedder
    recs = rc.initial_load(t).select("id", "text")
    model = fit_embedder(recs)
    return embed(model, recs).select("id", "values")


@query("time_split_counts", """
select case when date < date '2001-01-01' then 'train' else 'validate' end split, count(*) n
from r_sales group by 1""")
def time_split_counts(t):
    """P6 summary: rows per side of the split date."""
    return ft.with_split(fx.r_sales(t)).groupBy("split").agg(F.count(F.lit(1)).alias("n"))
