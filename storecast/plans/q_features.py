"""Registered queries: sources, fills, joins, codes and the feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from storecast.functions.calendar import calendar_columns
from storecast.operators import encode, fill, joins
from storecast.plans import features as ft
from storecast.plans.catalog import query
from storecast.sources import fixtures as fx

# DuckDB CTEs shared by the feature oracles (after the r_* views).
OIL_CTES = """
oil_cal as (select cast(unnest(generate_series(min(date), max(date), interval 1 day)) as date) date from r_oil),
oil_day as (select c.date, o.dcoilwtico from oil_cal c asof left join r_oil o on c.date >= o.date)"""

FACT_CTES = OIL_CTES + """,
hist as (select order_id, line_no, part_id, cast(null as bigint) msg_id, date, store_nbr, family,
                sales, onpromotion from r_sales),
fresh as (select cast(null as bigint), cast(null as int), cast(null as bigint), msg_id,
                 cast(try_strptime(payload->>'date', '%Y-%m-%d') as date),
                 try_cast(payload->>'store_nbr' as int), payload->>'family',
                 cast(try_cast(payload->>'sales' as decimal(18,2)) as decimal(18,4)),
                 try_cast(payload->>'onpromotion' as int) from r_buffer),
facts as (select * from hist union all select * from fresh),
fdj as (select fd.date, o.dcoilwtico v from (select distinct date from facts) fd left join oil_day o using (date)),
oil_f as (select date, coalesce(
            last_value(v ignore nulls) over (order by date rows between unbounded preceding and current row),
            first_value(v ignore nulls) over (order by date rows between current row and unbounded following)) dcoilwtico
          from fdj),
hol as (select date, 1 is_holiday from r_holidays where transferred = false),
joined as (select f.*, o.dcoilwtico, s.city, s.state, s.type, coalesce(h.is_holiday, 0) is_holiday,
                  cast(coalesce(x.transactions, 0) as bigint) transactions,
                  cast(isodow(f.date) - 1 as int) day_of_week, cast(month(f.date) as int) as month,
                  cast(year(f.date) as int) as year, cast(day(f.date) as int) as day_of_month
           from facts f left join oil_f o using (date) left join r_stores s using (store_nbr)
                left join hol h using (date) left join r_transactions x using (date, store_nbr)),
codes as (select c, v, cast(dense_rank() over (partition by c order by v) - 1 as int) code
          from (select distinct c, v from (
                  select 'family' c, coalesce(family, 'nan') v from joined union all
                  select 'city', coalesce(city, 'nan') from joined union all
                  select 'state', coalesce(state, 'nan') from joined union all
                  select 'type', coalesce(type, 'nan') from joined))),
features as (select j.*, cf.code family_encoded, cc.code city_encoded, cs.code state_encoded, ct.code type_encoded
             from joined j
             left join codes cf on cf.c = 'family' and cf.v = coalesce(j.family, 'nan')
             left join codes cc on cc.c = 'city' and cc.v = coalesce(j.city, 'nan')
             left join codes cs on cs.c = 'state' and cs.v = coalesce(j.state, 'nan')
             left join codes ct on ct.c = 'type' and ct.v = coalesce(j.type, 'nan'))"""

SALES_COLS = "order_id, line_no, part_id, date, store_nbr, family, sales, onpromotion"


@query("scan_dates", f"select {SALES_COLS} from r_sales")
def scan_dates(t):
    """The sales fact with a parsed DateType column."""
    return fx.r_sales(t)


@query("scan_pruned", "select store_nbr, family, onpromotion from r_sales")
def scan_pruned(t):
    """S3: three-column projection; pruning reaches the parquet readers."""
    return fx.r_sales(t).select("store_nbr", "family", "onpromotion")


@query("oil_resample", "select date, dcoilwtico from oil_day", extra=OIL_CTES)
def oil_resample(t):
    """Oil resampled to every calendar day, carried forward from the
    latest observed row."""
    return fill.resample_daily_ffill(fx.r_oil(t))


@query("oil_filled", "select date, dcoilwtico from oil_f", extra=FACT_CTES)
def oil_filled(t):
    """Oil at each distinct fact date, forward- then back-filled."""
    facts = ft.union_fresh(ft.history(t), ft.fresh(fx.r_buffer(t)))
    return ft.oil_filled(facts, t)


@query("join_oil", f"""
select {SALES_COLS}, o.dcoilwtico from r_sales s left join oil_day o using (date)""", extra=OIL_CTES)
def join_oil(t):
    """Sales left join the resampled oil series."""
    return joins.join_oil(fx.r_sales(t), ft.oil_by_day(t))


@query("join_stores", f"""
select {SALES_COLS}, city, state, type from r_sales left join r_stores using (store_nbr)""")
def join_stores(t):
    """Sales left join stores."""
    return joins.join_stores(fx.r_sales(t), fx.r_stores(t))


@query("holidays_effective", "select date, locale from r_holidays where transferred = false")
def holidays_effective(t):
    """Holidays that were not transferred."""
    return fx.r_holidays(t).where(F.col("transferred") == F.lit(False)).select("date", "locale")


@query("join_holidays", f"""
select {SALES_COLS}, coalesce(h.is_holiday, 0) is_holiday
from r_sales left join (select date, 1 is_holiday from r_holidays where transferred = false) h using (date)""")
def join_holidays(t):
    """Sales left join effective holidays; k holidays on a day give k copies."""
    return joins.join_holidays(fx.r_sales(t), fx.r_holidays(t))


@query("join_holidays_dedup", f"""
select {SALES_COLS}, coalesce(h.is_holiday, 0) is_holiday
from r_sales left join (select distinct date, 1 is_holiday from r_holidays where transferred = false) h using (date)""")
def join_holidays_dedup(t):
    """J3 option: one flag per day, no fan-out."""
    return joins.join_holidays(fx.r_sales(t), fx.r_holidays(t), dedupe=True)


@query("join_transactions", f"""
select {SALES_COLS}, cast(coalesce(x.transactions, 0) as bigint) transactions
from r_sales left join r_transactions x using (date, store_nbr)""")
def join_transactions(t):
    """Sales left join transactions on (date, store); missing -> 0."""
    return joins.join_transactions(fx.r_sales(t), fx.r_transactions(t))


@query("calendar_features", f"""
select {SALES_COLS}, cast(isodow(date) - 1 as int) day_of_week, cast(month(date) as int) as month,
       cast(year(date) as int) as year, cast(day(date) as int) as day_of_month from r_sales""")
def calendar_features(t):
    """weekday (Monday = 0), month, year, day of month."""
    s = fx.r_sales(t)
    return s.withColumns(calendar_columns(F.col("date")))


@query("union_fresh", """
select order_id, line_no, part_id, msg_id, date, store_nbr, family, sales, onpromotion from facts""",
       extra=FACT_CTES)
def union_fresh(t):
    """History union buffered fresh rows by name; missing columns null."""
    return ft.union_fresh(ft.history(t), ft.fresh(fx.r_buffer(t))).select(
        *ft.ROW_KEYS, "date", "store_nbr", "family", "sales", "onpromotion")


@query("label_encode", "select c col, v value, code from codes", extra=FACT_CTES)
def label_encode(t):
    """Codes of family, city, state and type over the joined facts."""
    keys = ft.fact_keys(ft.facts_of(t))
    return ft.fit_feature_codes(t, keys, materialize=False)


@query("family_classes", "select v value, code from codes where c = 'family'", extra=FACT_CTES)
def family_classes(t):
    """A3: the sorted distinct families (the fitted classes)."""
    keys = ft.fact_keys(ft.facts_of(t))
    codes = ft.fit_feature_codes(t, keys, materialize=False)
    return encode.classes(codes, "family")


FEATURE_COLS = ("order_id, line_no, part_id, msg_id, date, store_nbr, family, sales, onpromotion, "
                "dcoilwtico, city, state, type, is_holiday, transactions, day_of_week, month, year, "
                "day_of_month, family_encoded, city_encoded, state_encoded, type_encoded")


@query("feature_table", f"select {FEATURE_COLS} from features", extra=FACT_CTES)
def feature_table(t):
    """C1 (flagship): the full feature table, 13 model features plus keys."""
    return ft.feature_table(t)


FEATURE_ARRAY = "[" + ", ".join(f"coalesce(cast({c} as double), 0.0)" for c in ft.FEATURES) + "]"


@query("feature_vector", f"select order_id, line_no, part_id, msg_id, {FEATURE_ARRAY} features from features",
       extra=FACT_CTES)
def feature_vector(t):
    """The 13 model features in fixed order, one vector per row (a
    missing value reads as 0), shown as an array of doubles."""
    from pyspark.ml.functions import vector_to_array

    from storecast.models.trees import assemble
    v = assemble(ft.feature_table(t))
    return v.select(*ft.ROW_KEYS, vector_to_array("features").alias("features"))


@query("time_split", """
select order_id, line_no, part_id, msg_id, date,
       case when date < date '2001-01-01' then 'train' else 'validate' end split from facts""",
       extra=FACT_CTES)
def time_split(t):
    """Train / validate split on the date."""
    facts = ft.union_fresh(ft.history(t), ft.fresh(fx.r_buffer(t)))
    return ft.with_split(facts).select(*ft.ROW_KEYS, "date", "split")


@query("daily_series", """
select date ds, cast(coalesce(sum(sales), 0) as decimal(38,4)) y,
       cast(avg(dcoilwtico) as decimal(18,2)) dcoilwtico, max(is_holiday) is_holiday
from joined group by date""", extra=FACT_CTES)
def daily_series(t):
    """A2: daily company series (sum sales, mean oil, max holiday)."""
    return ft.daily_series(ft.joined(t, transactions=False))


@query("encode_lookup", """
select r.store_nbr, r.family, r.date, cf.code family_encoded, cc.code city_encoded,
       cs.code state_encoded, ct.code type_encoded
from r_requests r left join r_stores s using (store_nbr)
left join codes cf on cf.c = 'family' and cf.v = coalesce(r.family, 'nan')
left join codes cc on cc.c = 'city' and cc.v = coalesce(s.city, 'nan')
left join codes cs on cs.c = 'state' and cs.v = coalesce(s.state, 'nan')
left join codes ct on ct.c = 'type' and ct.v = coalesce(s.type, 'nan')""", extra=FACT_CTES)
def encode_lookup(t):
    """Requests mapped to the fitted codes; an unseen value gives null
    (``strict=True`` fails instead)."""
    codes = ft.fit_feature_codes(t, ft.fact_keys(ft.facts_of(t)))
    req = joins.join_stores(fx.r_requests(t), fx.r_stores(t))
    out = encode.apply_codes(req, codes)
    return out.select("store_nbr", "family", "date", "family_encoded", "city_encoded",
                      "state_encoded", "type_encoded")


@query("store_lookup", """
select r.store_nbr, r.family, r.date, r.promo, s.city, s.state, s.type
from r_requests r left join r_stores s using (store_nbr)""")
def store_lookup(t):
    """The store dimension looked up for each request (checked broadcast)."""
    return joins.join_stores(fx.r_requests(t), fx.r_stores(t)).select(
        "store_nbr", "family", "date", "promo", "city", "state", "type")


@query("promo_uplift", """
select order_id, line_no, part_id, onpromotion,
       cast(round(case when onpromotion = 1 then sales * 1.5 else sales end, 2) as decimal(18,2)) uplifted
from r_sales""")
def promo_uplift(t):
    """x1.5 when onpromotion is exactly 1, rounded to cents."""
    from storecast.operators.scenario import promo_uplift as uplift
    s = fx.r_sales(t)
    return s.select("order_id", "line_no", "part_id", "onpromotion",
                    uplift(F.col("sales"), F.col("onpromotion")).alias("uplifted"))
