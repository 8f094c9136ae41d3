"""Registered queries: boosted trees, trend models, scoring and what-if runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storecast.models import boost, changepoints, trees, trend
from storecast.operators import encode, joins
from storecast.operators import scenario as sc
from storecast.plans import features as ft
from storecast.plans.catalog import query
from storecast.plans.q_features import FACT_CTES
from storecast.plans.q_report import GRID_SQL, grid_targets
from storecast.session import work_path
from storecast.sources import fixtures as fx
from storecast.sources.tables import Tables

P = trees.SOURCE_PARAMS
FORECAST_DAYS = 30
_CACHE: dict[tuple, object] = {}


def _key(t: Tables, name: str) -> tuple:
    return (t.spark.sparkContext.applicationId, t.sf_dir, name)


def training_frame(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The feature table with its split, written once as columns (the trees read
    some of them many times), and the fitted code table."""
    k = _key(t, "features")
    if k not in _CACHE:
        facts = ft.facts_of(t)
        keys = ft.fact_keys(facts)
        stores = ft.checked_stores(t)
        codes = ft.fit_feature_codes(t, keys, stores)
        j = ft.joined(t, facts, keys=keys, stores=stores)
        table = ft.with_split(encode.apply_codes(j, codes))
        path = work_path(t.spark, "training", uuid.uuid4().hex)
        table.write.parquet(path)
        table = t.spark.read.schema(table.schema).parquet(path)
        _CACHE[k] = (table, codes)
    return _CACHE[k]


def fitted(t: Tables):
    """M1/M2: boosted model with patience on the validation split (cached per
    session and input, as the source caches its loaded model)."""
    k = _key(t, "gbt")
    if k not in _CACHE:
        table, _ = training_frame(t)
        train = table.where(F.col("split") == "train")
        val = table.where(F.col("split") == "validate")
        _CACHE[k] = boost.fit(train, val, P["max_iter"], P["step"], P["depth"], P["patience"])
    return _CACHE[k]


@query("mae", """
select cast(avg(abs(cast(v.sales as double) - m.pred)) as decimal(18,4)) mae, count(*) n
from r_sales v join (select family, avg(cast(sales as double)) pred from r_sales
                     where date < date '2001-01-01' group by family) m using (family)
where v.date >= date '2001-01-01'""")
def mae(t):
    """A5: mean absolute error of a given prediction column (here the
    family's mean training sales) on the validation split."""
    s = fx.r_sales(t)
    split = F.lit(ft.SPLIT_DATE).cast("date")
    means = s.where(F.col("date") < split).groupBy("family").agg(
        F.avg(F.col("sales").cast("double")).alias("pred"))
    v = s.where(F.col("date") >= split).join(means, "family")
    return v.agg(F.avg(F.abs(F.col("sales").cast("double") - F.col("pred"))).cast("decimal(18,4)").alias("mae"),
                 F.count(F.lit(1)).alias("n"))


@query("gbt_fit_score")
def gbt_fit_score(t):
    """Validation rows scored by the boosted model (clipped at 0)."""
    table, _ = training_frame(t)
    model, _, _ = fitted(t)
    val = table.where(F.col("split") == "validate")
    return trees.score(model, val).select(*ft.ROW_KEYS, "date", "store_nbr", "family",
                                          "sales", "prediction")


@query("gbt_early_stop")
def gbt_early_stop(t):
    """M2: validation error after each round and the round kept."""
    _, errors, best = fitted(t)
    rows = [(i + 1, float(e), i == best) for i, e in enumerate(errors)]
    return t.spark.createDataFrame(rows, "round int, val_mse double, is_best boolean")


VALIDATED = f"from features where date >= date '{ft.SPLIT_DATE}' or date is null"


@query("gbt_scored_rows", f"""
select order_id, line_no, part_id, msg_id, true scored {VALIDATED}""", extra=FACT_CTES)
def gbt_scored_rows(t):
    """M1/M3: which validation rows got a prediction of at least 0."""
    return gbt_fit_score(t).select(*ft.ROW_KEYS, F.coalesce(F.col("prediction") >= 0, F.lit(False)).alias("scored"))


@query("gbt_report", f"""
select count(*) n_rows, count(sales) n_labelled, 0::bigint n_unscored, true fits_better, 1 n_best, true patience_kept
{VALIDATED}""", extra=FACT_CTES)
def gbt_report(t):
    """M1-M3: validation rows scored, whether the training rows' mean squared error
    is below that of their mean, and whether the round kept follows from the patience rule."""
    model, errors, best = fitted(t)
    table, _ = training_frame(t)
    y = F.col("sales").cast("double")
    train = table.where((F.col("split") == "train") & y.isNotNull())
    fit = model.transform_columns(train).agg(
        (F.avg((y - F.col("prediction")) ** 2) < F.var_pop(y)).alias("fits_better"))
    kept = best == trees.best_round(errors, P["patience"]) and (
        len(errors) == P["max_iter"] or best + P["patience"] < len(errors) <= best + P["patience"] + boost.BLOCK)
    rows = gbt_fit_score(t).agg(
        F.count("*").alias("n_rows"), F.count("sales").alias("n_labelled"),
        F.count_if(F.col("prediction").isNull()).alias("n_unscored"),
        F.lit(sum(i == best for i in range(len(errors)))).alias("n_best"), F.lit(bool(kept)).alias("patience_kept"))
    return rows.join(F.broadcast(fit))            # one row each


_FEATURES = ", ".join(f"coalesce(cast({c} as double), 0.0) as {c}" for c in ft.FEATURES)
FIRST_SPLIT_SQL = f"""
tr as (select cast(sales as double) y, {_FEATURES} from features where date < date '{ft.SPLIT_DATE}' and sales is not null),
u as (unpivot tr on {", ".join(ft.FEATURES)} into name feature value v),
tot as (select count(*) n, sum(y) / count(*) base from tr),
b as (select feature, v, count(*) n, sum(base - y) g from u, tot group by feature, v),
c as (select feature, v threshold, coalesce(sum(n) over w, 0) nl, coalesce(sum(g) over w, 0) gl from b
      window w as (partition by feature order by v rows between unbounded preceding and 1 preceding)),
e as (select feature, threshold, nl, tot.n - nl nr, gl * gl / (nl + 1) + gl * gl / (tot.n - nl + 1) gain
      from c, tot where nl > 0)"""


@query("gbt_first_split", """
select feature, threshold, cast(nl as bigint) n_left, cast(nr as bigint) n_right, round(gain / 1e6, 2) gain_m
from e order by gain desc limit 1""", extra=FACT_CTES + "," + FIRST_SPLIT_SQL)
def gbt_first_split(t):
    """M1: the first split of the first tree and the rows on either side."""
    table, _ = training_frame(t)
    s = boost.first_split(table.where(F.col("split") == "train"))
    return t.spark.createDataFrame([s], "feature string, threshold double, n_left bigint, n_right bigint, gain_m double")


def request_features(t: Tables) -> DataFrame:
    """scoring rows from the requests, with default regressors and codes."""
    _, codes = training_frame(t)
    r = joins.join_stores(fx.r_requests(t), fx.r_stores(t))
    r = r.select("store_nbr", "family", "date", "promo", "city", "state", "type",
                 F.col("promo").alias("onpromotion"),
                 F.lit(sc.DEFAULT_TRANSACTIONS).alias("transactions"),
                 F.lit(sc.DEFAULT_OIL).alias("dcoilwtico"),
                 F.lit(sc.DEFAULT_HOLIDAY).alias("is_holiday"))
    from storecast.functions.calendar import calendar_columns
    return encode.apply_codes(r.withColumns(calendar_columns(F.col("date"))), codes)


@query("score_requests")
def score_requests(t):
    """M3: predicted sales of every (store, family, date, promo) request."""
    model, _, _ = fitted(t)
    out = trees.score(model, request_features(t))
    return out.select("store_nbr", "family", "date", "promo", "prediction", "reason")


@query("score_requests_rows", """
select r.store_nbr, r.family, r.date, r.promo, s.store_nbr is not null known_store from r_requests r
left join r_stores s using (store_nbr)""")
def score_requests_rows(t):
    """M3: the requests that were answered; a store without labels is named as
    the reason and not scored."""
    out = score_requests(t)
    return out.select("store_nbr", "family", "date", "promo",
                      (F.col("prediction").isNotNull() & F.col("reason").isNull()).alias("known_store"))


@query("scenario_run_rows", f"select distinct store_nbr, family, scenario from ({GRID_SQL})")
def scenario_run_rows(t):
    """M4: the (store, family, scenario) triples compared."""
    return scenario_run(t).select("store_nbr", "family", "scenario")


@query("scenario_run")
def scenario_run(t):
    """M4: baseline vs scenario predictions over 7 days for every target and
    scenario, summed and compared (A7)."""
    model, _, _ = fitted(t)
    _, codes = training_frame(t)
    # The codes follow from the store and the family: they are joined before the grid multiplies the rows.
    targets, start = grid_targets(t)
    targets = encode.apply_codes(joins.join_stores(targets, fx.r_stores(t)), codes)
    scored = trees.score(model, sc.scenario_features(sc.scenario_grid(targets, start, fx.SCENARIOS)))
    tot = scored.groupBy("store_nbr", "family", "scenario").agg(
        F.sum(F.when(F.col("branch") == "baseline", F.col("prediction"))).alias("total_base"),
        F.sum(F.when(F.col("branch") == "scenario", F.col("prediction"))).alias("total_scenario"))
    return sc.impact(tot)


def series_frame(t: Tables) -> DataFrame:
    """Daily series per family plus the company total ``ALL`` (one pass over
    the joined facts; the total is summed from the per-family rows, sales
    without a family included)."""
    j = ft.joined(t, transactions=False)
    fam = j.groupBy(F.col("family").alias("series"), F.col("date").alias("ds")).agg(
        F.coalesce(F.sum("sales"), F.lit(0)).cast("double").alias("y"),
        F.avg("dcoilwtico").cast("double").alias("dcoilwtico"),
        F.max("is_holiday").alias("is_holiday"))
    total = fam.groupBy("ds").agg(F.sum("y").alias("y"), F.avg("dcoilwtico").alias("dcoilwtico"),
                                  F.max("is_holiday").alias("is_holiday"))
    # One row per (series, day): bounded by the calendar.  The fits, the
    # backtest and the future frame all read it, so it is cut from its lineage
    # once instead of recomputing the fact joins for each reader.
    return fam.where(F.col("series").isNotNull()).unionByName(total.withColumn("series", F.lit("ALL"))).checkpoint(eager=True)


@query("trend_fit")
def trend_fit(t):
    """M5: one trend+seasonality model per series, fitted on the train split."""
    s = series_frame(t).where(F.col("ds") < F.lit(ft.SPLIT_DATE).cast("date"))
    return trend.fit(s).select("series", "t0", "t_days", "n_obs", "sigma",
                               F.size("beta").alias("n_coef"))


SERIES_DAYS = FACT_CTES + """,
days as (select distinct family series, date ds from joined where family is not null
         union select distinct 'ALL', date from joined)"""


@query("trend_fit_spans", """
select series, min(ds) t0, cast(greatest(date_diff('day', min(ds), max(ds)), 1) as double) t_days, count(*) n_obs
from days where ds < date '2001-01-01' group by series""", extra=SERIES_DAYS)
def trend_fit_spans(t):
    """M5: first day, span and days of every fitted series."""
    s = series_frame(t).where(F.col("ds") < F.lit(ft.SPLIT_DATE).cast("date"))
    return trend.fit(s).select("series", "t0", "t_days", F.col("n_obs").cast("bigint").alias("n_obs"))


@query("trend_backtest_rows", """
select series, count(*) n_val from days where ds >= date '2001-01-01' group by series""", extra=SERIES_DAYS)
def trend_backtest_rows(t):
    """Days scored per series by the backtest."""
    return trend.backtest(series_frame(t), ft.SPLIT_DATE).select("series", "n_val")


@query("trend_backtest")
def trend_backtest(t):
    """Hold-out MAE per series (fit before the split date, score after)."""
    return trend.backtest(series_frame(t), ft.SPLIT_DATE)


@query("trend_forecast")
def trend_forecast(t):
    """M6: refit on all days, forecast history + 30 days with an 80 % band."""
    s = series_frame(t)
    coefs = trend.fit(s)
    rows = trend.future_frame(s, FORECAST_DAYS, by="series")
    return trend.predict(rows, coefs)


@query("trend_changes", f"""
select series, count(*) n_obs, true at_minimum, true sparse from days where ds < date '{ft.SPLIT_DATE}' group by series""",
       extra=SERIES_DAYS)
def trend_changes(t):
    """M5: sparse trend changes per series; whether the coefficients satisfy the
    conditions of the penalised minimum, and leave possible changes unused."""
    s = series_frame(t).where(F.col("ds") < F.lit(ft.SPLIT_DATE).cast("date"))
    return changepoints.fit(s).select("series", "n_obs", (F.col("slack") < 1e-6).alias("at_minimum"),
                                      (F.col("n_changes") < trend.N_HINGES).alias("sparse"))


@query("trend_intervals", f"""
select series, ds, true inside from days
union all
select series, cast(d0 + cast(i as integer) as date), true from (select series, max(ds) d0 from days group by series),
       range(1, {FORECAST_DAYS + 1}) r(i)""", extra=SERIES_DAYS)
def trend_intervals(t):
    """M6: history and 30 days ahead with intervals from simulated slope changes."""
    s = series_frame(t)
    rows = trend.future_frame(s, FORECAST_DAYS, by="series")
    p = changepoints.predict(rows, changepoints.fit(s))
    return p.select("series", "ds", ((F.col("yhat_lower") <= F.col("yhat")) & (F.col("yhat") <= F.col("yhat_upper"))).alias("inside"))
