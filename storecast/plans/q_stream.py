"""Registered queries that run the streaming job end to end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from storecast.operators import events as ev
from storecast.session import work_path
from storecast.sources import fixtures as fx
from storecast.streaming import counters as sc
from storecast.streaming import state as st
from storecast.plans.catalog import query
from storecast.plans.q_events import COUNTER_SQL


def _run(t):
    root = work_path(t.spark, "stream", uuid.uuid4().hex)
    source = f"{root}/source"
    sc.append_events(fx.r_stream_wire(t), source)
    sc.run_once(t.spark, source, root)
    return root


@query("stream_counters", COUNTER_SQL)
def stream_counters(t):
    """The event table fed through the checkpointed stream job; the
    counters read back equal the batch ``counter_rollup``."""
    return sc.read_counters(t.spark, _run(t))


@query("stream_buffer")
def stream_buffer(t):
    """S10 via the stream: the buffered JSON payloads (file sink)."""
    return sc.read_buffer(t.spark, _run(t))


@query("stream_buffer_rows", """
select msg_id, try_cast(payload->>'store_nbr' as int) store_nbr, payload->>'family' family,
       try_cast(payload->>'sales' as decimal(18,2)) sales from r_buffer""")
def stream_buffer_rows(t):
    """S10 via the stream: the buffered payloads, decoded."""
    d = F.from_json("payload", ev.PAYLOAD_SCHEMA)
    return sc.read_buffer(t.spark, _run(t)).select(
        "msg_id", d["store_nbr"].try_cast("int").alias("store_nbr"), d["family"].alias("family"),
        d["sales"].try_cast("decimal(18,2)").alias("sales"))


@query("stream_restart", COUNTER_SQL)
def stream_restart(t):
    """The events arrive in two halves with a stop and a restart
    between them, and a third run finds nothing new; each event counts once."""
    root = work_path(t.spark, "stream", uuid.uuid4().hex)
    source = f"{root}/source"
    wire = fx.r_stream_wire(t)
    half = F.pmod(F.xxhash64("msg_id"), F.lit(2)) == 0
    for part in (wire.where(half), wire.where(~half)):
        sc.append_events(part, source)
        sc.run_once(t.spark, source, root)
    sc.run_once(t.spark, source, root)
    return sc.read_counters(t.spark, root)


@query("buffer_drain", """
select msg_id, payload->>'family' family from r_buffer where msg_id % 3 <> 0""")
def buffer_drain(t):
    """What a second drain returns after a consumer took every third id."""
    root = _run(t)
    fresh, marks = sc.drain_buffer(t.spark, root)
    sc.commit_mark(fresh.where(F.col("msg_id") % 3 == 0), marks)
    rest, _ = sc.drain_buffer(t.spark, root)
    return rest.select("msg_id", F.get_json_object("payload", "$.family").alias("family"))


PARTS, KEPT = 4, 700


def _in_parts(t, root: str, **kw) -> None:
    """The events in several appends, each followed by a run."""
    source, wire = f"{root}/source", fx.r_stream_wire(t)
    for k in range(PARTS):
        sc.append_events(wire.where(F.pmod(F.xxhash64("msg_id"), F.lit(PARTS)) == k), source)
        sc.run_once(t.spark, source, root, **kw)


@query("stream_trim", f"select msg_id, payload->>'family' family from r_buffer order by msg_id desc limit {KEPT}")
def stream_trim(t):
    """The live buffer, trimmed after every batch to the newest messages."""
    root = work_path(t.spark, "stream", uuid.uuid4().hex)
    _in_parts(t, root, keep=KEPT)
    return sc.read_buffer(t.spark, root).select("msg_id", F.get_json_object("payload", "$.family").alias("family"))


@query("stream_snapshot", COUNTER_SQL)
def stream_snapshot(t):
    """The counters from a snapshot and the batch folders after it."""
    root = work_path(t.spark, "stream", uuid.uuid4().hex)
    _in_parts(t, root, snapshot_every=2)
    return sc.read_counters(t.spark, root)


@query("stream_reclaimed", COUNTER_SQL)
def stream_reclaimed(t):
    """The counters after older snapshots and batch folders were removed."""
    root = work_path(t.spark, "stream", uuid.uuid4().hex)
    _in_parts(t, root, snapshot_every=1)
    return sc.read_counters(t.spark, root)


MIDDLE, DELAY = "2024-01-20", "36 hours"


def _periods(t, late: bool, repeats: bool):
    """Two runs of the keyed counters: events up to the middle day first, later
    ones (and, if asked, late or repeated ones) after it."""
    root = work_path(t.spark, "stream", uuid.uuid4().hex)
    source, wire = f"{root}/source", fx.r_stream_wire(t)
    old = F.coalesce(F.col("date") <= MIDDLE, F.lit(True))
    held = F.lit(late) & (F.col("msg_id") % 5 == 0)
    second = ~old | held
    if repeats:
        second = second | (F.col("msg_id") % 3 == 0)
    for part in (wire.where(old & ~held), wire.where(second)):
        sc.append_events(part, source)
        st.run_once(t.spark, sc.read_events(t.spark, source), root, DELAY)
    return st.read_periods(t.spark, root)


def _period_ctes(late: bool) -> str:
    held = "msg_id % 5 = 0" if late else "false"
    return f"""
e as (select msg_id, family, pdate::timestamp ts, coalesce(cast(sales as decimal(18,2)), 0) s,
                  date <= '{MIDDLE}' and not ({held}) first from r_valid),
w as (select max(ts) filter (first) - interval '{DELAY}' w1, max(ts) - interval '{DELAY}' w2 from e),
k as (select e.* from e, w where first or ts > w1),
p as (select 'daily' grain, family, strftime(ts, '%Y-%m-%d') period, ts + interval 1 day ends, s from k
      union all
      select 'weekly', family, strftime(ts, '%Y-W%U'), least(date_trunc('week', ts + interval 1 day) + interval 6 day,
             make_timestamp(year(ts) + 1, 1, 1, 0, 0, 0)), s from k
      union all
      select 'monthly', family, strftime(ts, '%Y-%m'), date_trunc('month', ts) + interval 1 month, s from k)"""


PERIOD_SQL = """
select grain, family, period, cast(sum(s) as decimal(38,2)) as value, count(*) n_events,
       case when ends <= w2 then 'closed' else 'open' end status
from p, w group by grain, family, period, ends, w2"""


@query("stream_expired", PERIOD_SQL, extra=_period_ctes(False))
def stream_expired(t):
    """2.9: keyed state with timers; periods behind the watermark are closed."""
    return _periods(t, late=False, repeats=False)


@query("stream_late", PERIOD_SQL, extra=_period_ctes(True))
def stream_late(t):
    """2.9: late events still count while the watermark has not passed them."""
    return _periods(t, late=True, repeats=False)


@query("stream_duplicates", PERIOD_SQL, extra=_period_ctes(False))
def stream_duplicates(t):
    """2.9: messages delivered again count once."""
    return _periods(t, late=False, repeats=True)
