"""The fixture views of ``fixtures.py`` written as DuckDB SQL, for the oracle.

``with_views(body)`` prefixes a query body with the ``WITH`` clauses of every
``r_*`` view it (transitively) names.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}

VIEWS["r_sales"] = """
select l_orderkey order_id, l_linenumber line_no, l_partkey part_id,
       cast(o_orderdate as date) date, cast(l_suppkey as int) store_nbr, p_type family,
       cast(l_extendedprice*(1-l_discount) as decimal(18,4)) sales,
       cast(round(l_discount*100) as int) onpromotion
from lineitem join orders on l_orderkey=o_orderkey join part on l_partkey=p_partkey"""

VIEWS["r_stores"] = """
select cast(s_suppkey as int) store_nbr, n_name city, r_name state,
       chr(cast(65+s_suppkey%5 as int)) type
from supplier join nation on s_nationkey=n_nationkey join region on n_regionkey=r_regionkey"""

VIEWS["r_oil"] = """
select cast(o_orderdate as date) date,
       case when day(o_orderdate)=4 then null
            else cast(min(o_totalprice) as decimal(18,2)) end dcoilwtico
from orders where isodow(o_orderdate)-1 < 5
group by o_orderdate"""

VIEWS["r_holidays"] = """
select distinct cast(o_orderdate as date) date, 'National' locale,
       year(o_orderdate)%4=0 transferred
from orders where (month(o_orderdate)=1 and day(o_orderdate)=1)
               or (month(o_orderdate)=12 and day(o_orderdate) in (24,25))
union all
select distinct cast(o_orderdate as date), 'Local', false
from orders where month(o_orderdate)=12 and day(o_orderdate)=25"""

VIEWS["r_transactions"] = """
select cast(o_orderdate as date) date, cast(l_suppkey as int) store_nbr,
       count(distinct o_orderkey) transactions
from lineitem join orders on l_orderkey=o_orderkey
where l_suppkey%10<>3 group by 1,2"""

VIEWS["r_stream"] = """
select event_id msg_id,
       case when event_id%97=0 then null else event_type end family,
       case when event_id%101=0 then 'not-a-date' else strftime(ts,'%Y-%m-%d') end date,
       cast(user_id%100 as int) store_nbr,
       case when event_id%103=0 then null else cast(value as decimal(18,2)) end sales,
       cast(event_id%3 as int) onpromotion
from events"""

VIEWS["r_stream_wire"] = """
select msg_id, cast(date as varchar) date, cast(store_nbr as varchar) store_nbr,
       family, cast(sales as varchar) sales, cast(onpromotion as varchar) onpromotion
from r_stream"""

# typed view of the wire rows with the three validity flags
VIEWS["r_stream_checked"] = """
select *,
       coalesce(family <> '', false) and coalesce(date <> '', false) has_keys,
       case when regexp_full_match(date, '[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}')
            then cast(try_strptime(date, '%Y-%m-%d') as date) end pdate,
       sales is null or try_cast(sales as double) is not null sales_ok
from r_stream_wire"""

VIEWS["r_valid"] = """
select msg_id, date, store_nbr, family, sales, onpromotion, pdate
from r_stream_checked where has_keys and pdate is not null and sales_ok"""

VIEWS["r_buffer"] = """
select msg_id, to_json({'date': date, 'store_nbr': store_nbr, 'family': family,
                        'sales': sales, 'onpromotion': onpromotion}) payload
from r_valid"""

VIEWS["r_vector_records"] = """
select e.vec_id, e.embedding "values",
       cast(date '2001-07-01' + cast(e.vec_id % 31 as integer) as date) date,
       cast(e.vec_id % 100 as int) store_nbr,
       'FAMILY ' || cast(e.label as varchar) family,
       cast((e.vec_id % 97) * cast(10.25 as decimal(4,2)) as decimal(18,2)) sales,
       cast(e.vec_id % 3 as int) onpromotion,
       s.city, s.state
from embeddings e left join r_stores s on s.store_nbr = cast(e.vec_id % 100 as int)"""

VIEWS["r_vectors"] = """
select 'v' || cast(vec_id as varchar) id, "values", date, store_nbr, family, sales,
       city, state, onpromotion,
       'On ' || cast(date as varchar) || ', Store ' || cast(store_nbr as varchar)
       || case when city is not null then ' in ' || city else '' end
       || ' sold ' || family || ' with sales of $' || cast(cast(sales as decimal(18,2)) as varchar)
       || case when coalesce(onpromotion <> 0, true) then ' (on promotion)' else '' end text
from r_vector_records"""

VIEWS["r_questions"] = """
select conv_id * 1000 + turn qid, conv_id,
       text || case conv_id % 4
         when 0 then ' What about store ' || cast(conv_id % 100 as varchar) || '?'
         when 1 then ' What sold on 2001-07-' || lpad(cast(conv_id * 7 % 31 + 1 as varchar), 2, '0') || '?'
         when 2 then ' Sales in Store  ' || cast(conv_id % 100 as varchar) || ' on 2001-07-'
                     || lpad(cast(conv_id * 7 % 31 + 1 as varchar), 2, '0') || '?'
         else '' end text
from conversations where role = 'user'"""

VIEWS["r_question_vectors"] = """
select q.qid, q.text, e.embedding qvec
from r_questions q left join embeddings e on q.conv_id = e.vec_id"""

VIEWS["r_requests"] = """
select distinct store_nbr, family, cast(date + interval 7 day as date) date,
       cast(onpromotion > 5 as int) promo
from r_sales"""

VIEWS["r_scenarios"] = """
select * from (values ('baseline', 45.0::double, 1500, 0, 0),
                      ('oil_shock', 110.0::double, 1500, 0, 0),
                      ('promo_push', 45.0::double, 1500, 1, 0),
                      ('holiday_rush', 60.0::double, 4000, 1, 1))
       t(scenario, oil, transactions, promo, holiday)"""

_NAME = re.compile(r"\b(r_[a-z_]+)\b")


def _deps(sql: str) -> list[str]:
    return [n for n in dict.fromkeys(_NAME.findall(sql)) if n in VIEWS]


def with_views(body: str, extra: str = "") -> str:
    """``WITH`` every r_* view named in ``body`` (and what they name), then
    the optional ``extra`` CTEs (text after a comma), then the body."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for d in _deps(VIEWS[name]):
            if d != name:
                visit(d)
        order.append(name)

    for n in _deps(body + " " + extra):
        visit(n)
    ctes = [f"{n} as ({VIEWS[n]}\n)" for n in order]
    if extra.strip():
        ctes.append(extra.strip())
    if not ctes:
        return body
    return "with " + ",\n".join(ctes) + "\n" + body
