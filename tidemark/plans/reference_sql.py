"""The same results in SQL."""

_PIT = """
with o as (select event_id, user_id, ts from events where event_type = 'purchase'),
f as (select user_id, ts as seen, event_id as click_id, value from events where event_type = 'click'),
j as (select o.event_id, o.user_id, o.ts, f.seen, f.click_id, f.value from o asof left join f on o.user_id = f.user_id and o.ts >= f.seen)
"""
_TWO = """
with o as (select o_orderkey, o_custkey, cast(o_orderdate as date) as day, cast(o_orderdate as date) + 45 as at from orders),
f as (select o_custkey, o_orderkey as k, day as e, day + cast(o_orderkey % 30 as integer) as a from o),
j as (select o.o_orderkey, max(struct_pack(e := f.e, a := f.a, k := f.k)) as w from o join f on o.o_custkey = f.o_custkey and f.e <= o.at and f.a <= o.at group by 1)
"""
_VERSIONS = """
with one as (select o_custkey, cast(o_orderdate as date) as day, max(o_orderkey) as version from orders group by 1, 2),
v as (select *, lead(day) over (partition by o_custkey order by day) as until from one)
"""


def _bars(day: str, start: str, end: str, keys: str) -> str:
    return f"""
with t as (select event_type as instrument_id, ts, epoch_us(ts) as us, event_id, cast(value as decimal(18,4)) as price, {day} as day from events),
b as (select instrument_id, {keys} arg_min(price, (ts, event_id)) as o, max(price) as h, min(price) as l, arg_max(price, (ts, event_id)) as c,
  count(*) as n, max(us) as last_us from t group by all)
select instrument_id, cast(o as double) as open, cast(h as double) as high, cast(l as double) as low, cast(c as double) as close,
  cast(n as double) as volume, n as trades, {start} as start_us, {end} as end_us, greatest({end}, last_us + 1000) as available_us from b"""


_EVENT_BAR = """
b as (select instrument_id, bar, arg_min(price, (ts, event_id)) as o, max(price) as h, min(price) as l, arg_max(price, (ts, event_id)) as c,
  count(*) as n, min(us) as first_us, max(us) as end_us from numbered group by 1, 2),
s as (select *, coalesce(lag(end_us) over (partition by instrument_id order by bar), first_us) as start_us from b)
select instrument_id, cast(o as double) as open, cast(h as double) as high, cast(l as double) as low, cast(c as double) as close,
  cast(n as double) as volume, n as trades, start_us, end_us, end_us + 1000 as available_us from s"""
_HOURS = _bars("cast(ts as date)", "slot", "slot + 3600000000", "us - us % 3600000000 as slot,")
_DAYS = _bars("cast(ts as date)", "epoch_us(cast(day as timestamp))", "epoch_us(cast(day + 1 as timestamp))", "day,")
_LEVELS = """
levels as (select o_orderpriority as symbol, cast(o_orderdate as date) as date, max(cast(round(o_totalprice * 100) as bigint)) / 100.0 as close from orders group by 1, 2)
"""
_GRID = """
with p as (select distinct o_orderpriority as symbol, cast(o_orderdate as date) as date from orders),
d as (select distinct date from p), s as (select distinct symbol from p)
"""
_REVISED = """
with o as (select o_orderkey, o_orderstatus, o_orderpriority, cast(round(o_totalprice * 100) as bigint) as cents from orders),
old as (select * from o where o_orderpriority <> '1-URGENT'),
new as (select o_orderkey, o_orderstatus, o_orderpriority, case when o_orderstatus = 'P' then cents + 100 else cents end as cents from o where o_orderpriority <> '5-LOW')
"""
_TWICE = "with k as (select l_orderkey, l_linenumber, count(*) as copies from lineitem group by 1, 2 having count(*) > 1)"

SQL = {
    "pit_join": _PIT + "select event_id, user_id, epoch_us(seen) as source_us, click_id, value from j",
    "pit_join_max_age": _PIT + """
select event_id, user_id, case when ok then epoch_us(seen) end as source_us, case when ok then click_id end as click_id, case when ok then value end as value
from (select *, ts <= seen + interval 6 hours as ok from j)""",
    "pit_audit": _PIT + """
select count(*) as rows, count(seen) as matched_rows, count(*) filter (where seen > ts) as unavailable_rows,
  count(*) filter (where ts > seen + interval 6 hours) as stale_rows from j""",
    "two_clock_asof": _TWO + "select o.o_orderkey, w.k as fact_key from o left join j using (o_orderkey)",
    "two_clock_max_age": _TWO + "select o.o_orderkey, case when o.at <= w.e + 60 then w.k end as fact_key from o left join j using (o_orderkey)",
    "bitemporal_join": _VERSIONS + """
select o_orderkey, version from orders o left join v on o.o_custkey = v.o_custkey and v.day <= cast(o_orderdate as date) + 10
  and (until is null or cast(o_orderdate as date) + 10 < until) and v.day <= cast(o_orderdate as date) + 20""",
    "mapping_resolver": _VERSIONS + """
select o_orderkey, version from orders o join v on o.o_custkey = v.o_custkey and v.day <= cast(o_orderdate as date) + 1
  and (until is null or cast(o_orderdate as date) + 1 < until)""",
    "bitemporal_conflicts": _VERSIONS + """
select distinct b.o_custkey, epoch_us(cast(b.day as timestamp)) as from_us from one a join one b
  on a.o_custkey = b.o_custkey and a.day < b.day and b.day < a.day + 90 and b.day < a.day + 120""",
    "lifecycle_filter": """
with l as (select p_partkey, date '1993-01-01' + cast(p_partkey % 1000 as integer) as a, p_size from part)
select l_partkey as symbol, count(*) as n, cast(sum(cast(l_quantity as bigint)) as bigint) as quantity from lineitem join l on l_partkey = p_partkey
where cast(l_shipdate as date) >= a and (p_size <= 10 or cast(l_shipdate as date) <= a + 1500) group by 1""",
    "latest_per_key": "select user_id, event_type, arg_max(event_id, (ts, event_id)) as event_id, arg_max(value, (ts, event_id)) as value from events group by 1, 2",
    "asof_view": "select user_id as symbol, arg_max(event_id, ts) as event_id from events where event_type = 'click' and ts + interval 1 hour <= timestamp '2024-01-15' group by 1",
    "fixed_bars_1h": _HOURS,
    "session_bars": _DAYS,
    "day_bars": _DAYS,
    "count_bars": """
with t as (select event_type as instrument_id, ts, epoch_us(ts) as us, event_id, cast(value as decimal(18,4)) as price,
  (row_number() over (partition by event_type order by ts, event_id) - 1) // 50 as bar from events),
numbered as (select * from t qualify count(*) over (partition by instrument_id, bar) = 50),""" + _EVENT_BAR,
    "amount_bars": """
with recursive t as (select event_type as instrument_id, ts, epoch_us(ts) as us, event_id, cast(value as decimal(18,4)) as price,
  cast(floor(cast(value as decimal(18,4))) as bigint) as a, row_number() over (partition by event_type order by ts, event_id) as n from events),
walk as (
  select instrument_id, n, cast(0 as bigint) as bar, a as held from t where n = 1
  union all
  select t.instrument_id, t.n, w.bar + (w.held >= 5000)::bigint, case when w.held >= 5000 then 0 else w.held end + t.a
  from walk w join t on t.instrument_id = w.instrument_id and t.n = w.n + 1),
numbered as (select t.*, bar from t join walk using (instrument_id, n) qualify max(held) over (partition by instrument_id, bar) >= 5000),""" + _EVENT_BAR,
    "rolling_compound": """
with d as (select event_type, cast(ts as date) as day, cast(sum(cast(value as decimal(18,4))) / 100000 as double) as r from events group by 1, 2)
select event_type, strftime(day, '%Y-%m-%d') as day, case when count(*) over w = 5 then round(exp(sum(ln(1 + r)) over w) - 1, 6) end as compound
from d window w as (partition by event_type order by day rows between 4 preceding and current row)""",
    "total_return": f"""
with {_LEVELS},
s as (select *, (close + case when dayofyear(date) = 100 then 500 else 0 end) / lag(close) over (partition by symbol order by date) as step from levels)
select symbol, strftime(date, '%Y-%m-%d') as date, round(100 * exp(sum(coalesce(ln(step), 0)) over (partition by symbol order by date)), 4) as return_close from s""",
    "forward_labels": f"""
with {_LEVELS},
g as (select date, row_number() over (order by date) as n from (select distinct date from levels)),
p as (select symbol, l.date, close, n from levels l join g using (date)),
q as (select a.symbol, a.date, a.n, a.close, e.date as label_end,
  (select count(*) from p b where b.symbol = a.symbol and b.n between a.n and a.n + 5 and b.date <= date '2001-01-01') as seen,
  (select c.close from p c where c.symbol = a.symbol and c.n = a.n + 5) as last from p a left join g e on e.n = a.n + 5),
r as (select *, coalesce(label_end <= date '2001-01-01', false) as mature, case when label_end <= date '2001-01-01' and seen = 6 then last / close - 1 end as v from q)
select symbol || '/' || strftime(date, '%Y-%m-%d') as sample_id, strftime(label_end, '%Y-%m-%d') as label_end, round(v, 8) as ret,
  case when not mature then 'immature' when v is not null then 'observed' else 'missing_price' end as status,
  round(coalesce(v, case when mature then -1.0 end), 8) as lower, round(coalesce(v, case when mature then 1.0 end), 8) as upper from r""",
    "ttm_facts": """
with q as (select p_brand as b, date_trunc('quarter', cast(l_shipdate as date))::date as s, sum(cast(round(l_extendedprice * 100) as bigint)) as v
  from lineitem join part on l_partkey = p_partkey group by 1, 2),
k as (select b, s, (s + interval 3 months)::date - 1 as e, v from q where (s + interval 3 months)::date + 30 <= date '1998-06-01'),
r as (select *, row_number() over (partition by b order by e desc) as n, lag(s) over (partition by b order by e desc) as following from k),
t as (select b, min(s) as s, max(e) as e, sum(v) as v, count(*) as c, bool_and(following is null or following = e + 1) as ok from r where n <= 4 group by 1)
select b as instrument_id, strftime(s, '%Y-%m-%d') as period_start, strftime(e, '%Y-%m-%d') as period_end, cast(v as bigint) as value from t
where c = 4 and ok and e - s + 1 between 330 and 380 and date '1998-06-01' - e <= 200""",
    "coverage_gaps": _GRID + "select symbol, strftime(date, '%Y-%m-%d') as date from (select symbol, date from s cross join d except select symbol, date from p)",
    "calendar_coverage": _GRID + """
select symbol, (select count(*) from d) as expected_days, count(*) as observed_days, (select count(*) from d) - count(*) as missing_days,
  round(((select count(*) from d) - count(*)) / (select count(*) from d), 8) as missing_ratio from p group by 1""",
    "price_frame_stats": f"""
with h as ({_HOURS})
select count(*) as rows, count(distinct instrument_id) as symbols, cast(0 as double) as missing_ratio, cast(0 as bigint) as infinite,
  count(*) filter (where least(open, high, low, close) <= 0) as nonpositive, cast(0 as bigint) as negative_volume,
  count(*) filter (where high < greatest(open, close, low) or low > least(open, close, high)) as invalid_bars,
  cast(0 as bigint) as invalid_dates, cast(0 as bigint) as duplicates from h""",
    "provider_compare": """
with a as (select o_orderkey as k, o_totalprice as p from orders where o_orderstatus <> 'P'),
b as (select o_orderkey as k, o_totalprice * (1 + o_orderkey % 7 / 100) as s from orders where o_orderpriority <> '5-LOW')
select count(*) filter (where p is not null and s is not null) as both, count(*) filter (where s is null) as primary_only,
  count(*) filter (where p is null) as shadow_only, round(max(abs(s - p) / abs(p)), 8) as max_relative, round(median(abs(s - p) / abs(p)), 8) as median_relative
from a full join b using (k)""",
    "discrepancies": """
with r as (select l_partkey, l_returnflag, l_quantity, row_number() over (partition by l_partkey, l_returnflag
  order by l_shipdate desc, concat_ws('/', l_orderkey, l_linenumber, l_suppkey, l_quantity) desc) as n from lineitem where l_shipdate <= timestamp '1997-01-01')
select l_partkey as instrument_id, count(*) as sources, round(max(l_quantity) - min(l_quantity), 4) as spread, 'value_disagreement' as reason
from r where n = 1 group by 1 having count(*) > 1 and max(l_quantity) - min(l_quantity) > 5""",
    "upsert_merged": _REVISED + "select o_orderkey, cents from old where o_orderkey not in (select o_orderkey from new) union all select o_orderkey, cents from new",
    "upsert_revisions": _REVISED + "select o_orderkey from old join new using (o_orderkey) where old.cents <> new.cents",
    "version_diff": _REVISED + """
select o_orderkey, case when old.cents is null then 'added' when new.cents is null then 'removed' when old.cents = new.cents then 'unchanged' else 'changed' end as change
from old full join new using (o_orderkey)""",
    "multiset_added": _REVISED + """
select o_orderstatus, o_orderpriority, cents // 1000000 as m from new except all select o_orderstatus, o_orderpriority, cents // 1000000 from old""",
    "dup_events": _TWICE + " select * from k",
    "dup_copies": _TWICE + " select l_orderkey, count(*) as n, cast(sum(cast(l_quantity as bigint)) as bigint) as quantity from lineitem join k using (l_orderkey, l_linenumber) group by 1",
    "sequence_gaps": """
with r as (select l_orderkey, l_linenumber, lag(l_linenumber) over (partition by l_orderkey order by l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity) as p from lineitem)
select l_orderkey, count(*) as breaks from r where l_linenumber <= p group by 1""",
    "quarantined": """
with b as (select distinct l_orderkey from lineitem where l_discount >= 0.1),
r as (select l.l_orderkey, case when b.l_orderkey is null then 'accepted' else 'rejected' end as part from lineitem l left join b using (l_orderkey))
select part, count(*) as n, count(distinct l_orderkey) as streams from r group by 1""",
    "event_union": """
select event_id, 'event' as schema_id, event_type, cast(null as bigint) as cents from events
union all select o_orderkey, 'order', null, cast(round(o_totalprice * 100) as bigint) from orders""",
    "look_through": """
with n as (select r_name, n_name, count(*) over (partition by r_name) as children from region join nation on n_regionkey = r_regionkey),
h as (select distinct n_name, c_mktsegment from nation join customer on c_nationkey = n_nationkey),
l as (
  select c_mktsegment as instrument_id, 'disclosed' as reason, 0.2 * 0.2 * 0.1 as w from n join h using (n_name)
  union all
  select 'UNKNOWN:' || n_name, 'undisclosed', 0.2 * 0.2 * (1 - 0.1 * count(*)) from n join h using (n_name) group by 1
  union all
  select 'UNKNOWN:' || n_name, 'missing_disclosure', 0.2 * 0.2 from n where n_name not in (select n_name from h)
  union all
  select 'UNKNOWN:' || r_name, 'undisclosed', 0.2 * (1 - 0.2 * max(children)) from n group by 1 having max(children) <> 5)
select instrument_id, reason, cast(sum(w) as double) as weight, count(*) as n from l group by 1, 2""",
    "impacted_nodes": """
with s as (select distinct l_suppkey from lineitem join part on l_partkey = p_partkey where p_size = 1)
select 's' || l_suppkey as node from s union select 'n' || s_nationkey from s join supplier on s_suppkey = l_suppkey""",
    "unit_normalise": """
select l_orderkey, 'shares' as volume_unit, 'currency' as amount_unit, 'USD' as currency, cast(sum(cast(l_quantity as bigint)) * 100 as bigint) as volume,
  cast(sum(cast(round(l_extendedprice) as bigint)) * 1000 as bigint) as amount from lineitem group by 1""",
    "multiset_hash": """
with h as (select sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') as s from nation)
select count(*) as rows, cast(sum(cast(('0x' || s[1:16]) as ubigint)) as varchar) as h0, cast(sum(cast(('0x' || s[17:32]) as ubigint)) as varchar) as h1,
  cast(sum(cast(('0x' || s[33:48]) as ubigint)) as varchar) as h2, cast(sum(cast(('0x' || s[49:64]) as ubigint)) as varchar) as h3,
  bit_xor(cast(('0x' || s[1:8]) as bigint)) as x0, bit_xor(cast(('0x' || s[57:64]) as bigint)) as x7 from h""",
    "session_lookup": "select event_id, case when hour(ts) between 9 and 15 then strftime(ts, '%Y%m%d') end as session_id from events",
    "next_open": """
with s as (select distinct cast(ts as date) + interval 9 hours as opens from events)
select event_id, (select min(epoch_us(opens)) from s where opens >= ts) as next_us from events""",
    "settlement_t1": """
with d as (select distinct cast(o_orderdate as date) as day from orders where dayofweek(o_orderdate) between 1 and 5),
o as (select distinct cast(o_orderdate as date) as day from orders),
n as (select o.day, min(d.day) as settles from o left join d on d.day > o.day group by 1)
select o_orderkey, strftime(settles, '%Y-%m-%d') as settles from orders join n on cast(o_orderdate as date) = n.day""",
    "adjusted_prices": f"""
with {_LEVELS},
e as (select *, lag(close) over (partition by symbol order by date) as before from levels),
a as (select symbol, date as ex, (before - 100) / (before * 2) as f from e where dayofyear(date) = 100 and before is not null)
select symbol, strftime(date, '%Y-%m-%d') as date,
  round(close * coalesce((select exp(sum(ln(f))) from a where a.symbol = l.symbol and a.ex > l.date), 1), 2) as close from levels l""",
    "price_violations": """
with r as (select l_discount as o, l_tax as h from lineitem)
select * from (select 'positive' as rule, count(*) as n from r where not (o > 0 and h > 0) union all
select 'bounds', count(*) from r where not (h >= greatest(o, h) and o <= least(o, h))) where n > 0""",
}
