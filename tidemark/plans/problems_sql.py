"""The same results in SQL, for queries that SQL can express."""

E8 = "cast({0}.units * pow(10::decimal(30,0), 8 - {0}.scale) as bigint)"
_TRIM = "trim({0}, ' ' || chr(9) || chr(10) || chr(13))"
_US = "epoch_us({0})"


def _e8(column: str) -> str:
    return f"cast(round(cast({column}.units as decimal(38,8)) * cast(pow(10, 8 - {column}.scale) as decimal(20,0))) as bigint)".replace("round(", "(")


P2 = f"""
with rows as (
  select t.*, {_TRIM.format('t.event_id')} as mid,
    ltrim(regexp_replace(lower({_TRIM.format('c.event_sha256')}), '^0x', ''), '0') as sha
  from market_trades t left join claims c using (delivery_id)),
ranked as (
  select *, row_number() over (partition by mid, sha order by received_at nulls last, delivery_id) as n from rows
  where mid <> '' and sha is not null)
"""

P6_ROWS = P2 + """,
kept as (
  select * from market_trades where instrument_id is not null and delivery_id not in (select delivery_id from ranked where n > 1)),
counted as (
  select *, epoch_us(event_time) - epoch_us(event_time) % 1800000000 as bar_start_us from kept),
known as (
  select *, case when epoch_us(available_at) - bar_start_us - 1860000000 <= 0 then 0
    else (epoch_us(available_at) - bar_start_us - 1860000000 + 3599999999) // 3600000000 end as version
  from counted where epoch_us(available_at) <= bar_start_us + 1800000000 + 21600000000)
"""

SQL = {
    "p1_found": """
with r as (select 'market_trades' as table_name, instrument_id from market_trades
  union all select 'curated_partitions', instrument_id from curated_partitions),
t as (select table_name, count(*) as total from r group by 1)
select r.table_name, instrument_id from r join t using (table_name) where instrument_id is not null
group by 1, 2, total having count(*) * 100 > 3 * total""",
    "p1_totals": f"""
select instrument_id, count(*) as n_trades, cast(sum({_e8('quantity')}) as bigint) as volume_e8,
  min(epoch_us(event_time)) as first_us, max(epoch_us(event_time)) as last_us
from market_trades where instrument_id is not null group by 1""",
    "p1_bars": f"""
select instrument_id, epoch_us(event_time) - epoch_us(event_time) % 1800000000 as bar_start_us, count(*) as n_trades,
  max({_e8('price')}) as high_e8, min({_e8('price')}) as low_e8, cast(sum({_e8('quantity')}) as bigint) as volume_e8
from market_trades where instrument_id is not null and event_time is not null group by 1, 2""",
    "p1_ohlc": f"""
select instrument_id, epoch_us(event_time) - epoch_us(event_time) % 1800000000 as bar_start_us, count(*) as n_trades,
  arg_min({_e8('price')}, (epoch_us(event_time), sequence, delivery_id)) as open_e8, max({_e8('price')}) as high_e8, min({_e8('price')}) as low_e8,
  arg_max({_e8('price')}, (epoch_us(event_time), sequence, delivery_id)) as close_e8, cast(sum({_e8('quantity')}) as bigint) as volume_e8
from market_trades where instrument_id is not null and event_time is not null group by 1, 2""",
    "p1_partitions": """
select instrument_id, count(*) as n_partitions, cast(sum("rows") as bigint) as total_rows
from curated_partitions where instrument_id is not null group by 1""",
    "p2_found": P2 + "select delivery_id from ranked where n > 1",
    "p2_incremental": P2 + "select delivery_id from ranked where n > 1",
    "p3_found": f"""
with changes as (
  select distinct instrument_id, source, session_id, sequence, lower(trim(side)) as side,
    coalesce(lower(trim(action)), '') as action, {_e8('price')} as price_e8, {_e8('quantity')} as quantity_e8
  from book_deltas),
snap as (
  select instrument_id, source, session_id, max(sequence) as sequence from book_snapshots group by 1, 2, 3),
levels as (
  select distinct s.instrument_id, s.source, s.session_id, s.sequence, b.side, unnest(b.levels) as level
  from book_snapshots s join snap using (instrument_id, source, session_id, sequence),
  lateral (select 'bid' as side, s.bids as levels union all select 'ask', s.asks) b),
every_one as (
  select instrument_id, source, session_id, sequence, side, {_e8('level.price')} as price_e8,
    {_e8('level.quantity')} as quantity_e8 from levels
  union all
  select c.instrument_id, c.source, c.session_id, c.sequence, side, price_e8,
    case when action = 'delete' then 0 else quantity_e8 end
  from changes c left join snap s using (instrument_id, source, session_id)
  where s.sequence is null or c.sequence > s.sequence),
ends as (
  select instrument_id, source, session_id, side, price_e8, arg_max(quantity_e8, sequence) as quantity_e8
  from every_one group by 1, 2, 3, 4, 5)
select * from ends where quantity_e8 <> 0""",
    "p4_found": """
with c as (
  select symbol, effective_from, effective_to, available_at, catalog_row_id, settlement_currency,
    lead(available_at) over (partition by symbol, effective_from order by available_at, catalog_row_id desc) as replaced_at
  from instrument_catalog),
hit as (
  select delivery_id, event_time, c.*, row_number() over (partition by delivery_id order by c.effective_from desc) as n
  from market_trades t join c on split_part(t.instrument_id, ':', 3) = c.symbol
    and c.effective_from <= t.event_time and (c.effective_to is null or t.event_time < c.effective_to)
    and c.available_at <= t.event_time and (c.replaced_at is null or t.event_time < c.replaced_at)),
fx as (
  select base_currency, event_id, cast(observed_at as timestamptz) as observed, cast(available_at as timestamptz) as available
  from fx_rates where quote_currency = 'USD' and base_currency <> 'USD'),
cut as (
  select *, min(greatest(observed, available)) over (partition by base_currency order by observed desc, available desc, event_id
    rows between unbounded preceding and 1 preceding) as until
  from fx)
select delivery_id, catalog_row_id, coalesce(event_id, '') as fx_event_id
from (select * from hit where n = 1) h left join cut on settlement_currency = base_currency
  and greatest(observed, available) <= event_time and (until is null or event_time < until)""",
    "p5_found": """
with rec as (
  select upper(trim(symbol)) as symbol, epoch_us(effective_from) as t, epoch_us(available_at) as a, record_id,
    upper(trim(venue)) as venue, try_cast(trim(price_tick) as decimal(38,18)) as p, lot_size as l,
    try_cast(trim(commission_rate) as decimal(38,18)) as c, try_cast(trim(stamp_duty_rate) as decimal(38,18)) as s,
    try_cast(trim(price_limit_rate) as decimal(38,18)) as r
  from catalog_snapshots where trim(symbol) <> ''),
one as (
  select * from (select *, row_number() over (partition by symbol, t order by a desc, record_id desc) as n from rec) where n = 1),
times as (select distinct epoch_us(effective_from) as t from catalog_snapshots where record_kind = 'snapshot'),
span as (select symbol, min(t) as first_t from one group by 1),
axis as (
  select symbol, t, struct_pack(v := venue, p := p, l := l, c := c, s := s, r := r) as v, true as there from one
  union all
  select symbol, x.t, null, false from span join times x on x.t > first_t
  where not exists (select 1 from one o where o.symbol = span.symbol and o.t = x.t)),
marked as (
  select *, lag(v) over w as before, lag(there) over w as was from axis window w as (partition by symbol order by t)),
edges as (
  select symbol, t, there, lead(t) over (partition by symbol order by t) as next_t
  from marked where (there and (was is null or not was or before is distinct from v)) or (not there and was))
select symbol, t as effective_from_us, coalesce(next_t, 0) as effective_to_us from edges where there""",
    "p6_found": P6_ROWS + """
select instrument_id, session_id, bar_start_us, arg_max(sequence, struct_pack(e := event_time, s := sequence)) as close_sequence
from known group by 1, 2, 3 having max(version) > 0""",
    "p6_deltas": P6_ROWS + f""",
parts as (
  select instrument_id, session_id, bar_start_us, cast(version as integer) as version, count(*) as n,
    sum({_e8('quantity')}) as q, max(struct_pack(e := event_time, s := sequence)) as c from known group by 1, 2, 3, 4),
state as (
  select instrument_id, session_id, bar_start_us, version, cast(sum(n) over w as bigint) as trades,
    cast(sum(q) over w as bigint) as volume_e8, (max(c) over w).s as close_sequence
  from parts window w as (partition by instrument_id, session_id, bar_start_us order by version)),
moves as (
  select *, lag(trades) over w as o1, lag(volume_e8) over w as o2, lag(close_sequence) over w as o3
  from state window w as (partition by instrument_id, session_id, bar_start_us order by version))
select instrument_id, session_id, bar_start_us, version, 1 as sign, trades, volume_e8, close_sequence from state
union all
select instrument_id, session_id, bar_start_us, version, -1, o1, o2, o3 from moves where o1 is not null""",
}
