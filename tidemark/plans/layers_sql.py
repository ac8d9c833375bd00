"""The same results in SQL."""

from tidemark.plans.layers import CUBE
from tidemark.plans.problems_sql import SQL as _PROBLEMS
from tidemark.plans.problems_sql import _e8

_D = "cast(rate_text as decimal(28,12))"
_DEC = "cast(cast({0}.units as decimal(38,0)) as double) / pow(10, {0}.scale)"
_TRADE_RULES = {
    "complete": "delivery_id is not null and event_type is not null and event_id is not null and instrument_id is not null and event_time is not null and received_at is not null and available_at is not null and source is not null and trading_day is not null and session_id is not null and sequence is not null and price is not null and quantity is not null and aggressor_side is not null",
    "kind": "event_type = 'trade'",
    "text": "trim(event_id) <> '' and trim(instrument_id) <> '' and trim(source) <> '' and trim(session_id) <> ''",
    "clocks": "event_time <= received_at and received_at <= available_at",
    "positive": "price.units > 0 and quantity.units > 0",
    "side": "aggressor_side in ('buy', 'sell', 'unknown')",
}
_DELTA_RULES = {
    "complete": "action is not null and side is not null and instrument_id is not null and received_at is not null",
    "side": "side in ('bid', 'ask')",
    "sequence": "previous_sequence < sequence",
    "positive": "price.units > 0 and quantity.units >= 0",
    "clocks": "event_time <= received_at and received_at <= available_at",
    "action": "(action = 'delete' and quantity.units = 0) or (action = 'upsert' and quantity.units > 0)",
}


def _rules(table: str, rules: dict[str, str]) -> str:
    return " union all ".join(f"select source, '{n}' as rule, count(*) as n from {table} where not coalesce({r}, false) group by 1" for n, r in rules.items())


_BAD_TRADE = " or ".join(f"not coalesce({r}, false)" for r in _TRADE_RULES.values())
_HEX = "cast(('0x' || substr(claim_sha256, {0}, {1})) as {2})"

P3 = _PROBLEMS["p3_found"]

SQL = {
    "canonical_hashes": "select doc_id, sha256(cast(json_object('doc_id', doc_id, 'lang', lang, 'n_chars', n_chars, 'source', source) as varchar)) as sha256 from documents",
    "rounded_rates": f"""
select event_id, observed_at, captured_at, cast(floor({_D} * 1000) as bigint) as floor, cast(ceil({_D} * 1000) as bigint) as ceiling,
  cast(round({_D} * 1000) as bigint) as half_up, cast(round_even({_D} * 1000, 0) as bigint) as half_even,
  cast(floor({_D} * 1000) as bigint) as down, cast(ceil({_D} * 1000) as bigint) as up,
  cast({_D} * 100000000 as bigint) as exact from fx_rates""",
    "rate_nanos": """
select event_id, observed_at, epoch_ns(cast(observed_at as timestamptz)) as observed_ns,
  strftime(cast(available_at as timestamptz) at time zone 'UTC', '%Y-%m-%dT%H:%M:%S') || case when epoch_us(cast(available_at as timestamptz)) % 1000000 = 0 then '' else
    '.' || lpad(cast(epoch_us(cast(available_at as timestamptz)) % 1000000 as varchar), 6, '0') end || 'Z' as available_text from fx_rates""",
    "next_weekdays": """
select o_orderkey, strftime(d + case dayofweek(d) when 5 then 3 when 6 then 2 else 1 end, '%Y-%m-%d') as next
from (select o_orderkey, cast(o_orderdate as date) as d from orders)""",
    "fixed_values": f"""
select delivery_id, {_DEC.format('price')} as price, cast(cast(price.units as hugeint) * quantity.units as varchar) as units,
  cast(price.scale + quantity.scale as integer) as scale from market_trades""",
    "event_violations": _rules("market_trades", _TRADE_RULES),
    "delta_violations": _rules("book_deltas", _DELTA_RULES),
    "normalized_streams": f"""
with t as (select *, ({_BAD_TRADE}) as bad, count(*) over (partition by event_id) > 1 as twice,
  coalesce(sequence <= lag(sequence) over (partition by source, instrument_id, session_id order by sequence), false) as back from market_trades),
s as (select source, instrument_id, session_id, bool_or(bad or twice or back) as bad, count(*) as n from t group by 1, 2, 3)
select source, case when bad then 'rejected' else 'kept' end as part, cast(sum(n) as bigint) as n from s group by 1, 2""",
    "normalized_arrivals": f"""
with t as (select *, ({_BAD_TRADE}) as bad, event_id is not null and count(*) over (partition by event_id) > 1 as twice,
  coalesce(sequence <= lag(sequence) over (partition by source, instrument_id, session_id order by delivery_id), false) as back from market_trades),
s as (select *, bool_or(bad or back) over (partition by source, instrument_id, session_id) as broken from t)
select source, case when broken or twice then 'rejected' else 'kept' end as part, count(*) as n from s group by 1, 2""",
    "normalized_snapshot": f"""
with one as (select distinct instrument_id, source, session_id, sequence, {_e8('quantity')} as q from book_deltas)
select instrument_id, source, session_id, count(*) as n, max(sequence) as last, cast(sum(q) as bigint) as quantity_e8 from one group by 1, 2, 3""",
    "claim_shards": f"""
select substr(lower(event_id_hash), 1, 2) as shard, count(*) as rows, cast(sum({_HEX.format(1, 16, 'ubigint')}) as varchar) as total0,
  cast(sum({_HEX.format(49, 16, 'ubigint')}) as varchar) as total3, bit_xor({_HEX.format(1, 8, 'bigint')}) as mixed0,
  bit_xor({_HEX.format(57, 8, 'bigint')}) as mixed7 from claims group by 1""",
    "claim_conflicts": "select event_id, count(distinct lower(event_sha256)) as copies from claims where trim(event_id) <> '' group by 1 having count(distinct lower(event_sha256)) > 1",
    "book_best": f"""
with b as ({P3})
select instrument_id, source, session_id, cast(count(*) filter (where side = 'bid') as integer) as n_bids, cast(count(*) filter (where side = 'ask') as integer) as n_asks,
  max(price_e8) filter (where side = 'bid') as best_bid, min(price_e8) filter (where side = 'ask') as best_ask from b group by 1, 2, 3""",
    "intake_issues": """
with r as (select *, count(*) over (partition by symbol, effective_from) as n from catalog_snapshots)
select * from (
  select 'tick' as "column", 'type' as rule, count(*) as n from r where trim(price_tick) <> '' and try_cast(trim(price_tick) as double) is null
  union all select 'commission', 'type', count(*) from r where trim(commission_rate) <> '' and not regexp_full_match(trim(commission_rate), '[+-]?[0-9]+')
  union all select 'symbol', 'missing_key', count(*) from r where symbol is null
  union all select 'from', 'missing_key', count(*) from r where effective_from is null
  union all select 'symbol', 'duplicate_key', count(*) from r where n > 1 and symbol is not null and effective_from is not null) where n > 0""",
    "rate_asof": """
with r as (select base_currency || '/' || quote_currency as series_id, epoch_us(cast(observed_at as timestamptz)) as o, epoch_us(cast(available_at as timestamptz)) as a from fx_rates)
select series_id, max(o) as observed_us, arg_max(a, (o, a)) as available_us from r where a <= epoch_us(timestamptz '2024-03-08 12:00:00+00') group by 1""",
    "sql_view": CUBE.replace("event_trade", "market_trades"),
    "trade_bars_5m": f"""
with t as (select *, epoch_us(event_time) as us, {_e8('price')} as p, {_e8('quantity')} as q from market_trades where instrument_id is not null),
s as (select session_id, min(us) as opens from t group by 1),
b as (select *, opens + (us - opens) // 300000000 * 300000000 as start_us from t join s using (session_id))
select source, instrument_id, cast(trading_day as varchar) as trading_day, session_id, start_us, arg_min(p, (us, sequence, delivery_id)) as open, max(p) as high,
  min(p) as low, arg_max(p, (us, sequence, delivery_id)) as close, cast(sum(q) as bigint) as volume, count(*) as trades from b group by 1, 2, 3, 4, 5""",
    "partition_manifest": """
select source, cast(trading_day as varchar) as trading_day, count(*) as rows, min(epoch_us(event_time)) as first_us, max(epoch_us(event_time)) as last_us
from market_trades group by 1, 2""",
    "catalog_contiguity": """
with l as (select symbol, effective_from, arg_max(struct_pack(t := effective_to), (available_at, catalog_row_id)).t as t from instrument_catalog group by 1, 2),
n as (select *, lead(effective_from) over (partition by symbol order by effective_from) as f from l)
select symbol, epoch_us(effective_from) as from_us, epoch_us(f) as next_us from n where f is not null and t is distinct from f""",
}
