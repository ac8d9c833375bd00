"""One query for each operator that no other query shows alone, over whole tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import instants, values
from tidemark.functions.fixed import fixed_e8
from tidemark.operators import asof, finance, lifecycle, quality
from tidemark.plans.problems_sql import _e8
from tidemark.sources import exchange, lake, records
from tidemark.sources.shared import table


def _day(c: str) -> Column:
    return F.col(c).cast("date")


def _text(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd").alias(c)


def _at(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def canonical_bars(spark: SparkSession, d: str) -> DataFrame:
    names = {"date": "l_shipdate", "open": "l_extendedprice", "high": "l_extendedprice", "low": "l_extendedprice", "close": "l_extendedprice", "volume": "l_quantity", "amount": "l_tax"}
    out = exchange.canonical_prices(table(spark, d, "lineitem"), symbol="X", provider="p", volume_multiplier=100.0, amount_multiplier=1000.0, columns=names)
    return out.select(_text("date"), "symbol", "close", "volume", "amount", "provider")


def volume_units(spark: SparkSession, d: str) -> DataFrame:
    each = F.col("l_extendedprice") / F.col("l_quantity")
    bars = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("symbol"), _day("l_shipdate").alias("date")).agg(F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("amount"), F.min(each).alias("low"), F.max(each).alias("high"))
    bars = bars.withColumns({"volume": F.when(F.col("symbol") % 3 == 1, F.col("volume") / 100).otherwise(F.col("volume")), "amount": F.when(F.col("symbol") % 3 == 2, F.col("amount") * 7).otherwise(F.col("amount"))})
    return exchange.lots_or_shares(bars)


def lagged_disclosures(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("symbol"), F.col("o_orderkey").alias("date"), "o_totalprice")
    return exchange.disclosure_lag(rows, "o_totalprice")


def relative_strength(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("industry"), _day("o_orderdate").alias("date"))
    own = o.groupBy("industry", "date").agg(((F.count("*") % 5 - 2) / 100.0).alias("industry_return"))
    base = o.groupBy("date").agg(((F.count("*") % 3 - 1) / 100.0).alias("benchmark_return"))
    out = finance.industry_relative_strength(own.select("industry", "date"), own, base, window=5)
    return out.select("industry", _text("date"), F.round("relative_strength", 9).alias("relative_strength"))


def merged_distributions(spark: SparkSession, d: str) -> DataFrame:
    ex = _day("l_shipdate")
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("symbol"), ex.alias("ex_date"), F.date_sub(ex, 3).alias("announced_date"), F.date_sub(ex, 1).alias("record_date"), F.date_add(ex, 5).alias("pay_date"), F.col("l_linenumber").cast("double").alias("cash_per_ten"), (F.col("l_linenumber") % 2).cast("double").alias("shares_per_ten"))
    return finance.merge_distributions(rows).select("symbol", _text("ex_date"), _text("pay_date"), "cash_per_share", "share_ratio")


def catalog_entry(spark: SparkSession, d: str) -> DataFrame:
    out = lake.catalog_entry(table(spark, d, "orders"), "orders", date="o_orderdate", symbol="o_custkey")
    return out.select("dataset", "rows", "symbols", _text("first"), _text("last"))


def share_entitlements(spark: SparkSession, d: str) -> DataFrame:
    rule = F.element_at(F.array(F.lit("floor"), F.lit("ceil"), F.lit("exact")), F.col("l_linenumber") % 3 + 1)
    shares = values.share_quantity(F.col("l_quantity").cast("long"), F.col("l_linenumber"), F.lit(7), rule)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", shares.cast("long").alias("shares"))


def normal_symbols(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    six = values.six_digit_symbol(F.concat(F.lit(" sz"), key, F.lit(".XX")))
    return table(spark, d, "part").select("p_partkey", six.alias("six"), values.exchange_symbol(F.concat(F.substring(key, 1, 1), F.substring(six, 2, 5))).alias("listed"), values.five_digit_symbol(key).alias("five"), values.four_digit_hk(key).alias("hk"), values.us_symbol(F.lower(F.get(F.split("p_type", " "), 0))).alias("us"), values.us_symbol(F.col("p_brand")).alias("none"))


def trading_permissions(spark: SparkSession, d: str) -> DataFrame:
    v = F.coalesce("value", F.lit(0.0))
    rows = table(spark, d, "events").select(F.col("user_id").alias("instrument_id"), F.col("event_type").alias("source"), F.col("ts").alias("effective_from"), (F.col("ts") + F.expr("interval 20 days")).alias("effective_to"), (F.col("ts") + F.expr("interval 1 hour")).alias("available_at"), F.when(v > 50, "yes").otherwise("no").alias("buy_status"), F.when(v > 5, "yes").otherwise("no").alias("sell_status"), F.col("event_type").alias("reason"), F.col("event_id").alias("evidence_id"))
    return asof.permission_asof(rows, _at("2024-01-20"), _at("2024-01-19")).select("instrument_id", "buy", "sell", "reason")


def data_coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.to_date("ts").alias("date"), F.col("user_id").alias("symbol"))
    first, last = rows.agg(F.min("date"), F.max("date")).first()
    return quality.coverage(rows).select("rows", "symbols", _text("first"), _text("last"), F.lit(quality.covers_range(rows, first, last)).alias("covers"), F.date_format(F.lit(quality.incremental_start(rows, first)), "yyyy-MM-dd").alias("next"))


def exchange_trades(spark: SparkSession, d: str) -> DataFrame:
    """Trades as an exchange would send them, read back."""
    number = lambda c: values.fixed_value(F.col(c)).cast("string")
    message = {"e": F.lit("trade"), "s": F.col("instrument_id"), "t": F.col("sequence").cast("string"), "T": F.unix_millis("event_time").cast("string"), "E": F.unix_millis("available_at").cast("string"), "p": number("price"), "q": number("quantity"), "m": F.when(F.col("aggressor_side") == "sell", "true").when(F.col("aggressor_side") == "buy", "false")}
    lines = table(spark, d, "market_trades").where("instrument_id is not null").select(F.to_json(F.struct(*[c.alias(n) for n, c in message.items()])).alias("value"))
    out = exchange.diff_depth_events(lines, price_scale=8, quantity_scale=8).where("event_type = 'trade'")
    return out.select("symbol", "sequence", F.unix_millis("event_time").alias("event_ms"), F.col("price.units").alias("price_e8"), F.col("quantity.units").alias("quantity_e8"), "aggressor_side")


def exchange_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Changes of book levels as updates of one level each, read back."""
    number = lambda c: F.when(F.col(c).isNotNull(), values.fixed_value(F.col(c)).cast("string"))
    side = F.lower(F.trim("side"))
    level = F.array(F.array(number("price"), number("quantity")))
    empty = F.array().cast("array<array<string>>")
    fields = [F.lit("depthUpdate").alias("e"), F.col("instrument_id").alias("s"), F.unix_millis("event_time").alias("T"), F.unix_millis("available_at").alias("E"), F.col("sequence").alias("U"), F.col("sequence").alias("u"), F.col("previous_sequence").alias("pu"), F.when(side == "bid", level).otherwise(empty).alias("b"), F.when(side == "ask", level).otherwise(empty).alias("a")]
    rows = table(spark, d, "book_deltas").where("instrument_id is not null and sequence is not null")
    out = exchange.diff_depth_events(rows.select("received_at", F.to_json(F.struct(*fields)).alias("value")), price_scale=8, quantity_scale=8).where("event_type = 'book_delta'")
    return out.select("symbol", "sequence", "side", F.col("price.units").alias("price_e8"), F.col("quantity.units").alias("quantity_e8"), "action")


def membership_days(spark: SparkSession, d: str) -> DataFrame:
    """Days of each month's first on which a customer was a member, from today's list undone backwards."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("symbol"), _day("o_orderdate").alias("date"), F.when(F.col("o_orderstatus") == "F", "remove").otherwise("add").alias("action"), "o_orderkey")
    events = asof.latest(orders, ["symbol", "date"], ["o_orderkey"]).drop("o_orderkey")
    last = asof.latest(events, ["symbol"], ["date"]).where("action = 'add'").select("symbol")
    days = orders.select(F.trunc("date", "month").alias("date")).distinct()
    still = table(spark, d, "customer").select(F.col("c_custkey").alias("symbol")).join(orders.select("symbol").distinct(), "symbol", "left_anti")
    return quality.membership_by_replay(last.unionByName(still), events, days).groupBy("symbol").agg(F.count("*").alias("days"))


def known_facts(spark: SparkSession, d: str) -> DataFrame:
    month = F.trunc(_day("o_orderdate"), "month")
    end = F.last_day(month)
    known = F.timestamp_micros(F.unix_micros(F.date_add(end, 2).cast("timestamp")) + F.col("o_orderkey") * 1_000_000)
    facts = table(spark, d, "orders").select(F.col("o_custkey").alias("instrument_id"), F.col("o_orderpriority").alias("concept"), F.lit("u").alias("unit"), month.alias("period_start"), end.alias("period_end"), known.alias("available_at"), F.col("o_orderkey").alias("accession"), F.col("o_totalprice").alias("value"))
    return asof.facts_asof(facts, _at("1996-01-01")).select("instrument_id", "concept", _text("period_end"), "accession", "value")


def universe_members(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select(F.col("user_id").alias("instrument_id"), F.to_date("ts").alias("session"), F.col("ts").alias("known_at"), "event_id", (F.col("event_type") == "click").alias("member"))
    return asof.members_asof(events, F.lit("2024-01-15").cast("date"), _at("2024-01-15 12:00:00")).select("instrument_id", "event_id")


def forecast_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("forecast_type"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_partkey") % 60).cast("int")).alias("announce_date"))
    out = lifecycle.forecast_scores(rows, [("BRASS", 1.0), ("TIN", 0.5), ("ECONOMY", -1.0)], F.lit("2024-01-05").cast("date"), F.lit("2024-02-20").cast("date"))
    return out.select("p_partkey", "forecast_score", _text("effective_date"))


def nominal_intervals(spark: SparkSession, d: str) -> DataFrame:
    minute = F.date_trunc("minute", "ts")
    ends = {}
    for rounding in ("truncate", "half_up", "half_even"):
        start, end, _ = instants.nominal_interval(minute, "minute", rounding)
        ends |= {f"{rounding}_from": F.unix_micros(start), f"{rounding}_to": F.unix_micros(end)}
    return table(spark, d, "events").select("event_id", *[c.alias(n) for n, c in ends.items()], instants.admits(F.col("ts"), minute, F.lit(False)).alias("admitted"))


def zone_instants(spark: SparkSession, d: str) -> DataFrame:
    """Local times of a zone with summer time, an hour of each order's day."""
    local = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + (F.col("o_orderkey") % 24) * 3_600_000_000)
    at = instants.local_to_utc(local, "America/New_York")
    return table(spark, d, "orders").select("o_orderkey", F.unix_micros(at["at"]).alias("at_us"), at["status"].alias("status"))


def _distributions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ex = _day("o_orderdate")
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k.cast("string").alias("event_id"), F.col("o_custkey").cast("string").alias("instrument_id"), (k % 3 - (k % 50 == 0).cast("int") * 5).alias("cash_per_share"), F.when(k % 4 == 0, "1.5").otherwise("1").alias("share_ratio"), F.date_sub(ex, 1).alias("record_date"), ex.alias("ex_date"), F.when(k % 7 != 0, F.date_add(ex, 9)).alias("pay_date"), F.when(k % 11 == 0, F.date_add(ex, 2)).otherwise(ex).alias("shares_available_date"), F.col("o_orderdate").alias("captured_at"), F.lit("s").alias("source"))
    return records.distribution_terms(rows)


def distribution_terms(spark: SparkSession, d: str) -> DataFrame:
    return _distributions(spark, d)[0].select("event_id", "instrument_id", "kind", F.date_format("effective_at", "yyyy-MM-dd").alias("effective"), F.col("cash_per_unit").cast("double"), F.col("ratio").cast("double"), _text("entitlement_date"))


def distribution_violations(spark: SparkSession, d: str) -> DataFrame:
    return _distributions(spark, d)[1].groupBy("rule").agg(F.count("*").alias("n"))


def traded_rows(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("l_extendedprice")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("long") % 5).alias("volume"), c.alias("open"), c.alias("high"), F.when(F.col("l_linenumber") == 3, 0.0).otherwise(c).alias("low"), c.alias("close"))
    traded, idle, wrong = records.traded_rows(rows, ["l_orderkey", "l_linenumber"])
    count = lambda df, part: df.groupBy("l_linenumber").agg(F.count("*").alias("n")).select("l_linenumber", F.lit(part).alias("part"), "n")
    return count(traded, "traded").unionByName(count(idle, "untraded")).unionByName(count(wrong, "wrong"))


def _indexed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "market_trades").where("instrument_id is not null").select("instrument_id", F.col("delivery_id").alias("trade_seq"), F.col("event_time").alias("traded_at"), fixed_e8(F.col("price")).alias("price"), F.lit(3).alias("index_price"), fixed_e8(F.col("quantity")).alias("amount"))
    return records.indexed_days(rows, slice_rows=5000)


def indexed_days(spark: SparkSession, d: str) -> DataFrame:
    return _indexed(spark, d)[0].select("instrument", _text("day"), "open", "high", "low", "close", "amount", "trades")


def indexed_breaks(spark: SparkSession, d: str) -> DataFrame:
    return _indexed(spark, d)[1].select("instrument", "seq", "before")


def first_words_contiguity(spark: SparkSession, d: str) -> DataFrame:
    """Versions that do not end where their symbol's next one begins, of the first word on each: ends were published later."""
    rows = table(spark, d, "instrument_catalog").where("available_at is not null").select("symbol", "effective_from", "effective_to", (-F.unix_micros("available_at")).alias("_first"), (-F.col("catalog_row_id")).alias("_id"))
    first = asof.latest(rows, ["symbol", "effective_from"], ["_first", "_id"])
    return quality.contiguous_versions(first, ["symbol"]).select("symbol", F.unix_micros("effective_from").alias("from_us"), F.unix_micros("next_start").alias("next_us"))


def rounded_rest(spark: SparkSession, d: str) -> DataFrame:
    rate = F.col("rate_text")
    return table(spark, d, "fx_rates").select("event_id", "observed_at", "captured_at", *[values.fixed_from_text(rate, 2, mode)["units"].alias(f"mode_{mode}") for mode in ("half_down", "05up")])


QUERIES = {
    f.__name__: f
    for f in (
        canonical_bars, volume_units, lagged_disclosures, relative_strength, merged_distributions, catalog_entry, share_entitlements, normal_symbols, trading_permissions, data_coverage, exchange_trades, exchange_deltas,
        membership_days, known_facts, universe_members, forecast_scores, nominal_intervals, zone_instants, distribution_terms, distribution_violations, traded_rows, indexed_days, indexed_breaks, first_words_contiguity, rounded_rest,
    )
}

_DIST = """with o as (select cast(o_orderkey as varchar) as event_id, cast(o_custkey as varchar) as instrument_id, o_orderkey as k, cast(o_orderdate as date) as ex,
  o_orderkey % 3 - case when o_orderkey % 50 = 0 then 5 else 0 end as cash, case when o_orderkey % 4 = 0 then 1.5 else 1 end as ratio from orders),
r as (select *, cash < 0 as amounts, cash <= 0 and ratio = 1 as no_terms, cash > 0 and k % 7 = 0 as pay_date, ratio <> 1 and k % 11 = 0 as deferred_shares from o)
"""
_INDEXED = f"with t as (select instrument_id as instrument, delivery_id as seq, event_time as traded, {_e8('price')} * 3 as v, {_e8('quantity')} as q from market_trades where instrument_id is not null)"

SQL = {
    "first_words_contiguity": """
with l as (select symbol, effective_from, arg_min(struct_pack(t := effective_to), (available_at, catalog_row_id)).t as t from instrument_catalog where available_at is not null group by 1, 2),
n as (select *, lead(effective_from) over (partition by symbol order by effective_from) as f from l)
select symbol, epoch_us(effective_from) as from_us, epoch_us(f) as next_us from n where f is not null and t is distinct from f""",
    "rounded_rest": """
with r as (select *, cast(rate_text as decimal(28,12)) * 100 as x from fx_rates)
select event_id, observed_at, captured_at, cast(ceil(x - 0.5) as bigint) as mode_half_down, cast(case when x > floor(x) and cast(floor(x) as bigint) % 5 = 0 then floor(x) + 1 else floor(x) end as bigint) as mode_05up from r""",
    "canonical_bars": "select strftime(l_shipdate, '%Y-%m-%d') as date, 'X' as symbol, l_extendedprice as close, l_quantity * 100.0 as volume, l_tax * 1000.0 as amount, 'p' as provider from lineitem",
    "volume_units": """
with b as (select l_partkey as symbol, cast(l_shipdate as date) as date, sum(l_quantity) as v, sum(l_extendedprice) as a, min(l_extendedprice / l_quantity) as low, max(l_extendedprice / l_quantity) as high from lineitem group by 1, 2),
c as (select symbol, date, low, high, case when symbol % 3 = 1 then v / 100 else v end as v, case when symbol % 3 = 2 then a * 7 else a end as a, row_number() over (partition by symbol order by date desc) as n from b)
select symbol, case when bool_and(a / v between low * 0.95 and high * 1.05) then 'shares' when bool_and(a / (v * 100) between low * 0.95 and high * 1.05) then 'lots' end as unit from c where n <= 5 group by 1""",
    "lagged_disclosures": "select * from (select o_custkey as symbol, o_orderkey as date, lag(o_totalprice) over (partition by o_custkey order by o_orderkey) as o_totalprice from orders) where o_totalprice is not null",
    "relative_strength": """
with i as (select o_orderpriority as industry, cast(o_orderdate as date) as date, (count(*) % 5 - 2) / 100.0 as r from orders group by 1, 2),
b as (select cast(o_orderdate as date) as date, (count(*) % 3 - 1) / 100.0 as r from orders group by 1),
x as (select industry, date, case when count(*) over w = 5 then product(1 + r) over w - 1 end as v from i window w as (partition by industry order by date rows 4 preceding)),
y as (select date, case when count(*) over w = 5 then product(1 + r) over w - 1 end as v from b window w as (order by date rows 4 preceding))
select industry, strftime(date, '%Y-%m-%d') as date, round(x.v - y.v, 9) as relative_strength from x left join y using (date)""",
    "merged_distributions": """
select l_partkey as symbol, strftime(cast(l_shipdate as date), '%Y-%m-%d') as ex_date, strftime(cast(l_shipdate as date) + 5, '%Y-%m-%d') as pay_date,
  cast(sum(l_linenumber) as double) / 10 as cash_per_share, 1 + cast(sum(l_linenumber % 2) as double) / 10 as share_ratio from lineitem group by 1, 2, 3""",
    "catalog_entry": "select 'orders' as dataset, count(*) as rows, count(distinct o_custkey) as symbols, strftime(min(o_orderdate), '%Y-%m-%d') as first, strftime(max(o_orderdate), '%Y-%m-%d') as last from orders",
    "share_entitlements": """
select l_orderkey, l_linenumber, case l_linenumber % 3 when 0 then p // 7 when 1 then (p + 6) // 7 else case when p % 7 = 0 then p // 7 end end as shares
from (select l_orderkey, l_linenumber, cast(l_quantity as bigint) * l_linenumber as p from lineitem)""",
    "normal_symbols": """
select p_partkey, lpad(k, 6, '0') as six, case when k[1] in ('5', '6', '9') then 'sh' else 'sz' end || k[1] || substr(lpad(k, 6, '0'), 2, 5) as listed, lpad(k, 5, '0') as five, lpad(k, 4, '0') || '.HK' as hk,
  upper(split_part(p_type, ' ', 1)) as us, cast(null as varchar) as none from (select *, cast(p_partkey as varchar) as k from part)""",
    "trading_permissions": """
with e as (select user_id, event_type, coalesce(value, 0) as v, ts from events where ts <= timestamp '2024-01-20' and timestamp '2024-01-20' < ts + interval 20 days and ts + interval 1 hour <= timestamp '2024-01-19'),
l as (select user_id, event_type, arg_max(v, ts) as v from e group by 1, 2),
s as (select *, case when v > 50 then 'yes' else 'no' end as b, case when v > 5 then 'yes' else 'no' end as c from l)
select user_id as instrument_id, case when count(distinct (b, c)) > 1 then 'unknown' else min(b) end as buy, case when count(distinct (b, c)) > 1 then 'unknown' else min(c) end as sell,
  case when count(distinct (b, c)) > 1 then 'conflicting_sources' else string_agg(event_type, '|' order by event_type) end as reason from s group by 1""",
    "data_coverage": """
select count(*) as rows, count(distinct user_id) as symbols, strftime(min(ts), '%Y-%m-%d') as first, strftime(max(ts), '%Y-%m-%d') as last, true as covers, strftime(cast(max(ts) as date) + 1, '%Y-%m-%d') as next from events""",
    "exchange_trades": f"""
select instrument_id as symbol, sequence, epoch_us(event_time) // 1000 as event_ms, {_e8('price')} as price_e8, {_e8('quantity')} as quantity_e8,
  case when aggressor_side in ('buy', 'sell') then aggressor_side end as aggressor_side from market_trades where instrument_id is not null""",
    "exchange_deltas": f"""
select instrument_id as symbol, sequence * 1000000 + 1 as sequence, lower(trim(side)) as side, {_e8('price')} as price_e8, {_e8('quantity')} as quantity_e8,
  case when quantity.units = 0 then 'delete' else 'upsert' end as action from book_deltas where instrument_id is not null and sequence is not null and side is not null""",
    "membership_days": """
with e as (select o_custkey as symbol, cast(o_orderdate as date) as date, arg_max(o_orderstatus <> 'F', o_orderkey) as added from orders group by 1, 2),
d as (select distinct date_trunc('month', o_orderdate)::date as day from orders),
f as (select symbol, arg_min(added, date) as first from e group by 1),
m as (select f.symbol, day, coalesce(arg_max(e.added, e.date), not any_value(first)) as inside from f cross join d left join e on e.symbol = f.symbol and e.date <= day group by 1, 2)
select symbol, count(*) as days from m where inside group by 1
union all select c_custkey, (select count(*) from d) from customer where c_custkey not in (select o_custkey from orders)""",
    "known_facts": """
with f as (select o_custkey as instrument_id, o_orderpriority as concept, last_day(cast(o_orderdate as date)) as e, o_orderkey, o_totalprice,
  last_day(cast(o_orderdate as date)) + interval 2 days + o_orderkey * interval 1 second as known from orders)
select instrument_id, concept, strftime(e, '%Y-%m-%d') as period_end, arg_max(o_orderkey, known) as accession, arg_max(o_totalprice, known) as value from f where known <= timestamp '1996-01-01' group by 1, 2, 3""",
    "universe_members": """
select user_id as instrument_id, event_id from (select user_id, arg_max(event_id, (ts::date, ts, event_id)) as event_id, arg_max(event_type, (ts::date, ts, event_id)) as t from events
where ts <= timestamp '2024-01-15 12:00:00' group by 1) where t = 'click'""",
    "forecast_scores": """
with p as (select p_partkey, p_type, date '2024-01-01' + cast(p_partkey % 60 as integer) as a from part)
select p_partkey, cast(case when contains(p_type, 'BRASS') then 1 when contains(p_type, 'TIN') then 0.5 when contains(p_type, 'ECONOMY') then -1 else 0 end as double) as forecast_score,
  strftime(a + case dayofweek(a) when 5 then 3 when 6 then 2 else 1 end, '%Y-%m-%d') as effective_date from p where a between date '2024-01-05' and date '2024-02-20'""",
    "nominal_intervals": """
with m as (select event_id, ts, date_trunc('minute', ts) as t, epoch_us(date_trunc('minute', ts)) as u, minute(ts) % 2 as odd from events)
select event_id, u as truncate_from, u + 60000000 as truncate_to, u - 30000000 as half_up_from, u + 30000000 as half_up_to, u - 30000000 + odd as half_even_from, u + 30000000 - odd as half_even_to, ts > t as admitted from m""",
    "zone_instants": """
with l as (select o_orderkey, o_orderdate + (o_orderkey % 24) * interval 1 hour as t from orders),
s as (select *, timezone('America/New_York', t) as g from l),
c as (select *, [x for x in [g - interval 1 hour, g, g + interval 1 hour] if timezone('America/New_York', x) = t] as hits from s)
select o_orderkey, epoch_us(list_min(hits)) as at_us, case len(hits) when 0 then 'nonexistent' when 1 then 'exact' else 'ambiguous' end as status from c""",
    "distribution_terms": _DIST + """
select event_id || ':entitlement' as event_id, instrument_id, 'dividend_entitlement' as kind, strftime(ex, '%Y-%m-%d') as effective, cast(cash as double) as cash_per_unit, cast(null as double) as ratio, strftime(ex - 1, '%Y-%m-%d') as entitlement_date
from r where cash > 0 and not (amounts or no_terms or pay_date or deferred_shares)
union all select event_id || ':payment', instrument_id, 'dividend_payment', strftime(ex + 9, '%Y-%m-%d'), cash, null, strftime(ex - 1, '%Y-%m-%d') from r where cash > 0 and not (amounts or no_terms or pay_date or deferred_shares)
union all select event_id || ':split', instrument_id, 'split', strftime(ex, '%Y-%m-%d'), null, ratio, null from r where ratio <> 1 and not (amounts or no_terms or pay_date or deferred_shares)""",
    "distribution_violations": _DIST + "select rule, count(*) as n from (" + " union all ".join(f"select '{x}' as rule from r where {x}" for x in ("amounts", "no_terms", "pay_date", "deferred_shares")) + ") group by 1",
    "traded_rows": """
with l as (select l_orderkey, l_linenumber, cast(l_quantity as bigint) % 5 as v, count(*) over (partition by l_orderkey, l_linenumber) as n from lineitem),
p as (select l_linenumber, n > 1 as twice, v = 0 as idle, v > 0 and l_linenumber = 3 as bad from l)
select l_linenumber, 'traded' as part, count(*) as n from p where not twice and not idle and not bad group by 1
union all select l_linenumber, 'untraded', count(*) from p where not twice and idle group by 1
union all select l_linenumber, 'wrong', count(*) from (select l_linenumber from p where twice union all select l_linenumber from p where bad) group by 1""",
    "indexed_days": _INDEXED + """
select instrument, strftime(traded, '%Y-%m-%d') as day, arg_min(v, seq) as open, max(v) as high, min(v) as low, arg_max(v, seq) as close, cast(sum(q) as bigint) as amount, count(*) as trades from t group by 1, 2""",
    "indexed_breaks": _INDEXED + """
select instrument, seq, b as before from (select *, lag(seq) over w as b, lag(traded) over w as p from t window w as (partition by instrument order by seq)) where seq <> b + 1 or traded < p""",
}
