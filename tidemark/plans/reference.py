"""Queries of the point-in-time operators over the shared test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import asof, bars, checks, finance, graph, quality
from tidemark.sources.shared import table


def _us(c) -> F.Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date")).withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))


def _pit(spark: SparkSession, d: str, max_age: str | None) -> DataFrame:
    events = _events(spark, d)
    observed = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    facts = events.where("event_type = 'click'").select("user_id", F.col("ts").alias("available_at"), F.col("event_id").alias("click_id"), "value")
    return asof.point_in_time_join(observed, facts, time="ts", by=("user_id",), max_age=max_age)


def pit_join(spark: SparkSession, d: str) -> DataFrame:
    return _pit(spark, d, None).select("event_id", "user_id", _us("source_available_at").alias("source_us"), "click_id", "value")


def pit_join_max_age(spark: SparkSession, d: str) -> DataFrame:
    return _pit(spark, d, "6 hours").select("event_id", "user_id", _us("source_available_at").alias("source_us"), "click_id", "value")


def pit_audit(spark: SparkSession, d: str) -> DataFrame:
    return asof.audit_point_in_time(_pit(spark, d, None), time="ts", max_age="6 hours")


def two_clock_asof(spark: SparkSession, d: str) -> DataFrame:
    orders = _orders(spark, d)
    facts = orders.select("o_custkey", F.col("day").alias("effective_at"), F.date_add("day", (F.col("o_orderkey") % 30).cast("int")).alias("available_at"), F.col("o_orderkey").alias("fact_key"))
    observed = orders.select("o_orderkey", "o_custkey", F.date_add("day", 45).alias("at"))
    return asof.two_clock_join(observed, facts, time="at", by=("o_custkey",), columns=["fact_key"]).select("o_orderkey", "fact_key")


def two_clock_max_age(spark: SparkSession, d: str) -> DataFrame:
    orders = _orders(spark, d)
    facts = orders.select("o_custkey", F.col("day").alias("effective_at"), F.date_add("day", (F.col("o_orderkey") % 30).cast("int")).alias("available_at"), F.col("o_orderkey").alias("fact_key"))
    observed = orders.select("o_orderkey", "o_custkey", F.date_add("day", 45).alias("at"))
    return asof.two_clock_join(observed, facts, time="at", by=("o_custkey",), columns=["fact_key"], max_age="60 days").select("o_orderkey", "fact_key")


def _versions(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    one = asof.latest(_orders(spark, d).select("o_custkey", "day", "o_orderkey"), ["o_custkey", "day"], ["o_orderkey"])
    return one.select("o_custkey", F.col("o_orderkey").alias("version"), F.col("day").cast("timestamp").alias("effective_from"), F.lead("day").over(Window.partitionBy("o_custkey").orderBy("day")).cast("timestamp").alias("effective_to"), F.col("day").cast("timestamp").alias("available_at"), F.lit(None).cast("timestamp").alias("superseded_at"))


def bitemporal_join(spark: SparkSession, d: str) -> DataFrame:
    observed = _orders(spark, d).select("o_orderkey", "o_custkey", F.date_add("day", 10).cast("timestamp").alias("observation_time"), F.date_add("day", 20).cast("timestamp").alias("as_of"))
    return asof.bitemporal_join(observed, _versions(spark, d), by=("o_custkey",)).select("o_orderkey", "version")


def mapping_resolver(spark: SparkSession, d: str) -> DataFrame:
    """The one version of a customer at an order's day, as known then; none or several raise."""
    observed = _orders(spark, d).select("o_orderkey", "o_custkey", F.date_add("day", 1).cast("timestamp").alias("observation_time"), F.date_add("day", 1).cast("timestamp").alias("as_of"))
    return asof.resolve_mapping(observed, _versions(spark, d), by=("o_custkey",)).select("o_orderkey", "version")


def bitemporal_conflicts(spark: SparkSession, d: str) -> DataFrame:
    v = _versions(spark, d)
    facts = v.select("o_custkey", "effective_from", F.date_add("effective_from", 90).cast("timestamp").alias("effective_to"), "available_at", F.date_add("effective_from", 120).cast("timestamp").alias("superseded_at"))
    out = asof.bitemporal_conflicts(facts, ["o_custkey"])
    return out.select("o_custkey", _us("effective_from").alias("from_us"))


def lifecycle_filter(spark: SparkSession, d: str) -> DataFrame:
    listed = F.date_add(F.lit("1993-01-01").cast("date"), (F.col("p_partkey") % 1000).cast("int"))
    life = table(spark, d, "part").select(F.col("p_partkey").alias("symbol"), listed.alias("listed_at"), F.when(F.col("p_size") > 10, F.date_add(listed, 1500)).alias("delisted_at"))
    panel = table(spark, d, "lineitem").select(F.col("l_partkey").alias("symbol"), F.col("l_shipdate").cast("date").alias("date"), "l_quantity")
    return asof.apply_symbol_lifecycle(panel, life).groupBy("symbol").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    out = asof.latest(_events(spark, d).select("user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"], ["ts", "event_id"])
    return out.select("user_id", "event_type", "event_id", "value")


def asof_view(spark: SparkSession, d: str) -> DataFrame:
    history = _events(spark, d).select(F.col("user_id").alias("symbol"), F.col("event_type").alias("domain"), F.lit("v").alias("field"), F.col("ts").alias("effective_at"), F.timestamp_micros(_us("ts") + 3_600_000_000).alias("available_at"), "event_id")
    out = asof.asof_history(history, as_of=F.lit("2024-01-15 00:00:00").cast("timestamp"), domain="click", field="v")
    return out.select("symbol", "event_id")


def _trades(spark: SparkSession, d: str, day) -> DataFrame:
    e = _events(spark, d)
    price = F.col("value").cast("decimal(18,4)")
    return e.select(F.lit("s").alias("source"), F.col("event_type").alias("instrument_id"), day.alias("trading_day"), F.date_format(day, "yyyyMMdd").alias("session_id"), F.col("ts").alias("event_time"), F.col("event_id").alias("sequence"), F.col("event_id").cast("string").alias("event_id"), price.alias("price"), F.lit(1).cast("decimal(18,4)").alias("quantity"), F.col("ts").alias("received_at"), F.timestamp_micros(_us("ts") + 1000).alias("available_at"))


def _sessions(trades: DataFrame) -> DataFrame:
    opens = F.col("trading_day").cast("timestamp")
    return trades.select("session_id", "trading_day", F.lit("v").alias("venue"), opens.alias("opens_at"), F.date_add("trading_day", 1).cast("timestamp").alias("closes_at")).distinct()


_BAR = ["instrument_id", "open", "high", "low", "close", "volume", "trades"]


def _bar_columns(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) if c in ("open", "high", "low", "close", "volume") else c for c in _BAR], _us("bar_start").alias("start_us"), _us("bar_end").alias("end_us"), _us("available_at").alias("available_us"))


def fixed_bars_1h(spark: SparkSession, d: str) -> DataFrame:
    t = _trades(spark, d, F.col("ts").cast("date"))
    return _bar_columns(bars.interval_bars(t, _sessions(t), 3600 * 10**6))


def session_bars(spark: SparkSession, d: str) -> DataFrame:
    t = _trades(spark, d, F.col("ts").cast("date"))
    return _bar_columns(bars.session_bars(t, _sessions(t)))


def day_bars(spark: SparkSession, d: str) -> DataFrame:
    t = _trades(spark, d, F.col("ts").cast("date"))
    return _bar_columns(bars.day_bars(t, _sessions(t), t.select("instrument_id", F.lit("v").alias("venue")).distinct()))


def count_bars(spark: SparkSession, d: str) -> DataFrame:
    return _bar_columns(bars.count_bars(_trades(spark, d, F.lit("2024-01-01").cast("date")), 50))


def amount_bars(spark: SparkSession, d: str) -> DataFrame:
    t = _trades(spark, d, F.lit("2024-01-01").cast("date"))
    out = bars.amount_bars(t, F.floor(F.col("price")).cast("long"), 5000)
    return _bar_columns(out)


def rolling_compound(spark: SparkSession, d: str) -> DataFrame:
    daily = _events(spark, d).groupBy("event_type", F.col("ts").cast("date").alias("day")).agg((F.sum(F.col("value").cast("decimal(18,4)")) / 100000).cast("double").alias("r"))
    return finance.rolling_compound(daily, ["event_type"], "day", "r", 5).select("event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("compound", 6).alias("compound"))


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).groupBy(F.col("o_orderpriority").alias("symbol"), F.col("day").alias("date")).agg((F.max("cents") / 100.0).alias("close"))


def total_return(spark: SparkSession, d: str) -> DataFrame:
    levels = _levels(spark, d)
    pays = levels.where("dayofyear(date) = 100").select("symbol", "date", F.lit(None).cast("double").alias("ratio"), F.lit(500.0).alias("cash"))
    return finance.total_return(levels, pays).select("symbol", F.date_format("date", "yyyy-MM-dd").alias("date"), F.round("return_close", 4).alias("return_close"))


def forward_labels(spark: SparkSession, d: str) -> DataFrame:
    levels = _levels(spark, d).select(F.col("symbol").alias("instrument_id"), "date", F.col("close").alias("value"), F.col("date").cast("timestamp").alias("available_at"))
    samples = levels.select(F.concat_ws("/", "instrument_id", "date").alias("sample_id"), "instrument_id", "date")
    out = finance.forward_labels(levels, samples, levels.select("date"), horizon=5, as_of=F.lit("2001-01-01 00:00:00").cast("timestamp"), lower=-1.0, upper=1.0)
    return out.select("sample_id", F.date_format("label_end", "yyyy-MM-dd").alias("label_end"), F.round("return", 8).alias("ret"), "status", F.round("lower_return", 8).alias("lower"), F.round("upper_return", 8).alias("upper"))


def _facts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    quarter = F.trunc(F.col("l_shipdate").cast("date"), "quarter")
    q = rows.groupBy("p_brand", quarter.alias("period_start")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("value"))
    return q.select(F.col("p_brand").alias("instrument_id"), F.lit("Revenue").alias("concept"), F.lit("USD").alias("unit"), "period_start", F.date_sub(F.add_months("period_start", 3), 1).alias("period_end"), "value", F.date_add(F.add_months("period_start", 3), 30).cast("timestamp").alias("available_at"), F.concat_ws("-", "p_brand", "period_start").alias("accession"))


def ttm_facts(spark: SparkSession, d: str) -> DataFrame:
    out = finance.ttm_facts(_facts(spark, d), F.lit("1998-06-01").cast("timestamp"))
    return out.select("instrument_id", F.date_format("period_start", "yyyy-MM-dd").alias("period_start"), F.date_format("period_end", "yyyy-MM-dd").alias("period_end"), F.col("value").cast("long").alias("value"))


def coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    days = _orders(spark, d).select(F.col("day").alias("date")).distinct()
    panel = _orders(spark, d).select(F.col("o_orderpriority").alias("symbol"), F.col("day").alias("date"))
    return quality.coverage_gaps(panel, days).select("symbol", F.date_format("date", "yyyy-MM-dd").alias("date"))


def calendar_coverage(spark: SparkSession, d: str) -> DataFrame:
    days = _orders(spark, d).select(F.col("day").alias("date")).distinct()
    panel = _orders(spark, d).select(F.col("o_orderpriority").alias("symbol"), F.col("day").alias("date"))
    return quality.calendar_coverage(panel, days).withColumn("missing_ratio", F.round("missing_ratio", 8))


def price_frame_stats(spark: SparkSession, d: str) -> DataFrame:
    b = fixed_bars_1h(spark, d)
    return quality.price_frame_stats(b.withColumnRenamed("instrument_id", "symbol").withColumnRenamed("start_us", "date"))


def provider_compare(spark: SparkSession, d: str) -> DataFrame:
    one = _orders(spark, d).where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("symbol"), F.col("day").alias("date"), F.col("o_totalprice").alias("close"))
    two = _orders(spark, d).where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("symbol"), F.col("day").alias("date"), (F.col("o_totalprice") * (1 + F.col("o_orderkey") % 7 / 100)).alias("close"))
    out = quality.compare_prices(one, two)
    return out.withColumn("max_relative", F.round("max_relative", 8)).withColumn("median_relative", F.round("median_relative", 8))


def discrepancies(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("instrument_id"), F.lit("quantity").alias("field"), F.lit("1990-01-01").cast("date").alias("effective_at"), F.col("l_returnflag").alias("source"), F.col("l_shipdate").cast("timestamp").alias("available_at"), F.concat_ws("/", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity").alias("observation_id"), F.col("l_quantity").alias("value"), F.lit("one").alias("unit"), F.lit("USD").alias("currency"), F.lit("raw").alias("basis"))
    out = quality.discrepancies(rows, F.lit("1997-01-01").cast("timestamp"), tolerance=5.0)
    return out.select("instrument_id", "sources", F.round("spread", 4).alias("spread"), "reason")


def _revised(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = _orders(spark, d).select("o_orderkey", "o_orderstatus", "o_orderpriority", "cents")
    new = o.where("o_orderpriority <> '5-LOW'").withColumn("cents", F.when(F.col("o_orderstatus") == "P", F.col("cents") + 100).otherwise(F.col("cents")))
    return o.where("o_orderpriority <> '1-URGENT'"), new


def upsert_merged(spark: SparkSession, d: str) -> DataFrame:
    return quality.merge_by_key(*_revised(spark, d), ["o_orderkey"])[0].select("o_orderkey", "cents")


def upsert_revisions(spark: SparkSession, d: str) -> DataFrame:
    return quality.merge_by_key(*_revised(spark, d), ["o_orderkey"])[1]


def version_diff(spark: SparkSession, d: str) -> DataFrame:
    return quality.version_diff(*_revised(spark, d), ["o_orderkey"])


def multiset_added(spark: SparkSession, d: str) -> DataFrame:
    old, new = (x.select("o_orderstatus", "o_orderpriority", (F.col("cents") / 1_000_000).cast("long").alias("m")) for x in _revised(spark, d))
    return quality.multiset_diff(old, new)["added"]


def dup_events(spark: SparkSession, d: str) -> DataFrame:
    return checks.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def dup_copies(spark: SparkSession, d: str) -> DataFrame:
    out = checks.every_copy_of_duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])
    return out.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


def sequence_gaps(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("sequence"), F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("arrival"))
    return quality.sequence_breaks(rows, ["l_orderkey"], "arrival").groupBy("l_orderkey").agg(F.count("*").alias("breaks"))


def quarantined(spark: SparkSession, d: str) -> DataFrame:
    good, bad = quality.quarantine_streams(table(spark, d, "lineitem"), ["l_orderkey"], F.col("l_discount") >= 0.1)
    count = lambda df, name: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("streams"))
    return count(good, "accepted").unionByName(count(bad, "rejected"))


def event_union(spark: SparkSession, d: str) -> DataFrame:
    a = _events(spark, d).select("event_id", F.lit("event").alias("schema_id"), "event_type")
    b = _orders(spark, d).select(F.col("o_orderkey").alias("event_id"), F.lit("order").alias("schema_id"), "cents")
    return a.unionByName(b, allowMissingColumns=True)


def _holdings(spark: SparkSession, d: str) -> DataFrame:
    part = "decimal(38,18)"
    nations, customers, regions = (table(spark, d, t) for t in ("nation", "customer", "region"))
    funds = regions.join(nations, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("fund_id"), F.col("n_name").alias("instrument_id"), F.lit("fund").alias("asset_type"), F.lit("0.2").cast(part).alias("weight"))
    held = nations.join(customers, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("fund_id"), "c_mktsegment").distinct().select("fund_id", F.col("c_mktsegment").alias("instrument_id"), F.lit("equity").alias("asset_type"), F.lit("0.1").cast(part).alias("weight"))
    day = F.lit("2024-01-01").cast("date")
    return funds.unionByName(held).select("fund_id", "instrument_id", "asset_type", "weight", F.lit("USD").alias("currency"), day.alias("holding_date"), day.cast("timestamp").alias("available_at"), F.concat(F.lit("d-"), "fund_id").alias("disclosure_id"), F.lit("e").alias("evidence_id"))


def look_through(spark: SparkSession, d: str) -> DataFrame:
    shares = table(spark, d, "region").select(F.col("r_name").alias("fund_id"), F.lit("0.2").cast("decimal(38,18)").alias("weight"))
    out = finance.look_through(_holdings(spark, d), shares, F.lit("2024-02-01").cast("timestamp"))
    return out.groupBy("instrument_id", "reason").agg(F.sum("weight").cast("double").alias("weight"), F.count("*").alias("n"))


def impacted_nodes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    deps = rows.select(F.concat(F.lit("s"), "l_suppkey").alias("node"), F.concat(F.lit("p"), "l_partkey").alias("input"))
    nation = table(spark, d, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("node"), F.concat(F.lit("s"), "s_suppkey").alias("input"))
    changed = table(spark, d, "part").where("p_size = 1").select(F.concat(F.lit("p"), "p_partkey").alias("node"))
    return graph.impacted_nodes(changed, deps.unionByName(nation))


def unit_normalise(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").cast("long").alias("volume"), F.round(F.col("l_extendedprice")).cast("long").alias("amount"))
    out = finance.trading_units(rows, volume_unit="lots", amount_unit="thousand_currency", currency="USD", lot_size=100)
    return out.groupBy("l_orderkey", "volume_unit", "amount_unit", "currency").agg(F.sum("volume").alias("volume"), F.sum("amount").alias("amount"))


def multiset_hash(spark: SparkSession, d: str) -> DataFrame:
    return quality.multiset_hash(table(spark, d, "nation").select("n_name", "n_nationkey", "n_regionkey")).select("rows", *[F.col(f"h{i}").cast("string").alias(f"h{i}") for i in range(4)], "x0", "x7")


def trades_hash(spark: SparkSession, d: str) -> DataFrame:
    """multiset_hash of all columns of a large table with repeats, nulls and nested values; times in microseconds."""
    t = table(spark, d, "market_trades")
    whole = t.withColumns({f.name: F.unix_micros(f.name) for f in t.schema if f.dataType.typeName() == "timestamp"})
    return quality.multiset_hash(whole).select("rows", *[F.col(f"h{i}").cast("string").alias(f"h{i}") for i in range(4)], *[f"x{i}" for i in range(8)])


def session_lookup(spark: SparkSession, d: str) -> DataFrame:
    events = _events(spark, d)
    days = events.select(F.col("ts").cast("date").alias("day")).distinct()
    sessions = days.select(F.date_format("day", "yyyyMMdd").alias("session_id"), F.timestamp_micros(_us("day") + 9 * 3600 * 10**6).alias("opens_at"), F.timestamp_micros(_us("day") + 16 * 3600 * 10**6).alias("closes_at"))
    return asof.interval_lookup(events.select("event_id", "ts"), sessions, None, "ts", "opens_at", "closes_at", ["session_id"]).select("event_id", "session_id")


def next_open(spark: SparkSession, d: str) -> DataFrame:
    events = _events(spark, d).withColumn("k", F.lit(1))
    starts = events.select("k", F.timestamp_micros(_us(F.col("ts").cast("date")) + 9 * 3600 * 10**6).alias("opens_at")).distinct()
    return asof.next_start(events.select("event_id", "k", "ts"), starts, ["k"], "ts", "opens_at").select("event_id", _us("next_start").alias("next_us"))


def settlement_t1(spark: SparkSession, d: str) -> DataFrame:
    days = _orders(spark, d).select(F.col("day").alias("date")).where("dayofweek(day) between 2 and 6").distinct()
    out = finance.advance_days(_orders(spark, d).select("o_orderkey", "day"), "day", 1, days, "settles")
    return out.select("o_orderkey", F.date_format("settles", "yyyy-MM-dd").alias("settles"))


def adjusted_prices(spark: SparkSession, d: str) -> DataFrame:
    levels = _levels(spark, d).select("symbol", "date", *[F.col("close").alias(c) for c in ("open", "high", "low", "close")])
    first = levels.groupBy("symbol").agg(F.min("date").alias("_first"))
    acts = levels.join(first, "symbol").where("dayofyear(date) = 100 and date > _first").select("symbol", F.col("date").alias("ex_date"), F.lit(100.0).alias("cash_per_share"), F.lit(2.0).alias("share_ratio"))
    return finance.adjust_prices(levels, acts).select("symbol", F.date_format("date", "yyyy-MM-dd").alias("date"), F.round("close", 2).alias("close"))


def price_violations(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("symbol"), F.col("l_orderkey").alias("date"), F.col("l_discount").alias("open"), F.col("l_tax").alias("high"), F.col("l_discount").alias("low"), F.col("l_tax").alias("close"), F.col("l_quantity").alias("volume"))
    return quality.price_violations(rows).groupBy("rule").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        pit_join, pit_join_max_age, pit_audit, two_clock_asof, two_clock_max_age, bitemporal_join, mapping_resolver, bitemporal_conflicts, lifecycle_filter, latest_per_key, asof_view,
        fixed_bars_1h, session_bars, day_bars, count_bars, amount_bars, rolling_compound, total_return, forward_labels, ttm_facts, coverage_gaps, calendar_coverage,
        price_frame_stats, provider_compare, discrepancies, upsert_merged, upsert_revisions, version_diff, multiset_added, dup_events, dup_copies, sequence_gaps,
        quarantined, event_union, look_through, impacted_nodes, unit_normalise, multiset_hash, trades_hash, session_lookup, next_open, settlement_t1, adjusted_prices, price_violations,
    )
}
