"""Queries of values, events, layers and intake over the shared test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import instants, values
from tidemark.functions.fixed import fixed_e8, parse_instant
from tidemark.operators import asof, bars, book, checks, quality
from tidemark.sources import intake, lake, schemas
from tidemark.sources.shared import shared_folder, table
from tidemark.sources.sqlview import SqlView

CUBE = """
select source, session, count(*) as n, sum(sequence) as total, grouping(source) + 0 as all_sources
from (select source, substr(session_id, 1, 3) as session, sequence from event_trade where aggressor_side in ('buy', 'sell')) t
group by cube (source, session)"""


def canonical_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", values.digest(["doc_id", "lang", "source", "n_chars"]).alias("sha256"))


def document_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Hash of all columns of each document, its text included; times in microseconds."""
    docs = table(spark, d, "documents")
    whole = docs.withColumns({f.name: F.unix_micros(f.name) for f in docs.schema if f.dataType.typeName() == "timestamp"})
    return whole.select("doc_id", values.digest(whole.columns).alias("sha256"))


def rounded_rates(spark: SparkSession, d: str) -> DataFrame:
    rate = F.col("rate_text")
    return table(spark, d, "fx_rates").select("event_id", "observed_at", "captured_at", *[values.fixed_from_text(rate, 3, mode)["units"].alias(mode) for mode in ("floor", "ceiling", "half_up", "half_even", "down", "up")], values.fixed_from_text(rate, 8)["units"].alias("exact"))


def rate_nanos(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fx_rates").select("event_id", "observed_at", instants.parse_nanos(F.col("observed_at")).alias("observed_ns"), instants.nanos_text(instants.parse_nanos(F.col("available_at"))).alias("available_text"))


def next_weekdays(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.date_format(instants.next_weekday(F.col("o_orderdate").cast("date")), "yyyy-MM-dd").alias("next"))


def fixed_values(spark: SparkSession, d: str) -> DataFrame:
    product = values.fixed_product(F.col("price"), F.col("quantity"))
    return table(spark, d, "market_trades").select("delivery_id", values.fixed_value(F.col("price")).cast("double").alias("price"), product["units"].cast("string").alias("units"), product["scale"].alias("scale"))


def event_violations(spark: SparkSession, d: str) -> DataFrame:
    trades = schemas.conform(table(spark, d, "market_trades"), "trade")
    return schemas.record_violations(trades, "trade", ["source"]).groupBy("source", "rule").agg(F.count("*").alias("n"))


def delta_violations(spark: SparkSession, d: str) -> DataFrame:
    rows = schemas.conform(table(spark, d, "book_deltas"), "book_delta")
    return schemas.record_violations(rows, "book_delta", ["source"]).groupBy("source", "rule").agg(F.count("*").alias("n"))


def _by_source(df: DataFrame, part: str) -> DataFrame:
    return df.groupBy("source").agg(F.count("*").alias("n")).select("source", F.lit(part).alias("part"), "n")


def normalized_arrivals(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each source that a load keeps, and those that it rejects: sequences are checked as rows came in, a repeated event_id takes out its own rows."""
    good, bad = lake.check_events(table(spark, d, "market_trades"), "trade")
    return _by_source(good, "kept").unionByName(_by_source(bad, "rejected"))


def normalized_streams(spark: SparkSession, d: str) -> DataFrame:
    """As normalized_arrivals for a feed that is sorted by sequence first and loaded by whole streams only: one rejected row keeps out its stream."""
    rows = table(spark, d, "market_trades").withColumn("in_sequence", F.col("sequence"))
    _, bad = lake.check_events(rows, "trade", arrival="in_sequence")
    streams = bad.select(*lake.STREAM).distinct().withColumn("_out", F.lit(True))
    same = [F.col(f"e.{k}").eqNullSafe(F.col(f"s.{k}")) for k in lake.STREAM]
    whole = rows.alias("e").join(streams.alias("s"), same, "left").select("e.*", "_out")
    return _by_source(whole.where("_out is null"), "kept").unionByName(_by_source(whole.where("_out"), "rejected"))


def normalized_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Deltas in plain spelling, one row of each change, written as a partitioned snapshot, read back, by stream."""
    rows = book.book_events(table(spark, d, "book_deltas"), table(spark, d, "book_snapshots")).where("kind = 'book_delta'")
    root = shared_folder(spark, "lake")
    name = lake.write_snapshot(rows.drop("bids", "asks").withColumn("date", F.to_date("event_time")), root, partition_by=("date",), sort_by=("instrument_id", "sequence"))
    return lake.read_snapshot(spark, root, name).groupBy("instrument_id", "source", "session_id").agg(F.count("*").alias("n"), F.max("sequence").alias("last"), F.sum(fixed_e8(F.col("quantity"))).alias("quantity_e8"))


def claim_shards(spark: SparkSession, d: str) -> DataFrame:
    claims = table(spark, d, "claims").withColumn("shard", F.substring(F.lower("event_id_hash"), 1, 2))
    out = lake.claim_shards(claims)
    return out.select("shard", "rows", F.col("total0").cast("string").alias("total0"), F.col("total3").cast("string").alias("total3"), "mixed0", "mixed7")


def claim_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers, as written, that stand for several contents."""
    c = table(spark, d, "claims").where("trim(event_id) <> ''").select("event_id", F.lower("event_sha256").alias("sha")).distinct()
    return checks.duplicates(c, ["event_id"])


def book_replay(spark: SparkSession, d: str) -> DataFrame:
    events = book.book_events(table(spark, d, "book_deltas"), table(spark, d, "book_snapshots"))
    return book.replay(events).drop("checkpoints")


def book_best(spark: SparkSession, d: str) -> DataFrame:
    """Each book after all its changes, replayed to the end: levels and best prices of either side."""
    events = book.standing_events(table(spark, d, "book_deltas"), table(spark, d, "book_snapshots"))
    out = book.replay(events, tolerate=("no_snapshot", "sequence_gap", "absent_level", "time_reversed", "crossed", "empty_level", "no_level"))
    return out.where("violation is null and n_bids + n_asks > 0").select("instrument_id", "source", "session_id", "n_bids", "n_asks", "best_bid", "best_ask")


def intake_issues(spark: SparkSession, d: str) -> DataFrame:
    contract = intake.Contract({"symbol": ("symbol", "string", None), "tick": ("price_tick", "number", None), "commission": ("commission_rate", "integer", None), "from": ("effective_from", "string", None)}, key=("symbol", "from"))
    _, issues = intake.normalize(table(spark, d, "catalog_snapshots"), contract)
    return issues.groupBy("column", "rule").agg(F.count("*").alias("n"))


def rate_asof(spark: SparkSession, d: str) -> DataFrame:
    """Each pair's last observation known by a cutoff, by its last publication."""
    rows = table(spark, d, "fx_rates").select(F.concat("base_currency", F.lit("/"), "quote_currency").alias("series_id"), parse_instant(F.col("observed_at")).alias("observation_date"), parse_instant(F.col("available_at")).alias("available_at"), "event_id")
    out = asof.macro_asof(rows, F.lit("2024-03-08 12:00:00").cast("timestamp"), latest_observation=True)
    return out.select("series_id", F.unix_micros("observation_date").alias("observed_us"), F.unix_micros("available_at").alias("available_us"))


def sql_view(spark: SparkSession, d: str) -> DataFrame:
    return SqlView({"event_trade": table(spark, d, "market_trades")}).query(CUBE)


def trade_bars_5m(spark: SparkSession, d: str) -> DataFrame:
    """Five-minute bars of all deliveries from the start of their trading day."""
    t = table(spark, d, "market_trades").where("instrument_id is not null")
    t = t.withColumns({"price": fixed_e8(F.col("price")).cast("decimal(38,0)"), "quantity": fixed_e8(F.col("quantity")).cast("decimal(38,0)"), "event_id": F.format_string("%012d", "delivery_id")})
    starts = t.groupBy("session_id").agg(F.min("event_time").alias("opens_at"))
    b = bars.interval_bars(t, starts, 300 * 10**6)
    return b.select("source", "instrument_id", F.col("trading_day").cast("string").alias("trading_day"), "session_id", F.unix_micros("bar_start").alias("start_us"), *[F.col(c).cast("long").alias(c) for c in ("open", "high", "low", "close", "volume")], "trades")


def partition_manifest(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "market_trades")
    out = lake.partition_manifest(t, ["source", "trading_day"])
    return out.select("source", F.col("trading_day").cast("string").alias("trading_day"), "rows", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"))


def catalog_contiguity(spark: SparkSession, d: str) -> DataFrame:
    """Versions that do not end where their symbol's next one begins, of the last word on each."""
    last = asof.latest(table(spark, d, "instrument_catalog").select("symbol", "effective_from", "effective_to", "available_at", "catalog_row_id"), ["symbol", "effective_from"], ["available_at", "catalog_row_id"])
    return quality.contiguous_versions(last, ["symbol"]).select("symbol", F.unix_micros("effective_from").alias("from_us"), F.unix_micros("next_start").alias("next_us"))


QUERIES = {
    f.__name__: f
    for f in (
        canonical_hashes, document_hashes, rounded_rates, rate_nanos, next_weekdays, fixed_values, event_violations, delta_violations, normalized_streams, normalized_arrivals, normalized_snapshot,
        claim_shards, claim_conflicts, book_replay, book_best, intake_issues, rate_asof, sql_view, trade_bars_5m, partition_manifest, catalog_contiguity,
    )
}
