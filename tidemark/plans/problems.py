"""Queries of the general data problems, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.fixed import fixed_e8
from tidemark.operators.differential import counted_rows, period_deltas, restated_periods
from tidemark.operators.dyadic import as_known
from tidemark.operators.equality_deletes import books_at_end
from tidemark.operators.history import attribute_history
from tidemark.operators.skew import dense_aggregate, heavy_keys
from tidemark.sources.shared import table
from tidemark.streaming.delivery import DeliveryLog, repeated_deliveries


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    names = ("market_trades", "curated_partitions")
    one, two = (table(spark, d, n).select(F.lit(n).alias("table_name"), "instrument_id") for n in names)
    return heavy_keys(one.unionByName(two), "table_name", "instrument_id", 0.03)


def p1_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "market_trades").select("instrument_id", fixed_e8(F.col("quantity")).alias("q"), F.unix_micros("event_time").alias("t"))
    out = dense_aggregate(rows, ["instrument_id"], {"volume_e8": ("sum", "q"), "first_us": ("min", "t"), "last_us": ("max", "t")})
    return out.select("instrument_id", F.col("rows").alias("n_trades"), F.col("volume_e8").cast("long"), "first_us", "last_us")


def p1_bars(spark: SparkSession, d: str) -> DataFrame:
    at = F.unix_micros("event_time")
    rows = table(spark, d, "market_trades").select("instrument_id", (at - F.pmod(at, F.lit(1800 * 10**6))).alias("bar_start_us"), fixed_e8(F.col("price")).alias("p"), fixed_e8(F.col("quantity")).alias("q"))
    out = dense_aggregate(rows, ["instrument_id", "bar_start_us"], {"high_e8": ("max", "p"), "low_e8": ("min", "p"), "volume_e8": ("sum", "q")})
    return out.select("instrument_id", "bar_start_us", F.col("rows").alias("n_trades"), "high_e8", "low_e8", F.col("volume_e8").cast("long"))


def p1_ohlc(spark: SparkSession, d: str) -> DataFrame:
    """p1_bars with the price of the first and the last trade, by event_time, sequence and delivery_id."""
    at = F.unix_micros("event_time")
    rows = table(spark, d, "market_trades").select("instrument_id", (at - F.pmod(at, F.lit(1800 * 10**6))).alias("bar_start_us"), at.alias("t"), "sequence", "delivery_id", fixed_e8(F.col("price")).alias("p"), fixed_e8(F.col("quantity")).alias("q"))
    order = ["t", "sequence", "delivery_id"]
    out = dense_aggregate(rows, ["instrument_id", "bar_start_us"], {"open_e8": ("first", "p", order), "high_e8": ("max", "p"), "low_e8": ("min", "p"), "close_e8": ("last", "p", order), "volume_e8": ("sum", "q")})
    return out.select("instrument_id", "bar_start_us", F.col("rows").alias("n_trades"), "open_e8", "high_e8", "low_e8", "close_e8", F.col("volume_e8").cast("long"))


def p1_partitions(spark: SparkSession, d: str) -> DataFrame:
    out = dense_aggregate(table(spark, d, "curated_partitions").withColumnRenamed("rows", "n"), ["instrument_id"], {"total_rows": ("sum", "n")})
    return out.select("instrument_id", F.col("rows").alias("n_partitions"), F.col("total_rows").cast("long"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_deliveries(table(spark, d, "market_trades"), table(spark, d, "claims"))


def p2_incremental(spark: SparkSession, d: str) -> DataFrame:
    """p2_found, with the deliveries of two sets of batches taken up by two calls that share a log."""
    trades, claims = table(spark, d, "market_trades"), table(spark, d, "claims")
    later = F.coalesce(F.pmod(F.xxhash64("batch_id"), F.lit(2)) == 1, F.lit(False))
    log = DeliveryLog(spark)
    log.append(trades.where(~later), claims)
    log = DeliveryLog(spark, log.path)
    log.append(trades.where(later), claims)
    return log.removed()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return books_at_end(table(spark, d, "book_deltas"), table(spark, d, "book_snapshots"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return as_known(table(spark, d, "market_trades"), table(spark, d, "instrument_catalog"), table(spark, d, "fx_rates"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return attribute_history(table(spark, d, "catalog_snapshots")).select("symbol", "effective_from_us", "effective_to_us")


def _messages(spark: SparkSession, d: str) -> DataFrame:
    trades = table(spark, d, "market_trades").where("instrument_id is not null")
    return trades.join(p2_found(spark, d), "delivery_id", "left_anti")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return restated_periods(_messages(spark, d))


def p6_deltas(spark: SparkSession, d: str) -> DataFrame:
    out = period_deltas(counted_rows(_messages(spark, d)))
    return out.select("instrument_id", "session_id", "bar_start_us", "version", "sign", "trades", F.col("volume_e8").cast("long"), "close_sequence")


QUERIES = {f.__name__: f for f in (p1_found, p1_totals, p1_bars, p1_ohlc, p1_partitions, p2_found, p2_incremental, p3_found, p4_found, p5_found, p6_found, p6_deltas)}
