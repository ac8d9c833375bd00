"""Bars of trades: by interval from the session's start, by session or day, by count, by accumulated volume or notional."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

STREAM = ["source", "instrument_id", "trading_day", "session_id"]
_ORDER = ["event_time", "sequence", "event_id"]


def _ohlc() -> list[Column]:
    order = F.struct(*_ORDER)
    return [
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.sum("quantity").alias("volume"), F.count("*").alias("trades"), F.max("received_at").alias("_received"), F.max("available_at").alias("_available"), F.max(order)["sequence"].alias("_sequence"),
    ]


def _finished(bars: DataFrame) -> DataFrame:
    """A bar is received at its end at the earliest, and known when it and all its trades are."""
    received = F.greatest("bar_end", "_received")
    return bars.withColumn("received_at", received).withColumn("available_at", F.greatest("received_at", "_available")).drop("_received", "_available")


def interval_bars(trades: DataFrame, starts: DataFrame, interval_us: int) -> DataFrame:
    """Bars of interval_us from each session's start; no empty bars. (STREAM, bar_start, bar_end, OHLC, volume, ...)

    trades: STREAM, event_time, sequence, event_id, price, quantity (decimals), received_at, available_at. starts:
    session_id, opens_at, one row a session. Trades before their session's start, or without one, are left out:
    ``untimely_trades`` lists them. The trades of a bar are added up before they are shuffled.
    """
    joined = trades.join(starts.select("session_id", F.unix_micros("opens_at").alias("_s")), "session_id")
    elapsed = F.unix_micros("event_time") - F.col("_s")
    start = F.col("_s") + F.call_function("div", elapsed, F.lit(interval_us)) * interval_us
    rows = joined.where(elapsed >= 0).withColumn("_b", start)
    bars = rows.groupBy(*STREAM, "_b").agg(*_ohlc())
    bars = bars.withColumn("bar_start", F.timestamp_micros("_b")).withColumn("bar_end", F.timestamp_micros(F.col("_b") + interval_us)).withColumn("sequence", F.col("_b") + interval_us)
    return _finished(bars.drop("_b", "_sequence"))


def untimely_trades(trades: DataFrame, starts: DataFrame) -> DataFrame:
    """Trades without a session start, or before it."""
    joined = trades.join(starts.select("session_id", F.col("opens_at").alias("_s")), "session_id", "left")
    return joined.where("_s is null or event_time < _s").drop("_s")


def session_bars(trades: DataFrame, sessions: DataFrame) -> DataFrame:
    """One bar for each stream, from its session's opens_at to closes_at."""
    bars = trades.groupBy(*STREAM).agg(*_ohlc()).join(sessions.select("session_id", F.col("opens_at").alias("bar_start"), F.col("closes_at").alias("bar_end")), "session_id")
    return _finished(bars.withColumnRenamed("_sequence", "sequence"))


def day_bars(trades: DataFrame, sessions: DataFrame, venues: DataFrame) -> DataFrame:
    """One bar for each source, instrument and trading day, over the day of the instrument's venue: first open to last close, under the last session's id."""
    days = sessions.groupBy("venue", "trading_day").agg(F.min("opens_at").alias("bar_start"), F.max("closes_at").alias("bar_end"), F.max_by("session_id", F.struct("closes_at", "session_id")).alias("session_id"))
    bars = trades.groupBy("source", "instrument_id", "trading_day").agg(*_ohlc()).join(venues.select("instrument_id", "venue"), "instrument_id").join(days, ["venue", "trading_day"])
    return _finished(bars.withColumnRenamed("_sequence", "sequence"))


def count_bars(trades: DataFrame, size: int, *, complete_only: bool = True, slice_seconds: int = 86400) -> DataFrame:
    """Bars of ``size`` trades of a stream; a bar starts where the one before ended, the first at the first trade.

    Trades are numbered in slices of time, to which the counts of the slices before are added: a stream with most of
    the trades is many tasks' work.
    """
    sliced = trades.withColumn("_s", F.floor(F.unix_micros("event_time") / (slice_seconds * 10**6)).cast("long"))
    counts = sliced.groupBy(*STREAM, "_s").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*STREAM).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy(*STREAM, "_s").orderBy(*_ORDER)) - 1
    rows = sliced.join(counts.select(*STREAM, "_s", before.alias("_before")), [*STREAM, "_s"]).withColumn("bar", F.call_function("div", (own + F.col("_before")).cast("long"), F.lit(size))).drop("_s", "_before")
    return _event_bars(rows, F.lit(size) if complete_only else None)


def _event_bars(rows: DataFrame, least: Column | None) -> DataFrame:
    bars = rows.groupBy(*STREAM, "bar").agg(*_ohlc(), F.min("event_time").alias("_first"), F.max("event_time").alias("bar_end"))
    if least is not None:
        bars = bars.where(F.col("trades") >= least)
    before = F.lag("bar_end").over(Window.partitionBy(*STREAM).orderBy("bar"))
    return _finished(bars.withColumn("bar_start", F.coalesce(before, "_first")).drop("_first").withColumnRenamed("_sequence", "sequence"))


def _accumulate(threshold: int):
    """Number the bars of rows that come stream by stream, in order; a stream's sum starts anew after each bar."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, bar, held = None, 0, 0
        for frame in frames:
            bars, full = [], []
            for key, amount in zip(zip(*(frame[c] for c in STREAM)), frame["_amount"]):
                if key != stream:
                    stream, bar, held = key, 0, 0
                held += int(amount)
                bars.append(bar)
                closes = held >= threshold
                full.append(closes)
                if closes:
                    bar, held = bar + 1, 0
            yield frame.assign(bar=bars, _full=full)

    return run


def amount_bars(trades: DataFrame, amount: Column, threshold: int) -> DataFrame:
    """Bars that close when ``amount`` (a long of each trade, such as its quantity's units) adds up to threshold; the rest over it is dropped.

    An accumulator that resets depends on all trades of the stream before; so a stream is read in order by one task,
    as a stream of batches that is never held as a whole. Trades after the last full bar are left out.
    """
    rows = trades.withColumn("_amount", amount.cast("long"))
    sorted_rows = rows.repartition(*STREAM).sortWithinPartitions(*STREAM, *_ORDER)
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in sorted_rows.schema], T.StructField("bar", T.LongType()), T.StructField("_full", T.BooleanType())])
    numbered = sorted_rows.mapInPandas(_accumulate(threshold), schema)
    last = Window.partitionBy(*STREAM, "bar")
    return _event_bars(numbered.withColumn("_done", F.max("_full").over(last)).where("_done").drop("_done", "_full", "_amount"), None)
