"""python tools/ingest_bench.py [EVENTS]: one book snapshot and sequential upserts of one price level, through write_normalized and a verified reload.

The timed part makes the events, checks rules, order and repeated ids, replays the book, writes the partitioned
snapshot and the claim index, and reads it back with its hashes verified.
"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import lake, schemas
from tidemark.sources.shared import clear_folders, shared_folder


def _header(kind: str, at) -> list:
    return [
        F.lit(kind).alias("event_type"), F.format_string("e%012d", "id").alias("event_id"), F.lit("i").alias("instrument_id"), at.alias("event_time"), at.alias("received_at"), at.alias("available_at"),
        F.lit("s").alias("source"), F.lit("2023-11-14").cast("date").alias("trading_day"), F.lit("x").alias("session_id"), (F.col("id") + 1).alias("sequence"),
    ]


def feed(spark: SparkSession, count: int) -> tuple[DataFrame, DataFrame]:
    """(count deltas, the snapshot before them), each with ingest_ordinal."""
    at = F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 1000)
    fixed = lambda units: F.struct(units.cast("long").alias("units"), F.lit(0).cast("smallint").alias("scale"))
    deltas = spark.range(1, count + 1).select(*_header("book_delta", at), F.lit("bid").alias("side"), F.lit("upsert").alias("action"), fixed(F.lit(100)).alias("price"), fixed(F.col("id") % 1024 + 1).alias("quantity"), F.col("id").alias("previous_sequence"), F.col("id").alias("ingest_ordinal"))
    level = lambda p: F.array(F.struct(fixed(F.lit(p)).alias("price"), fixed(F.lit(1)).alias("quantity"), F.lit(None).cast("bigint").alias("order_count")))
    snapshot = spark.range(0, 1).select(*_header("book_snapshot", at), level(100).alias("bids"), level(101).alias("asks"), F.col("id").alias("ingest_ordinal"))
    return schemas.conform(deltas, "book_delta", ordinal="ingest_ordinal"), schemas.conform(snapshot, "book_snapshot", ordinal="ingest_ordinal")


def rate(spark: SparkSession, count: int) -> tuple[float, float]:
    """(seconds, events a second) of a normalized write and a verified reload."""
    root = shared_folder(spark, "ingest")
    began = time.time()
    deltas, snapshot = feed(spark, count)
    name, quarantine = lake.write_normalized(deltas, root, "book_delta", provider="p", venue="v", references=[], beside={"book_snapshot": snapshot})
    assert quarantine is None
    assert lake.read_snapshot(spark, f"{root}/normalized", name).count() == count
    took = time.time() - began
    clear_folders(spark)
    return took, count / took


if __name__ == "__main__":
    from tidemark.session import local_session

    session = local_session(8, 16, "12g")
    for n in (100_000, int(sys.argv[1]) if len(sys.argv) > 1 else 1_000_000):  # the first compiles code
        seconds, events = rate(session, n)
        print(f"{n} events checked, replayed, written with claims, and verified in {seconds:.1f} s: {events:.0f} a second", flush=True)
