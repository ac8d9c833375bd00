"""Exactly one row of every message that was delivered at least once.

Deliveries are keyed and land, epoch by epoch, in a log folder that a streaming query follows. The query's state store
holds one entry for each identifier seen; the event-time watermark expires it. Rows of identifiers that are not in the
store are its output, a table of seen identifiers, committed together with the store's checkpoint. Rows that came too
late for the store, and identifiers that came back after they expired, are settled by a lookup in that table.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.fixed import packed, packed_low
from tidemark.functions.text import hex_number, trimmed
from tidemark.sources.shared import file_system, place, shared_folder, written

#: In place of a null received_at: after any TIMESTAMP.
_LAST = 1 << 60
#: Before any clock: the watermark while nothing was seen.
_NEVER = -(1 << 62)
_KEYS = ["k1", "k2"]
_LOG = "k1 long, k2 long, at long, delivery_id long, clock timestamp, lost boolean, n int, after long"


def _first_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mark rows that another delivery of their batch beats: a hot identifier leaves one delivery a batch."""
    for batch in batches:
        k1, k2, at, d = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("k1", "k2", "at", "delivery_id"))
        order = np.lexsort((d, at, k2, k1))
        beaten = np.zeros(len(order), bool)
        if len(order):
            a, b, ids = k1[order], k2[order], d[order]
            first = np.ones(len(order), bool)
            first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            winner = ids[np.flatnonzero(first)][np.cumsum(first) - 1]
            beaten[order] = ids != winner  # a repeated row of the winner is no other delivery
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(beaten)], names=[*batch.schema.names, "lost"])


def delivery_feed(deliveries: DataFrame, claims: DataFrame, epochs: int) -> DataFrame:
    """(k1, k2, at, delivery_id, clock, epoch, lost) of every row that has an identifier and a hash.

    k1 and k2 are two chained 64-bit hashes of the trimmed event_id and of the hash's value, 128 bits together. clock is
    the event time, but not after received_at, so that one wrong clock doesn't expire all others.
    """
    rows = deliveries.select("delivery_id", trimmed(F.col("event_id")).alias("id"), "event_time", "received_at").where("delivery_id is not null and id <> ''")
    arrival = F.coalesce("received_at", "event_time")
    first, last = deliveries.agg(F.min(F.unix_micros(arrival)), F.max(F.unix_micros(arrival))).first()
    width = max(1, -(-((last or 0) - (first or 0) + 1) // epochs))
    sha = hex_number(F.col("event_sha256"))
    hashes = claims.where("delivery_id is not null").select("delivery_id", sha.alias("sha")).where("sha is not null").select("delivery_id", F.xxhash64("sha").alias("h1"), F.xxhash64(F.lit(1), "sha").alias("h2"))
    hashes = hashes.groupBy("delivery_id").agg(F.min("h1").alias("h1"), F.min("h2").alias("h2"))
    keyed = rows.join(hashes, "delivery_id").select(
        F.xxhash64("id", "h1", "h2").alias("k1"),
        F.xxhash64("h2", "h1", "id").alias("k2"),
        F.coalesce(F.unix_micros("received_at"), F.lit(_LAST)).alias("at"),
        F.col("delivery_id").cast("long"),
        F.least("event_time", "received_at").alias("clock"),
        F.coalesce(F.call_function("div", F.unix_micros(arrival) - F.lit(first or 0), F.lit(width)), F.lit(epochs - 1)).cast("int").alias("epoch"),
    )
    return keyed.mapInArrow(_first_copies, T.StructType([*keyed.schema, T.StructField("lost", T.BooleanType())]))


def first_seen(stream: DataFrame, lateness: str, clock: str = "clock", keys: list[str] = _KEYS) -> DataFrame:
    """Rows of a stream whose keys are not in the state store; an entry expires once the watermark has passed it."""
    return stream.withWatermark(clock, lateness).dropDuplicatesWithinWatermark(keys)


@contextmanager
def _streaming_conf(spark: SparkSession, partitions: int | None):
    own = ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {}) | {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
        "spark.sql.streaming.minBatchesToRetain": "2",
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _rank() -> Column:
    """received_at, then delivery_id."""
    return packed(F.col("at"), F.col("delivery_id"))


class DeliveryLog:
    """Deliveries under one path: live/ (keyed rows by epoch), seen/ (output of the state store) and checkpoint/ (the store).

    A path that is there already is continued, with the lateness it began with: its store knows what earlier calls
    delivered, whoever made them. One call at a time may append.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, *, lateness: str = "2 days", buckets: int | None = None):
        self.spark, self.path, self.lateness, self.buckets = spark, path or shared_folder(spark, "delivery"), lateness, buckets
        self.fs, self.live = file_system(spark, f"{self.path}/live")
        self.fs.mkdirs(self.live)
        begun = file_system(spark, f"{self.path}/begun")[1]
        if self.fs.exists(begun):
            self.lateness = next(s.getPath().getName() for s in self.fs.listStatus(begun)).removeprefix("lateness=").replace("_", " ")
        else:
            self.fs.mkdirs(file_system(spark, f"{self.path}/begun/lateness={lateness.replace(' ', '_')}")[1])

    def append(self, deliveries: DataFrame, claims: DataFrame, *, epochs: int = 4) -> None:
        """Take up deliveries, in micro-batches by time of arrival."""
        staged = shared_folder(self.spark, "feed")
        delivery_feed(deliveries, claims, epochs).write.partitionBy("epoch").parquet(staged)
        if not any(s.getPath().getName().startswith("epoch=") for s in self.fs.listStatus(file_system(self.spark, staged)[1])):
            return
        clocks = {r.epoch: r.clock for r in self.spark.read.parquet(staged).groupBy("epoch").agg(F.max(F.unix_micros("clock")).alias("clock")).collect()}  # a row an epoch
        delay = self.spark.range(1).select(F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"interval {self.lateness}"))).first()[0]
        numbers = [int(s.getPath().getName().removeprefix("n=")) for s in self.fs.listStatus(self.live)]
        number, latest = max(numbers, default=-1) + 1, self._latest()
        with self._following():
            for epoch in sorted(clocks):
                after = _NEVER if latest is None else latest - delay
                self.fs.mkdirs(file_system(self.spark, f"{self.path}/live/n={number}")[1])
                place(self.spark, f"{staged}/epoch={epoch}", f"{self.path}/live/n={number}/after={after}")
                self.query.processAllAvailable()
                number += 1
                if clocks[epoch] is not None:
                    latest = clocks[epoch] if latest is None else max(latest, clocks[epoch])

    def _latest(self) -> int | None:
        return self._rows().agg(F.max(F.unix_micros("clock"))).first()[0] if self.fs.listStatus(self.live) else None

    @contextmanager
    def _following(self):
        stream = self.spark.readStream.schema(_LOG).parquet(f"{self.path}/live").where("not lost and unix_micros(clock) > after")
        seen = first_seen(stream, self.lateness).select(*_KEYS, "at", "delivery_id")
        with _streaming_conf(self.spark, self.buckets):
            self.query = seen.writeStream.format("parquet").outputMode("append").option("path", f"{self.path}/seen").option("checkpointLocation", f"{self.path}/checkpoint").start()
        try:
            yield
        finally:
            self.query.stop()
        dropped = sum(o["numRowsDroppedByWatermark"] for p in self.query.recentProgress for o in p["stateOperators"])
        if dropped:  # the log's own bound is no earlier than the watermark
            raise RuntimeError(f"{dropped} rows met the watermark unexpectedly")

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(_LOG).parquet(f"{self.path}/live")

    def seen(self) -> DataFrame:
        """(k1, k2, at, delivery_id): the deliveries whose identifier the state store did not hold."""
        return self.spark.read.schema("k1 long, k2 long, at long, delivery_id long").parquet(f"{self.path}/seen")

    def removed(self) -> DataFrame:
        """(delivery_id) of every delivery so far that is not to remain, whatever the order in which they came.

        What the store turned away, and what came too late for it, meets the seen delivery of its identifier: mostly that
        one remains, as epochs come in order of arrival. An identifier that was seen twice, after it had expired, counts
        all its seen deliveries.
        """
        if not self.fs.listStatus(self.live):
            return self.spark.createDataFrame([], "delivery_id long")
        rows, rank = self._rows(), _rank().alias("rank")
        kept = rows.where("not lost").select(*_KEYS, "at", "delivery_id")
        others = written(kept.join(self.seen().select("delivery_id"), "delivery_id", "left_anti").select(*_KEYS, "delivery_id", rank), "turned")
        held = self.seen().groupBy(*_KEYS).agg(F.min(rank).alias("first"), F.count("*").alias("times"))
        asked = others.groupBy(*_KEYS).agg(F.min("rank").alias("other"))
        settled = held.join(asked, _KEYS, "full").where("other is not null or times > 1")
        settled = written(settled.select(*_KEYS, "first", F.coalesce("times", F.lit(0)).alias("times"), F.least("first", "other").alias("winner")), "settled")
        mine = settled.select(*_KEYS, "winner")
        beaten = others.join(mine, _KEYS).where("rank <> winner").select("delivery_id")
        twice = self.seen().select(*_KEYS, "delivery_id", rank).join(settled.where("times > 1").select(*_KEYS, "winner"), _KEYS).where("rank <> winner").select("delivery_id")
        displaced = settled.where("times = 1 and first <> winner").select(packed_low(F.col("first")).alias("delivery_id"))
        return rows.where("lost").select("delivery_id").unionByName(beaten).unionByName(twice).unionByName(displaced).distinct()


def repeated_deliveries(deliveries: DataFrame, claims: DataFrame, *, epochs: int = 4, lateness: str = "2 days", buckets: int | None = None, path: str | None = None) -> DataFrame:
    """(delivery_id) of every row that is not to remain.

    deliveries: delivery_id, event_id, event_time, received_at; claims: delivery_id, event_sha256; other columns are
    ignored. Rows are one message when the trimmed event_id and the value of event_sha256 are equal; the row with the
    earliest received_at remains (null is last), of equals the smallest delivery_id. A null or blank event_id, or a
    row without a hash, makes a message of its own. Empty tables give no rows. Repeated rows of either table change
    nothing; claims of one delivery that differ count as one hash of their own.

    epochs: micro-batches of arrival time; lateness: how long after the latest event time an identifier stays in the
    state store; buckets: partitions of a new store, by default as many as of any shuffle. None of them changes the
    result, only what is found in the state and what by lookup. path: a log to continue; then all its deliveries so far
    count.
    """
    log = DeliveryLog(deliveries.sparkSession, path, lateness=lateness, buckets=buckets)
    log.append(deliveries, claims, epochs=epochs)
    return log.removed()
