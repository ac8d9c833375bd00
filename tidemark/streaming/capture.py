"""Live capture: books kept in step with their feed, bars over streams, sinks that publish each batch once."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.sources.shared import drop_folder, file_system, move_into_place

# States of a feed, and where each may go.
STATES = ("CONNECTING", "BUFFERING", "SNAPSHOT_SYNC", "LIVE", "RESYNC", "PAUSED")
MOVES = {
    "CONNECTING": {"BUFFERING", "RESYNC", "PAUSED"}, "BUFFERING": {"SNAPSHOT_SYNC", "RESYNC", "PAUSED"}, "SNAPSHOT_SYNC": {"LIVE", "RESYNC", "PAUSED"},
    "LIVE": {"RESYNC", "PAUSED"}, "RESYNC": {"CONNECTING", "BUFFERING", "PAUSED"}, "PAUSED": {"CONNECTING"},
}

_OUT = "stream string, first_id long, last_id long, outcome string, state string"


class FeedSync:
    """One feed of ranged updates [first_id, last_id] with an optional id of the update before, and snapshots (first_id null)."""

    def __init__(self, state: str = "BUFFERING", last: int = -1, bridged: bool = False, chained: bool = False, held: list | None = None, overlap: bool = False):
        self.state, self.last, self.bridged, self.chained, self.held, self.overlap = state, last, bridged, chained, held or [], overlap

    def release(self) -> Iterator[tuple[int, int, str]]:
        """(first, last, outcome) of the frames that waited for the snapshot, in order; those that it holds already have none."""
        waiting, self.held = self.held, []
        for first, last, previous in waiting:
            outcome = self.admit(first, last, previous)
            if outcome not in ("late", "buffered"):  # buffered: after a gap they wait for the next snapshot
                yield first, last, outcome

    def admit(self, first: int | None, last: int, previous: int | None) -> str:
        """Outcome of a frame: snapshot, buffered, late, duplicate, bridge, live, gap or reset (an id below its own previous)."""
        if first is None:
            if self.state == "LIVE" and last <= self.last:
                return "duplicate"
            self.state, self.last, self.bridged = "SNAPSHOT_SYNC", last, False
            return "snapshot"
        if self.state in ("CONNECTING", "BUFFERING", "RESYNC"):
            self.state = "BUFFERING"
            self.held.append((first, last, previous))
            return "buffered"
        if previous is not None and last < previous:
            self.state, self.bridged = "RESYNC", False
            return "reset"
        if last <= self.last:
            return "late" if not self.bridged else "duplicate"
        if last < first:
            self.state, self.bridged = "RESYNC", False
            return "gap"
        if not self.bridged:  # the first update must hold the snapshot's id, or, unless overlap is asked for, the next one
            if first <= self.last <= last or (not self.overlap and first <= self.last + 1 <= last):
                self.state, self.last, self.bridged = "LIVE", last, True
                return "bridge"
        elif (previous == self.last) if self.chained and previous is not None else (first <= self.last + 1 <= last):
            self.last = last
            return "live"
        self.state, self.bridged = "RESYNC", False
        return "gap"


def _sync(chained: bool, overlap: bool):
    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        feed = FeedSync(chained=chained, overlap=overlap)
        if state.exists:
            *at, waiting = state.get
            feed = FeedSync(*at, chained, json.loads(waiting), overlap)
        held = pd.concat(list(frames)).sort_values("ordinal", kind="stable")  # one micro-batch of one feed
        out = []
        for f in held.itertuples(index=False):
            first = None if pd.isna(f.first_id) else int(f.first_id)
            previous = None if pd.isna(f.previous_id) else int(f.previous_id)
            outcome = feed.admit(first, int(f.last_id), previous)
            out.append((key[0], first, int(f.last_id), outcome, feed.state))
            if outcome == "snapshot":
                out += [(key[0], *frame, feed.state) for frame in feed.release()]
        state.update((feed.state, feed.last, feed.bridged, json.dumps(feed.held)))
        frame = pd.DataFrame(out, columns=["stream", "first_id", "last_id", "outcome", "state"])
        frame["first_id"] = frame["first_id"].astype("Int64")
        yield frame

    return step


def synchronised(frames: DataFrame, *, chained: bool = False, overlap: bool = False) -> DataFrame:
    """(stream, first_id, last_id, outcome, state) of each frame of a streaming frame (stream, ordinal, first_id, last_id, previous_id).

    chained: updates follow by previous_id. overlap: the first one after a snapshot must hold the snapshot's own id.
    Frames that come before the snapshot are buffered in the state and have a second row once it lets them in; a buffered
    frame without one is in the snapshot, or still waits.
    """
    return frames.groupBy("stream").applyInPandasWithState(_sync(chained, overlap), _OUT, "state string, last long, bridged boolean, held string", "append", GroupStateTimeout.NoTimeout)


def streaming_bars(trades: DataFrame, *, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """OHLCV over event time in append mode: a bar comes out once the watermark has passed its end."""
    order = F.struct("event_time", "sequence", "event_id")
    agg = [F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("quantity").alias("volume"), F.count("*").alias("trades")]
    bars = trades.withWatermark("event_time", lateness).groupBy("source", "instrument_id", F.window("event_time", width).alias("w")).agg(*agg)
    return bars.select("source", "instrument_id", F.col("w.start").alias("bar_start"), F.col("w.end").alias("bar_end"), "open", "high", "low", "close", "volume", "trades")


def publish_each_batch_once(root: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: batch n is written beside its folder and renamed into it; a batch that is there already is left as it is."""

    def publish(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fs, place = file_system(spark, f"{root}/batch={number:020d}")
        if fs.exists(place):
            return
        staging = f"{root}/.batch-{number}"
        transform(batch).write.mode("overwrite").parquet(staging)
        if not move_into_place(spark, staging, f"{root}/batch={number:020d}"):  # another attempt was first
            drop_folder(spark, staging)

    return publish


def published(spark, root: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{root}/batch=*")


def increasing_receipts(df: DataFrame, stream: str, received: str, order: str) -> DataFrame:
    """received_at made strictly increasing in a stream: at least a microsecond after the one before.

    max over earlier rows of (time - rank) + rank: a running maximum instead of a loop.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(stream).orderBy(order)
    n = F.row_number().over(w)
    lead = F.max(F.unix_micros(received) - n).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(received, F.timestamp_micros(lead + n))
