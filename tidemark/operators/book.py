"""Order books replayed in sequence, with what breaks them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.functions.fixed import fixed_e8
from tidemark.functions.text import plain

STREAM = ["source", "instrument_id", "session_id"]
_OUT = "source string, instrument_id string, session_id string, sequence long, events long, n_bids int, n_asks int, best_bid long, best_ask long, tolerated long, violation string, at_sequence long, state_sha256 string, checkpoints array<struct<sequence: bigint, sha256: string>>"


class _Rows:
    """A batch of events as arrays; the last row only tells what follows the one before it, unless the input ends."""

    NUMBERS = ("sequence", "event_time", "price", "price_scale", "quantity", "previous_sequence")

    def __init__(self, batch: pa.RecordBatch):
        self.batch = batch
        column = {n: batch.column(n) for n in self.NUMBERS}
        whole = {n: c.fill_null(0).to_numpy(zero_copy_only=False) for n, c in column.items()}
        self.sequence, self.time, self.price, self.scale, self.quantity, self.previous = (whole[n] for n in self.NUMBERS)
        text = lambda n, v: pc.fill_null(pc.equal(batch.column(n), v), False).to_numpy(zero_copy_only=False)
        self.snapshot, self.bid, self.gone = text("kind", "book_snapshot"), text("side", "bid"), text("action", "delete")
        valid = np.logical_and.reduce([np.asarray(column[n].is_valid()) for n in self.NUMBERS if n != "quantity"])
        self.usable = valid & (self.bid | text("side", "ask")) & (self.gone | np.asarray(column["quantity"].is_valid()))
        n = batch.num_rows
        self.ends = np.ones(n, bool)  # the next row is another stream's
        if n > 1:
            same = np.ones(n - 1, bool)
            for c in STREAM:
                a, b = batch.column(c)[:-1], batch.column(c)[1:]
                same &= pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False) | (~np.asarray(a.is_valid()) & ~np.asarray(b.is_valid()))
            self.ends[:-1] = ~same

    def stream(self, i: int) -> tuple:
        return tuple(self.batch.column(c)[i].as_py() for c in STREAM)

    def following(self, i: int) -> int | None:
        return None if self.ends[i] else int(self.sequence[i + 1])

    def event(self, i: int) -> SimpleNamespace:
        row = {n: self.batch.column(n)[i].as_py() for n in ("kind", "side", "action", *self.NUMBERS)}
        for c in ("bids", "asks"):
            v = self.batch.column(c)[i].as_py()
            row[c] = None if v is None else tuple(zip(*json.loads(v)))
        return SimpleNamespace(**row)


class _Book:
    def __init__(self, stream, wanted: frozenset, group: int, tolerate: frozenset):
        self.stream, self.wanted, self.group, self.tolerate = stream, wanted, group, tolerate
        self.sides = {"bid": {}, "ask": {}}
        self.sequence = self.scale = self.violation = self.at = self.time = None
        self.events, self.tolerated, self.checkpoints = 0, 0, []

    def fail(self, why: str, sequence: int) -> bool:
        """True if the stream stops here; what is tolerated is counted and passes."""
        if why in self.tolerate:
            self.tolerated += 1
            return False
        self.violation, self.at = why, sequence
        return True

    def crossed(self) -> bool:
        bids, asks = self.sides["bid"], self.sides["ask"]
        return bool(bids and asks and max(bids) >= min(asks))

    def hash(self) -> str:
        state = [*self.stream, self.sequence, self.scale, sorted(self.sides["bid"].items(), reverse=True), sorted(self.sides["ask"].items())]
        return hashlib.sha256(json.dumps(state, separators=(",", ":")).encode()).hexdigest()

    def apply(self, e, following) -> None:
        """following: the sequence of the next event of the stream, or None."""
        if self.violation:
            return
        self.events += 1
        if self.time is not None and e.event_time is not None and e.event_time < self.time and self.fail("time_reversed", e.sequence):
            return
        if e.kind == "book_snapshot":
            if self.sequence is not None and e.sequence <= self.sequence and self.fail("snapshot_not_advancing", e.sequence):
                return
            levels = [(s, p, q, k) for s, side in (("bid", e.bids), ("ask", e.asks)) for p, q, k in zip(*(side or ((), (), ())))]
            if any(q is None or q <= 0 for _, _, q, _ in levels):
                if self.fail("empty_level", e.sequence):
                    return
                levels = [x for x in levels if x[2] is not None and x[2] > 0]
            scales = {k for *_, k in levels}
            if len(scales) > 1 or (not scales and self.fail("scale_changed", e.sequence)):  # prices of two scales can't be compared, whatever is tolerated
                self.violation, self.at = "scale_changed", e.sequence
                return
            self.scale = levels[0][3] if levels else self.scale
            self.sides = {s: {p: q for t, p, q, _ in levels if t == s} for s in ("bid", "ask")}
        else:
            if self.sequence is None:
                if self.fail("no_snapshot", e.sequence):
                    return
                self.scale = e.price_scale
            elif e.previous_sequence != self.sequence and self.fail("sequence_gap", e.sequence):
                return
            self.scale = e.price_scale if self.scale is None else self.scale
            if e.price_scale != self.scale:
                self.violation, self.at = "scale_changed", e.sequence
                return
            side = self.sides.get(e.side)
            if side is None or e.price is None:
                if self.fail("no_level", e.sequence):
                    return
            elif e.action == "delete":
                if e.price not in side:
                    if self.fail("absent_level", e.sequence):
                        return
                else:
                    del side[e.price]
            else:
                side[e.price] = e.quantity
        self.sequence, self.time = e.sequence, e.event_time if self.time is None else self.time if e.event_time is None else max(self.time, e.event_time)
        # levels of one provider update may cross each other until the last of them
        within = self.group > 1 and following is not None and following // self.group == e.sequence // self.group
        if not within and self.crossed() and self.fail("crossed", e.sequence):
            return
        if self.sequence in self.wanted:
            self.checkpoints.append({"sequence": self.sequence, "sha256": self.hash()})

    def advance(self, rows: _Rows, lo: int, hi: int) -> None:
        """Apply rows [lo, hi): deltas in one step where none can break the book, else in halves, and few rows one by one."""
        while lo < hi and not self.violation:
            if rows.snapshot[lo]:
                self.apply(rows.event(lo), rows.following(lo))
                lo += 1
                continue
            stops = np.flatnonzero(rows.snapshot[lo:hi])
            end = lo + int(stops[0]) if len(stops) else hi
            if self.wanted:  # a step ends with the event that a checkpoint is about
                marks = np.flatnonzero(np.isin(rows.sequence[lo:end], list(self.wanted)))
                end = lo + int(marks[0]) + 1 if len(marks) else end
            self._deltas(rows, lo, end)
            lo = end

    def _deltas(self, rows: _Rows, lo: int, hi: int) -> None:
        if hi - lo > 32 and self._whole_step(rows, lo, hi):
            return
        if hi - lo <= 32:
            for i in range(lo, hi):
                self.apply(rows.event(i), rows.following(i))
            return
        middle = (lo + hi) // 2
        self._deltas(rows, lo, middle)
        if not self.violation:
            self._deltas(rows, middle, hi)

    def _whole_step(self, rows: _Rows, lo: int, hi: int) -> bool:
        """Apply deltas [lo, hi) at once; false, and nothing done, unless it is sure that none breaks the book."""
        if self.sequence is None or not rows.usable[lo:hi].all():
            return False
        at, price, bid, gone = rows.sequence[lo:hi], rows.price[lo:hi], rows.bid[lo:hi], rows.gone[lo:hi]
        time = rows.time[lo:hi]
        if rows.previous[lo] != self.sequence or (rows.previous[lo + 1 : hi] != at[:-1]).any() or (rows.scale[lo:hi] != self.scale).any():
            return False
        if (self.time is not None and time[0] < self.time) or (time[1:] < time[:-1]).any():
            return False
        bids, asks = price[bid & ~gone], price[~bid & ~gone]
        highest = max([*([int(bids.max())] if len(bids) else []), *([max(self.sides["bid"])] if self.sides["bid"] else [])], default=None)
        lowest = min([*([int(asks.min())] if len(asks) else []), *([min(self.sides["ask"])] if self.sides["ask"] else [])], default=None)
        if highest is not None and lowest is not None and highest >= lowest:
            return False
        order = np.lexsort((np.arange(hi - lo), price, bid))
        p, b, g = price[order], bid[order], gone[order]
        first = np.ones(hi - lo, bool)
        first[1:] = (p[1:] != p[:-1]) | (b[1:] != b[:-1])
        if (g[1:] & g[:-1] & ~first[1:]).any():
            return False
        if any(int(x) not in self.sides["bid" if y else "ask"] for x, y in zip(p[first & g], b[first & g])):
            return False
        last = np.append(first[1:], True)
        quantity = rows.quantity[lo:hi][order]
        for x, y, out, q in zip(p[last].tolist(), b[last].tolist(), g[last].tolist(), quantity[last].tolist()):  # levels that were touched
            side = self.sides["bid" if y else "ask"]
            if out:
                side.pop(x, None)
            else:
                side[x] = q
        self.sequence, self.time, self.events = int(at[-1]), int(time[-1]), self.events + hi - lo
        if self.sequence in self.wanted:
            self.checkpoints.append({"sequence": self.sequence, "sha256": self.hash()})
        return True

    def row(self) -> dict:
        bids, asks = self.sides["bid"], self.sides["ask"]
        names = dict(zip(STREAM, self.stream))
        return names | {"sequence": self.sequence, "events": self.events, "n_bids": len(bids), "n_asks": len(asks), "best_bid": max(bids, default=None), "best_ask": min(asks, default=None), "tolerated": self.tolerated, "violation": self.violation, "at_sequence": self.at, "state_sha256": None if self.sequence is None else self.hash(), "checkpoints": self.checkpoints}


def replay(events: DataFrame, *, checkpoints: tuple[int, ...] = (), group: int = 1, tolerate: tuple[str, ...] = ()) -> DataFrame:
    """One row a stream: the book after its last good event, its hash, and the first violation, after which the stream stops.

    events: STREAM, kind, sequence, event_time, and side, action, price, quantity (fixed point), previous_sequence of
    deltas or bids, asks of snapshots. group: sequences per provider update; with more than 1 a book may be crossed
    inside an update. A stream is read in order by one task without being held as a whole: each event depends on all
    before; but a stretch of deltas that surely breaks nothing is one step of arrays. Equal sequences are in the order of
    event_id. tolerate: violations that are counted and passed over: a delete of an absent level and a row without level
    change nothing, a stream without snapshot starts empty, empty levels of a snapshot are left out.
    """
    # text, as Spark hands over nested arrays some hundred times slower, null or not
    units = lambda c: F.when(F.col(c).isNotNull(), F.to_json(F.transform(c, lambda x: F.array(x["price"]["units"], x["quantity"]["units"], x["price"]["scale"].cast("long")))))
    flat = events.select(*STREAM, "kind", "sequence", F.unix_micros("event_time").alias("event_time"), "event_id", "side", "action", F.col("price.units").alias("price"), F.col("price.scale").cast("long").alias("price_scale"), F.col("quantity.units").alias("quantity"), "previous_sequence", units("bids").alias("bids"), units("asks").alias("asks"))
    rows = flat.repartition(*STREAM).sortWithinPartitions(*STREAM, "sequence", "event_id")
    wanted, passed = frozenset(checkpoints), frozenset(tolerate)
    made = to_arrow_schema(T._parse_datatype_string(_OUT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, held = None, None

        def apply(rows: _Rows, count: int) -> Iterator[pa.RecordBatch]:
            nonlocal book
            lo, done = 0, []
            for stop in [*np.flatnonzero(rows.ends[:count]).tolist(), count - 1]:
                if lo <= stop:
                    book = book or _Book(rows.stream(lo), wanted, group, passed)
                    book.advance(rows, lo, stop + 1)
                    if rows.ends[stop]:
                        done.append(book.row())
                        book = None
                    lo = stop + 1
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=made)

        for batch in batches:
            if batch.num_rows:
                batch = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
                held = batch.slice(batch.num_rows - 1)  # what follows the last row is not known yet
                yield from apply(_Rows(batch), batch.num_rows - 1)
        if held is not None:
            yield from apply(_Rows(held), 1)

    return rows.mapInArrow(run, _OUT)


def book_events(deltas: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Deltas and snapshots as one stream, one row of each change; side and action in plain spelling."""
    key = [*STREAM, "sequence"]
    d = deltas.groupBy(*key).agg(F.min_by(F.struct("event_time", "event_id", "side", "action", "price", "quantity", "previous_sequence"), F.struct("event_time", "event_id")).alias("_e")).select(*key, "_e.*")
    removed = (F.coalesce(plain(F.col("action")), F.lit("")) == "delete") | (F.col("quantity.units") == 0)
    d = d.withColumn("side", plain(F.col("side"))).withColumn("action", F.when(removed, "delete").otherwise("upsert")).withColumn("kind", F.lit("book_delta"))
    s = snapshots.groupBy(*key).agg(F.min_by(F.struct("event_time", "event_id", "bids", "asks"), F.struct("event_time", "event_id")).alias("_e")).select(*key, "_e.*").withColumn("kind", F.lit("book_snapshot"))
    return d.unionByName(s, allowMissingColumns=True)


def standing_events(deltas: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The last snapshot of each stream and the changes after it, for a replay: prices and quantities at scale 8, one row of each change.

    A null quantity or one of zero is a delete. Changes up to the snapshot's sequence, and rows without side, price or
    sequence, are left out.
    """
    scaled = lambda c: F.struct(fixed_e8(c).alias("units"), F.lit(8).cast("smallint").alias("scale"))
    levels = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast(snapshots.schema[c].dataType)), lambda x: F.struct(scaled(x["price"]).alias("price"), scaled(x["quantity"]).alias("quantity"), x["order_count"].alias("order_count")))
    last = snapshots.where("sequence is not null").groupBy(*STREAM).agg(F.max("sequence").alias("_last"))
    same = [F.col(f"e.{k}").eqNullSafe(F.col(f"l.{k}")) for k in STREAM]
    s = snapshots.alias("e").join(last.alias("l"), [*same, F.col("e.sequence") == F.col("l._last")], "left_semi").withColumns({"bids": levels("bids"), "asks": levels("asks")})
    d = deltas.alias("e").join(last.alias("l"), same, "left").where("e.sequence is not null and (l._last is null or e.sequence > l._last)").select("e.*")
    quantity, price = scaled(F.col("quantity")), scaled(F.col("price"))
    d = d.withColumns({"quantity": quantity, "price": price})
    d = d.withColumn("action", F.when(F.coalesce(F.col("quantity.units"), F.lit(0)) == 0, "delete").otherwise(F.col("action")))
    return book_events(d.where("price.units is not null").where(plain(F.col("side")).isin("bid", "ask")), s)
