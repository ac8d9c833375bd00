"""Attributes as known at event time, by dyadic time nodes.

A validity interval is the union of a few nodes of a binary tree over time; an instant lies in one node of each level.
So a point-in-interval join becomes an equi-join of (key, node), after which the interval's exact ends are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.fixed import parse_instant
from tidemark.sources.shared import written

#: A leaf covers 2^26 microseconds, some 67 seconds.
LEAF_BITS = 26
#: Without end: beyond the years that a TIMESTAMP can hold.
FOREVER = 1 << 60
#: Nodes are broadcast up to this many rows and bytes (both measured before use); beyond, points are routed by cells.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
#: Bits of microseconds that a cell may have: from a leaf to some 9 years.
CELL_BITS = range(LEAF_BITS, 49)


def interval_nodes(start: Column, end: Column, bits: int = LEAF_BITS) -> Column:
    """array<struct<level, node>> that covers the leaves, of 2^bits microseconds, that the half-open [start, end) touches."""
    first = F.shiftright(start, bits)
    beyond = F.shiftright(end - 1, bits) + 1

    def at(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        lo = F.call_function("shiftright", first + size - 1, level)
        hi = F.call_function("shiftright", beyond, level)
        odd = lambda x: F.pmod(x, F.lit(2)) == 1
        one = lambda cond, node: F.when(cond, F.struct(level.cast("int").alias("level"), node.alias("node")))
        return F.array(one((lo < hi) & odd(lo), lo), one((lo < hi) & odd(hi), hi - 1))

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(60 - bits + 1)), at)), lambda n: n.isNotNull())


def _probe(points: DataFrame, time: str, levels: list[int]) -> DataFrame:
    leaf = F.shiftright(F.col(time), LEAF_BITS)
    nodes = F.array(*[F.struct(F.lit(k).cast("int").alias("level"), F.shiftright(leaf, k).alias("node")) for k in levels])
    return points.select("*", F.inline(nodes)) if levels else points.select("*", F.lit(0).alias("level"), F.lit(0).cast("long").alias("node")).limit(0)


def _bytes(df: DataFrame) -> Column:
    return sum((F.coalesce(F.length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 16 for c in df.columns), F.lit(0))


def _cell_bits(intervals: DataFrame) -> int:
    """Cells about as long as the shorter quarter of the intervals: then few intervals share a cell but those that overlap, and few nodes cover one."""
    length = F.col("end") - F.col("start")
    usual = intervals.where(F.col("end") < FOREVER).agg(F.percentile_approx(length, 0.25, 1000)).first()[0]
    return min(max((usual or 1 << CELL_BITS[-1]).bit_length() - 1, CELL_BITS[0]), CELL_BITS[-1])


def _cell_join(points: DataFrame, intervals: DataFrame, key: str, time: str, also: Column, how: str) -> DataFrame:
    """Points and intervals meet at (key, cell) by the nodes over the cells; then the ends are compared.

    Only the cells that hold points are looked up, level by level; a point itself is moved once, whatever the levels.
    """
    lo, hi = points.agg(F.min(time), F.max(time)).first()  # the tree need be no higher than what is asked for
    lo, hi = (0, -1) if lo is None else (lo, hi)
    intervals = intervals.where((F.col("start") <= hi) & (F.col("end") > lo))
    bits = _cell_bits(intervals)
    nodes = written(intervals.select("*", F.inline(interval_nodes(F.greatest("start", F.lit(lo)), F.least("end", F.lit(hi + 1)), bits))), "nodes")
    levels = range(((hi >> bits) - (lo >> bits) + 1).bit_length() + 1)
    at = F.shiftright(F.col(time), bits)
    cells = points.select(key, at.alias("_ncell")).dropna().distinct()
    probes = cells.select(F.col(key).alias("_nkey"), "_ncell", F.inline(F.array(*[F.struct(F.lit(k).cast("int").alias("level"), F.shiftright("_ncell", k).alias("node")) for k in levels])))
    there = nodes.withColumnRenamed(key, "_nkey").join(probes, ["_nkey", "level", "node"]).drop("level", "node")
    on = (F.col(key) == F.col("_nkey")) & (F.col("_cell") == F.col("_ncell")) & (F.col("start") <= F.col(time)) & (F.col(time) < F.col("end")) & also
    return points.withColumn("_cell", at).join(there, on, how).drop("_cell", "_nkey", "_ncell")


def stab(points: DataFrame, intervals: DataFrame, key: str, time: str, *, how: str = "inner", also: Column | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Each point with each interval of its key that holds it: start <= time < end, in microseconds.

    points: key, time and other columns; intervals: key, start, end and other columns (names must not clash but for the
    key). Points without key or time and intervals without key, or empty ones, match nothing; with how 'left' points
    without a match come out once, with 'left_semi' those with one. also: a further condition of a match.
    """
    usable = written(intervals.where(F.col(key).isNotNull() & (F.col("start") < F.col("end"))), "intervals")
    also = F.lit(True) if also is None else also
    if how != "inner" or usable.count() * 8 > broadcast_rows:  # an interval has some ten nodes
        return _cell_join(points, usable, key, time, also, how)
    nodes = written(usable.select("*", F.inline(interval_nodes(F.col("start"), F.col("end")))), "nodes")
    count, size, levels = nodes.agg(F.count("*"), F.coalesce(F.sum(_bytes(nodes)), F.lit(0)), F.array_sort(F.collect_set("level"))).first()  # levels: 35 at most
    if count > broadcast_rows or size > BROADCAST_BYTES:
        return _cell_join(points, usable, key, time, also, how)
    probes = _probe(points.where(F.col(key).isNotNull() & F.col(time).isNotNull()), time, levels or [])
    joined = probes.join(F.broadcast(nodes), [key, "level", "node"])
    return joined.where((F.col("start") <= F.col(time)) & (F.col(time) < F.col("end")) & also).drop("level", "node")


def disjoint(intervals: DataFrame, key: str, rank: list[str], *, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Cut overlapping intervals of a key so that at each instant the one of the greatest rank is left.

    Winners change only at starts and ends; those instants are looked up in the intervals like events. Ranks within a
    key must be unequal where intervals overlap. An interval is over at the latest when one of greater rank without end
    begins; it is cut there first, so that versions that nobody closed don't pile up.
    """
    payload = [c for c in intervals.columns if c not in (key, "start", "end")]
    usable = intervals.where(F.col(key).isNotNull() & (F.col("start") < F.col("end")))
    better = Window.partitionBy(key).orderBy(*[F.desc(c) for c in rank]).rowsBetween(Window.unboundedPreceding, -1)
    covered = F.min(F.when(F.col("end") >= FOREVER, F.col("start"))).over(better)
    usable = usable.withColumn("end", F.least("end", F.coalesce(covered, F.lit(FOREVER)))).where("start < end")
    ends = usable.select(key, F.explode(F.array("start", "end")).alias("_from")).where(F.col("_from") < FOREVER).distinct()
    hits = stab(ends, usable, key, "_from", broadcast_rows=broadcast_rows)
    best = hits.groupBy(key, "_from").agg(F.max_by(F.struct(*payload), F.struct(*rank)).alias("_best"))
    following = F.lead("_from").over(Window.partitionBy(key).orderBy("_from"))
    cut = ends.join(best, [key, "_from"], "left").withColumn("end", F.coalesce(following, F.lit(FOREVER)))
    return cut.where("_best is not null").select(key, F.col("_from").alias("start"), "end", *[F.col(f"_best.{c}").alias(c) for c in payload])


def catalog_validity(catalog: DataFrame) -> DataFrame:
    """(symbol, start, end, effective_from, catalog_row_id, settlement_currency): when each catalog row counts.

    Of rows of one symbol and effective_from, each counts from its available_at until that of the next; of equal
    available_at only the smallest catalog_row_id does. A row without symbol, effective_from or available_at never counts.
    """
    us = lambda c: F.unix_micros(c)
    rows = catalog.where("symbol is not null and effective_from is not null and available_at is not null").select("symbol", us("effective_from").alias("effective_from"), us("available_at").alias("_known"), F.coalesce(us("effective_to"), F.lit(FOREVER)).alias("_to"), "catalog_row_id", "settlement_currency")
    version = ["symbol", "effective_from"]
    one = rows.groupBy(*version, "_known").agg(F.min_by(F.struct("_to", "settlement_currency"), "catalog_row_id").alias("_r"), F.min("catalog_row_id").alias("catalog_row_id"))
    until = F.lead("_known").over(Window.partitionBy(*version).orderBy("_known"))
    return one.select("symbol", F.greatest("effective_from", "_known").alias("start"), F.least("_r._to", F.coalesce(until, F.lit(FOREVER))).alias("end"), "effective_from", "catalog_row_id", "_r.settlement_currency")


def rate_validity(rates: DataFrame, quote: str) -> DataFrame:
    """(settlement_currency, start, end, fx_event_id): disjoint, from when a rate to ``quote`` may be used until a later one.

    A rate may be used from the later of observed_at and available_at; the latest observed_at wins, then the latest
    available_at, then the smallest event_id. The time before a currency's first rate has the empty string.
    """
    rows = rates.where((F.col("quote_currency") == quote) & F.col("base_currency").isNotNull() & (F.col("base_currency") != quote))
    rows = rows.select(F.col("base_currency").alias("settlement_currency"), F.unix_micros(parse_instant(F.col("observed_at"))).alias("_seen"), F.unix_micros(parse_instant(F.col("available_at"))).alias("_known"), F.col("event_id").alias("fx_event_id"))
    rows = rows.where("_seen is not null and _known is not null").groupBy("settlement_currency", "_seen", "_known").agg(F.min("fx_event_id").alias("fx_event_id"))
    rows = rows.withColumn("start", F.greatest("_seen", "_known"))
    better = Window.partitionBy("settlement_currency").orderBy(F.desc("_seen"), F.desc("_known")).rowsBetween(Window.unboundedPreceding, -1)
    used = rows.withColumn("end", F.coalesce(F.min("start").over(better), F.lit(FOREVER))).where("start < end").select("settlement_currency", "start", "end", "fx_event_id")
    before = rows.groupBy("settlement_currency").agg(F.min("start").alias("end")).select("settlement_currency", F.lit(-FOREVER).alias("start"), "end", F.lit("").alias("fx_event_id"))
    return used.unionByName(before)


def as_known(events: DataFrame, catalog: DataFrame, rates: DataFrame, *, quote: str = "USD", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(delivery_id, catalog_row_id, fx_event_id) of each event with an instrument_id and a catalog row.

    The symbol is the third part of instrument_id. fx_event_id is the empty string where no rate may be used or the
    currency is ``quote`` or null. Events without instrument_id or event_time have no row; repeated rows have one each.
    """
    points = events.select("delivery_id", F.get(F.split("instrument_id", ":"), 2).alias("symbol"), F.unix_micros("event_time").alias("_at")).where("symbol is not null and _at is not null")
    rows = disjoint(catalog_validity(catalog), "symbol", ["effective_from"], broadcast_rows=broadcast_rows).drop("effective_from")
    rows = written(rows.withColumn("settlement_currency", F.coalesce("settlement_currency", F.lit(""))), "catalog")
    rate = rate_validity(rates, quote)
    whole = rows.select("settlement_currency").distinct().join(rate.select("settlement_currency").distinct(), "settlement_currency", "left_anti")
    rate = rate.unionByName(whole.select("settlement_currency", F.lit(-FOREVER).alias("start"), F.lit(FOREVER).alias("end"), F.lit("").alias("fx_event_id")))
    known = stab(points, rows, "symbol", "_at", broadcast_rows=broadcast_rows).drop("start", "end", "symbol")
    return stab(known, rate, "settlement_currency", "_at", broadcast_rows=broadcast_rows).select("delivery_id", "catalog_row_id", "fx_event_id")
