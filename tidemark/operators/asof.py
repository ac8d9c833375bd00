"""Joins and views that use only what was known.

As-of joins scan observations and facts of a key together in time order. Time is cut into slices and the scan runs in
each (key, slice), with the winner of the slices before it carried in; so a key with most of the rows is spread over as
many tasks as it has slices.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.checks import ValidationError, require_columns, strict
from tidemark.operators.dyadic import FOREVER, stab
from tidemark.sources.shared import written

#: Width of a slice in seconds.
SLICE = 7 * 86400


def _slice(time: str, width: int) -> Column:
    return F.floor(F.col(time).cast("timestamp").cast("double") / width).cast("long")


def scan_join(observations: DataFrame, facts: DataFrame, by: list[str], time: str, visible: Column, rank: list[Column], payload: dict[str, Column], *, slice_seconds: int = SLICE) -> DataFrame:
    """Observations with the payload of the fact of greatest rank among those visible at their time (equal times count).

    Keys join by equality, so a null key finds nothing. Facts without a visible time are never seen. Every observation
    comes out once, with null payload where it saw nothing. The payload must be orderable: it decides between equal ranks.
    """
    require_columns(observations, [*by, time])
    require_columns(facts, by)
    own = observations.columns
    known = facts.select(*by, visible.cast("timestamp").alias("_at"), F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)], *[c.alias(n) for n, c in payload.items()]).alias("_f"))
    known = known.where(F.col("_at").isNotNull() & reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in by])).withColumn("_s", _slice("_at", slice_seconds))
    seen = observations.withColumn("_o", F.struct(*[F.col(c) for c in own])).select(*by, F.col(time).cast("timestamp").alias("_at"), "_o").withColumn("_s", _slice("_at", slice_seconds))
    # the winner of each slice of facts, and of all slices before each slice that has observations or facts
    last = known.groupBy(*by, "_s").agg(F.max("_f").alias("_f"))
    asked = seen.select(*by, "_s").distinct().withColumn("_f", F.lit(None).cast(known.schema["_f"].dataType))
    order = Window.partitionBy(*by).orderBy("_s")
    both = last.unionByName(asked).groupBy(*by, "_s").agg(F.max("_f").alias("_f"))
    carried = both.select(*by, "_s", F.max("_f").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_f")).where("_f is not null")
    carried = carried.select(*by, F.lit(None).cast("timestamp").alias("_at"), "_s", F.lit(0).alias("_side"), "_f")
    kind = observations.select(F.struct(*own)).schema[0].dataType
    right = known.select(*by, "_at", "_s", F.lit(1).alias("_side"), "_f").unionByName(carried).withColumn("_o", F.lit(None).cast(kind))
    left = seen.select(*by, "_at", "_s", F.lit(2).alias("_side"), F.lit(None).cast(known.schema["_f"].dataType).alias("_f"), "_o")
    in_slice = Window.partitionBy(*by, "_s").orderBy(F.col("_at").asc_nulls_first(), "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scanned = left.unionByName(right).withColumn("_w", F.max("_f").over(in_slice)).where("_side = 2")
    unknown = F.col("_at").isNull() | reduce(lambda a, b: a | b, [F.col(k).isNull() for k in by])
    return scanned.select(*[F.col(f"_o.{c}").alias(c) for c in own], *[F.when(~unknown, F.col(f"_w.{n}")).alias(n) for n in payload])


def fact_conflicts(facts: DataFrame, by: list[str], available: str, columns: list[str]) -> DataFrame:
    """(by, available, versions): one key and availability with unlike values. Equal rows are harmless."""
    return facts.select(*by, available, *columns).distinct().groupBy(*by, available).agg(F.count("*").alias("versions")).where("versions > 1")


def point_in_time_join(observations: DataFrame, facts: DataFrame, *, time: str = "date", available: str = "available_at", by: tuple[str, ...] = ("symbol",), columns: list[str] | None = None, max_age: str | None = None, output: str = "source_available_at", check: bool = True, slice_seconds: int = SLICE) -> DataFrame:
    """Observations with the facts last available by their time; ``max_age`` (an interval, inclusive) applies to that fact only.

    A fact too old leaves nulls, never an older one. Facts of one key and availability with unlike values raise.
    """
    by = list(by)
    columns = [c for c in facts.columns if c not in {*by, available}] if columns is None else columns
    require_columns(facts, [*by, available, *columns])
    if check:
        strict(fact_conflicts(facts, by, available, columns), "conflicting facts of one key and availability")
    out = scan_join(observations, facts, by, time, F.col(available), [F.col(available)], {output: F.col(available), **{c: F.col(c) for c in columns}}, slice_seconds=slice_seconds)
    if max_age is None:
        return out
    fresh = F.col(time).cast("timestamp") <= F.col(output).cast("timestamp") + F.expr(f"interval {max_age}")
    return out.withColumns({c: F.when(fresh, F.col(c)) for c in columns} | {output: F.when(fresh, F.col(output))})


def two_clock_join(observations: DataFrame, facts: DataFrame, *, time: str, by: tuple[str, ...], effective: str = "effective_at", available: str = "available_at", columns: list[str], max_age: str | None = None) -> DataFrame:
    """The fact of the latest (effective, available) with both not after the observation; then dropped if effective is older than max_age."""
    rank = [F.col(effective), F.col(available)]
    out = scan_join(observations, facts, list(by), time, F.greatest(*rank), rank, {**{c: F.col(c) for c in columns}, f"source_{effective}": rank[0], f"source_{available}": rank[1]})
    # greatest() skips nulls: a fact without one of its clocks is never known
    if max_age is None:
        return out
    fresh = F.col(time).cast("timestamp") <= F.col(f"source_{effective}").cast("timestamp") + F.expr(f"interval {max_age}")
    return out.withColumns({c: F.when(fresh, F.col(c)) for c in [*columns, f"source_{effective}", f"source_{available}"]})


def audit_point_in_time(df: DataFrame, *, time: str = "date", available: str = "source_available_at", max_age: str | None = None) -> DataFrame:
    """(rows, matched_rows, unavailable_rows, stale_rows), one row."""
    t, a = F.col(time).cast("timestamp"), F.col(available).cast("timestamp")
    stale = F.lit(False) if max_age is None else t > a + F.expr(f"interval {max_age}")
    return df.agg(F.count("*").alias("rows"), F.count(available).alias("matched_rows"), F.count_if(a > t).alias("unavailable_rows"), F.count_if(stale).alias("stale_rows"))


def refuse_future(df: DataFrame, *, time: str = "date", available: str = "source_available_at") -> DataFrame:
    strict(df.where(F.col(available).cast("timestamp") > F.col(time).cast("timestamp")), "rows from the future")
    return df


def _micros(name: str, otherwise: int | None = None) -> Column:
    us = F.unix_micros(F.col(name).cast("timestamp"))
    return us if otherwise is None else F.coalesce(us, F.lit(otherwise))


def bitemporal_conflicts(facts: DataFrame, keys: list[str], *, effective_from: str = "effective_from", effective_to: str = "effective_to", available: str = "available_at", superseded: str = "superseded_at") -> DataFrame:
    """(keys, effective_from, available_at): each fact that overlaps one of its key known before it (or at once) on both clocks.

    Of two facts that overlap, one begins while the other is valid; so the starts of either are looked up in the
    validity of the other by dyadic nodes, and the clock of knowledge is compared for what meets there. A key with most
    of the facts is spread over its cells of time. Copies of a fact overlap each other. Null keys are keys.
    """
    clocks = [_micros(effective_from).alias("f"), _micros(effective_to, FOREVER).alias("t"), _micros(available).alias("a"), _micros(superseded, FOREVER).alias("s")]
    kinds = facts.groupBy(F.struct(*keys).alias("key"), *clocks).agg(F.count("*").alias("copies")).where("f < t and a < s")
    kinds = written(kinds, "facts")
    side = lambda p: kinds.select(F.xxhash64(*[F.col("key")[k] for k in keys]).alias(f"{p}_h"), *[F.col(c).alias(f"{p}_{c}") for c in kinds.columns])
    before = F.col("l_key").eqNullSafe(F.col("r_key")) & (F.struct("l_a", "l_f", "l_t", "l_s") < F.struct("r_a", "r_f", "r_t", "r_s")) & (F.col("r_a") < F.col("l_s"))
    spans = lambda p: side(p).withColumnsRenamed({f"{p}_h": "h"}).withColumns({"start": F.col(f"{p}_f"), "end": F.col(f"{p}_t")})
    points = lambda p: side(p).withColumnRenamed(f"{p}_h", "h")
    columns = [f"r_{c}" for c in kinds.columns]
    begun = stab(points("r"), spans("l"), "h", "r_f", how="left_semi", also=before).select(columns)
    held = stab(points("l"), spans("r"), "h", "l_f", also=before).select(columns).distinct()
    whole = begun.unionByName(held).distinct().withColumn("_n", F.col("r_copies"))
    copied = kinds.where("copies > 1").select([F.col(c).alias(f"r_{c}") for c in kinds.columns]).withColumn("_n", F.col("r_copies") - 1)
    found = whole.unionByName(copied).groupBy(*columns).agg(F.max("_n").alias("_n")).withColumn("_i", F.explode(F.array_repeat(F.lit(0), F.col("_n").cast("int"))))
    return found.select("r_key.*", F.timestamp_micros("r_f").alias("effective_from"), F.timestamp_micros("r_a").alias("available_at"))


def bitemporal_join(observations: DataFrame, facts: DataFrame, *, time: str = "observation_time", as_of: str = "as_of", by: tuple[str, ...] = ("instrument_id",), columns: list[str] | None = None, effective_from: str = "effective_from", effective_to: str = "effective_to", available: str = "available_at", superseded: str = "superseded_at", check: bool = True) -> DataFrame:
    """The fact valid at ``time`` and known at ``as_of``, both half-open, null ends open. Several raise.

    Observations meet facts at the dyadic nodes of their validity, so a key with most of the rows is spread over its
    cells of time; each comes out once, with nulls where it has no fact. Null keys and times find nothing.
    """
    by = list(by)
    clocks = [effective_from, effective_to, available, superseded]
    columns = [c for c in facts.columns if c not in {*by, *clocks}] if columns is None else columns
    if check:
        strict(bitemporal_conflicts(facts, by, effective_from=effective_from, effective_to=effective_to, available=available, superseded=superseded), "ambiguous bitemporal facts")
    key = lambda: F.when(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in by]), F.xxhash64(*by))
    same = reduce(lambda a, b: a & b, [F.col(f"_o.`{k}`") == F.col(f"_by.`{k}`") for k in by])
    made = {**{c: F.col(c) for c in columns}, "source_effective_from": F.col(effective_from), "source_available_at": F.col(available)}
    f = facts.select(key().alias("_key"), _micros(effective_from).alias("start"), _micros(effective_to, FOREVER).alias("end"), _micros(available).alias("_a"), _micros(superseded, FOREVER).alias("_s"), F.struct(*by).alias("_by"), F.struct(*[c.alias(n) for n, c in made.items()]).alias("_f"))
    o = observations.select(key().alias("_key"), _micros(time).alias("_t"), _micros(as_of).alias("_known"), F.struct(*observations.columns).alias("_o"))
    joined = stab(o, f, "_key", "_t", how="left", also=same & (F.col("_a") <= F.col("_known")) & (F.col("_known") < F.col("_s")))
    return joined.select(*[F.col(f"_o.`{c}`") for c in observations.columns], *[F.col(f"_f.`{n}`") for n in made])


def resolve_mapping(observations: DataFrame, mappings: DataFrame, **names) -> DataFrame:
    """bitemporal_join that insists on exactly one mapping for each observation: none raises, as several do."""
    columns = names.get("columns") or [c for c in mappings.columns if c not in observations.columns]
    out = bitemporal_join(observations, mappings, **names)
    strict(out.where("source_effective_from is null").select(*observations.columns), f"no mapping to {columns}")
    return out


def latest(df: DataFrame, keys: list[str], priority: list[str | Column]) -> DataFrame:
    """One row of each key, that of the greatest priority; partial aggregation before the shuffle. Null keys are keys."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*priority)).alias("_b"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_b.{c}").alias(c) for c in df.columns])


def known_by(df: DataFrame, at: Column, *clocks: str) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [F.col(c) <= at for c in clocks]))


def asof_history(history: DataFrame, *, as_of: Column, domain: str, field: str) -> DataFrame:
    rows = known_by(history.where((F.col("domain") == domain) & (F.col("field") == field)), as_of, "effective_at", "available_at")
    return latest(rows, ["symbol"], ["effective_at", "available_at"])


def facts_asof(facts: DataFrame, at: Column) -> DataFrame:
    """Last version of each (instrument, concept, unit, period) available by ``at``; of equal times the greatest accession.

    Equal times with unlike values, facts known before acceptance and periods that end after availability raise.
    """
    keys = ["instrument_id", "concept", "unit", "period_start", "period_end"]
    rules = F.col("period_end") > F.col("available_at")
    if "accepted_at" in facts.columns:
        rules = rules | (F.col("available_at") < F.col("accepted_at"))
    strict(facts.where(rules), "facts known too early")
    visible = facts.where(F.col("available_at") <= at)
    strict(visible.groupBy(*keys, "available_at").agg(F.count_distinct("value").alias("n")).where("n > 1"), "ambiguous facts of one time")
    return latest(visible, keys, ["available_at", "accession"])


def macro_asof(df: DataFrame, at: Column, *, latest_observation: bool = False) -> DataFrame:
    rows = latest(known_by(df, at, "available_at"), ["series_id", "observation_date"], ["available_at"])
    return latest(rows, ["series_id"], ["observation_date"]) if latest_observation else rows


def holdings_asof(df: DataFrame, at: Column) -> DataFrame:
    """All rows of each fund's latest disclosure by (holding_date, available_at)."""
    visible = known_by(df, at, "available_at")
    last = visible.groupBy("fund_id").agg(F.max_by("disclosure_id", F.struct("holding_date", "available_at", "disclosure_id")).alias("disclosure_id"))
    return visible.join(last, ["fund_id", "disclosure_id"], "left_semi")


def members_asof(events: DataFrame, session: Column, at: Column) -> DataFrame:
    """Instruments whose last membership event by (session, known_at, event_id) says member."""
    rows = events.where((F.col("session") <= session) & (F.col("known_at") <= at))
    return latest(rows, ["instrument_id"], ["session", "known_at", "event_id"]).where("member")


def permission_asof(df: DataFrame, effective: Column, known: Column) -> DataFrame:
    """(instrument_id, buy, sell, reason, evidence_ids): each source's last word; sources that disagree leave it unknown."""
    rows = df.where((F.col("effective_from") <= effective) & (effective < F.col("effective_to")) & (F.col("available_at") <= known))
    rows = latest(rows, ["instrument_id", "source"], ["available_at", "effective_from"])
    out = rows.groupBy("instrument_id").agg(
        F.count_distinct(F.struct("buy_status", "sell_status")).alias("n"), F.min("buy_status").alias("buy"), F.min("sell_status").alias("sell"),
        F.array_join(F.array_sort(F.collect_set("reason")), "|").alias("reason"), F.array_sort(F.collect_list("evidence_id")).alias("evidence_ids"),
    )
    clash = F.col("n") > 1
    return out.select("instrument_id", F.when(clash, "unknown").otherwise(F.col("buy")).alias("buy"), F.when(clash, "unknown").otherwise(F.col("sell")).alias("sell"), F.when(clash, "conflicting_sources").otherwise(F.col("reason")).alias("reason"), "evidence_ids")


def select_rate(rates: DataFrame, base: str, quote: str, cutoff: Column) -> DataFrame:
    """(event_id, rate) of the pair as quoted, never inverted; the latest observed must be unique. The same currency has rate 1."""
    if base == quote:
        return rates.sparkSession.createDataFrame([(None, "1")], "event_id string, rate string")
    pair = rates.where((F.col("base_currency") == base) & (F.col("quote_currency") == quote)).distinct()
    strict(pair.groupBy("event_id").agg(F.count("*").alias("n")).where("n > 1"), "event_id used with unlike facts")
    seen = known_by(pair, cutoff, "observed_at", "available_at")
    best = seen.join(seen.agg(F.max("observed_at").alias("observed_at")), "observed_at").select("event_id", F.col("rate_text").alias("rate"))
    found = best.limit(2).collect()
    if len(found) != 1:
        raise ValidationError(f"{'ambiguous' if found else 'missing'} rate {base}/{quote}")
    return best


def apply_symbol_lifecycle(panel: DataFrame, lifecycle: DataFrame, *, date: str = "date", symbol: str = "symbol", listed: str = "listed_at", delisted: str = "delisted_at") -> DataFrame:
    """Rows within their symbol's listing, both ends inclusive, a null end open; symbols without one drop out. The first lifecycle row of a symbol (by listing) counts."""
    life = lifecycle.groupBy(F.col(symbol).alias("_symbol")).agg(F.min_by(F.struct(F.col(listed).alias("l"), F.col(delisted).alias("d")), F.struct(listed, delisted)).alias("_life"))
    kept = panel.join(life, panel[symbol] == life["_symbol"]).where((F.col(date) >= F.col("_life.l")) & (F.col("_life.d").isNull() | (F.col(date) <= F.col("_life.d"))))
    return kept.select(*panel.columns)


def interval_lookup(points: DataFrame, intervals: DataFrame, key: str | None, time: str, start: str, end: str, columns: list[str]) -> DataFrame:
    """Points with the columns of the one interval [start, end) that holds them, intervals of a key being disjoint: a backward scan, then the end is tested."""
    by = [key] if key else ["_all"]
    p, i = (points, intervals) if key else (points.withColumn("_all", F.lit(0)), intervals.withColumn("_all", F.lit(0)))
    out = scan_join(p, i, by, time, F.col(start), [F.col(start)], {"_end": F.col(end), **{c: F.col(c) for c in columns}})
    inside = F.col("_end").isNull() | (F.col(time) < F.col("_end"))
    return out.withColumns({c: F.when(inside, F.col(c)) for c in columns}).select(*points.columns, *columns)


def next_start(points: DataFrame, starts: DataFrame, by: list[str], time: str, start: str, output: str = "next_start") -> DataFrame:
    """The first start not before each point: the backward scan with time reversed."""
    flip = lambda c: F.timestamp_micros(-F.unix_micros(F.col(c).cast("timestamp")))
    p = points.withColumn("_back", flip(time))
    out = scan_join(p, starts, by, "_back", flip(start), [flip(start)], {output: F.col(start)})
    return out.select(*points.columns, output)
