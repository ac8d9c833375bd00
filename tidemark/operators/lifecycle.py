"""Lifecycles, universes, matching of announcements, adjustment models, cash identities, JSON differences."""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import known_by, latest
from tidemark.operators.checks import strict


def lifecycle_asof(events: DataFrame, effective: Column, known: Column) -> DataFrame:
    """(instrument_id, listed, symbol, venue, successor_id, memberships, evidence_ids) by what was published.

    events: event_id, instrument_id, kind, effective_at, available_at, symbol, venue, universe_id, successor_id,
    evidence_id. A correction replaces the event of its instrument, kind, time and universe. Each attribute is the one
    of the last event that sets it. A listing together with its end, an entry together with an exit of one universe,
    and a symbol and venue that two listed instruments share raise.
    """
    seen = latest(known_by(known_by(events, effective, "effective_at"), known, "available_at"), ["instrument_id", "kind", "effective_at", "universe_id"], ["available_at", "event_id"])
    ends = F.col("kind").isin("delisting", "merger")
    one_time = seen.groupBy("instrument_id", "effective_at").agg(F.max((F.col("kind") == "listing").cast("int")).alias("a"), F.max(ends.cast("int")).alias("b"))
    strict(one_time.where("a = 1 and b = 1"), "conflicting states of one time")
    member = F.col("kind").isin("entry", "exit")
    strict(seen.where(member).groupBy("instrument_id", "effective_at", "universe_id").agg(F.count_distinct("kind").alias("n")).where("n > 1"), "conflicting memberships of one time")
    order = F.struct("effective_at", "available_at", "event_id")
    last = lambda value, *kinds: F.max_by(F.when(F.col("kind").isin(*kinds), value), F.when(F.col("kind").isin(*kinds), order))
    state = seen.groupBy("instrument_id").agg(
        last(F.col("kind") == "listing", "listing", "delisting", "merger").alias("listed"), last(F.col("symbol"), "listing", "symbol_change").alias("symbol"),
        last(F.col("venue"), "listing", "venue_change").alias("venue"), last(F.col("successor_id"), "merger").alias("successor_id"), F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"),
    )
    inside = seen.where(member).groupBy("instrument_id", "universe_id").agg(F.max_by("kind", order).alias("kind")).where("kind = 'entry'").groupBy("instrument_id").agg(F.array_sort(F.collect_set("universe_id")).alias("memberships"))
    out = state.join(inside, "instrument_id", "left").withColumn("memberships", F.coalesce("memberships", F.array().cast("array<string>")))
    strict(out.where("listed").groupBy("symbol", "venue").agg(F.count("*").alias("n")).where("n > 1"), "a symbol of two listed instruments")
    return out.select("instrument_id", "listed", "symbol", "venue", "successor_id", "memberships", "evidence_ids")


def select_universe(states: DataFrame, holdings: DataFrame, universe: str | None = None) -> DataFrame:
    """(instrument_id, choice): eligible, retained (held, known, no longer eligible) or unknown (held, state not known)."""
    fit = F.coalesce(F.col("listed"), F.lit(False)) & (F.lit(True) if universe is None else F.array_contains("memberships", universe))
    both = states.select("instrument_id", fit.alias("_fit"), F.col("listed").isNotNull().alias("_known")).join(holdings.select("instrument_id", F.lit(True).alias("_held")).distinct(), "instrument_id", "full")
    choice = F.when(F.col("_fit"), "eligible").when(F.col("_held") & F.coalesce("_known", F.lit(False)), "retained").when(F.col("_held"), "unknown")
    return both.select("instrument_id", choice.alias("choice")).where("choice is not null")


def match_announcements(dividends: DataFrame, announcements: DataFrame) -> DataFrame:
    """Each dividend (symbol, dividend_id, ex_date) with announcement_id and announced: greedily, in order of ex_date, the
    latest announcement (symbol, announcement_id, announced) strictly before it that no earlier dividend took; else null.

    Taking the latest free one is a stack: announcements are pushed as time passes and a dividend pops one. So one scan
    of a symbol's rows in time order does it; symbols are read in turn, each row once.
    """
    a = announcements.select("symbol", F.col("announced").cast("date").alias("day"), F.lit(1).alias("side"), F.col("announcement_id").cast("string").alias("id"))
    d = dividends.select("symbol", F.col("ex_date").cast("date").alias("day"), F.lit(0).alias("side"), F.col("dividend_id").cast("string").alias("id"))
    ordered = a.unionByName(d).repartition("symbol").sortWithinPartitions("symbol", "day", "side", "id")  # of one day the dividend comes first

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, free = None, []
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                if r.symbol != symbol:
                    symbol, free = r.symbol, []
                if r.side:
                    free.append((r.id, r.day))
                else:
                    found = free.pop() if free else (None, None)
                    out.append((r.symbol, r.id, r.day, *found))
            yield pd.DataFrame(out, columns=["symbol", "dividend_id", "ex_date", "announcement_id", "announced"])

    return ordered.mapInPandas(run, "symbol string, dividend_id string, ex_date date, announcement_id string, announced date")


def adjustment_model(raw: DataFrame, adjusted: DataFrame, actions: DataFrame) -> DataFrame:
    """(symbol, model, multiplicative_error, affine_error): whether adjusted closes follow from raw ones by factors, by an affine map, or neither.

    actions: symbol, date, cash, ratio. Factor steps are compared with close * ratio / (close - cash) of the row before,
    relative to a tolerance; the affine model folds actions from the end, which is a running product and a running sum.
    """
    strict(raw.select("symbol", "date").exceptAll(adjusted.select("symbol", "date")).unionByName(adjusted.select("symbol", "date").exceptAll(raw.select("symbol", "date"))), "raw and adjusted keys differ")
    rows = raw.select("symbol", "date", F.col("close").alias("r")).join(adjusted.select("symbol", "date", F.col("close").alias("a")), ["symbol", "date"])
    rows = rows.join(actions.select("symbol", "date", F.col("cash").cast("double").alias("c"), F.col("ratio").cast("double").alias("k")), ["symbol", "date"], "left").na.fill({"c": 0.0, "k": 1.0})
    w = Window.partitionBy("symbol").orderBy("date")
    before, factor = F.lag("r").over(w), F.col("a") / F.col("r")
    step = factor / F.lag(F.col("a") / F.col("r")).over(w)
    tolerance = F.greatest(F.lit(0.003), 0.025 / F.least("r", before))
    error = F.abs(step - before * F.col("k") / (before - F.col("c"))) / tolerance
    back = Window.partitionBy("symbol").orderBy(F.desc("date"))
    later = back.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("m", F.exp(-F.coalesce(F.sum(F.ln("k")).over(later), F.lit(0.0)))).withColumn("base", F.first(F.col("a") - F.col("r")).over(back)).withColumn("e", error)
    rows = rows.withColumn("o", F.col("base") - F.coalesce(F.sum(F.col("m") * F.col("c") / F.col("k")).over(later), F.lit(0.0)))
    out = rows.groupBy("symbol").agg(F.coalesce(F.max("e"), F.lit(0.0)).alias("multiplicative_error"), F.max(F.abs(F.col("r") * F.col("m") + F.col("o") - F.col("a"))).alias("affine_error"))
    return out.select("symbol", F.when(F.col("multiplicative_error") <= 1, "multiplicative").when(F.col("affine_error") <= 0.025, "affine").alias("model"), "multiplicative_error", "affine_error")


def cash_identity_breaks(payments: DataFrame) -> DataFrame:
    """Payments whose gross is not net + withholding + deductions + rounding, all decimal text, deductions an array of it. What cannot be read breaks it too."""
    exact = lambda c: c.try_cast("decimal(38,12)")
    deducted = F.aggregate("deductions", F.lit(0).cast("decimal(38,12)"), lambda a, x: (a + exact(x)).cast("decimal(38,12)"))
    whole = exact(F.col("net")) + exact(F.col("withholding")) + deducted + exact(F.col("rounding"))
    return payments.where(~F.coalesce(exact(F.col("gross")) == whole, F.lit(False)))


def forecast_scores(rows: DataFrame, scores: list[tuple[str, float]], start: Column, end: Column) -> DataFrame:
    """Forecasts announced from start to end with the score of the first word their type contains (else 0), effective the weekday after."""
    from tidemark.functions.instants import next_weekday

    score = F.lit(0.0)
    for word, value in reversed(scores):
        score = F.when(F.contains("forecast_type", F.lit(word)), F.lit(float(value))).otherwise(score)
    kept = rows.where(F.col("announce_date").between(start, end))
    return kept.withColumn("forecast_score", score).withColumn("effective_date", next_weekday(F.col("announce_date"))).distinct()


def json_changes(df: DataFrame, old: str, new: str) -> DataFrame:
    """df without the two JSON columns, one row for each difference: path, old, new (JSON text), change, delta (of numbers)."""

    def walk(a, b, path: str):
        if type(a) is type(b) and a == b:
            return
        if isinstance(a, dict) and isinstance(b, dict):
            for k in sorted({*a, *b}):
                at = f"{path}/{k.replace('~', '~0').replace('/', '~1')}"
                if k in a and k in b:
                    yield from walk(a[k], b[k], at)
                else:
                    yield at, a.get(k), b.get(k), "removed" if k in a else "added"
        elif isinstance(a, list) and isinstance(b, list) and len(a) == len(b):
            for i, (x, y) in enumerate(zip(a, b)):
                yield from walk(x, y, f"{path}/{i}")
        else:
            yield path, a, b, "modified"

    def delta(a, b, change: str) -> str | None:
        if change != "modified" or isinstance(a, bool) or isinstance(b, bool):
            return None
        try:
            x, y = Decimal(str(a)), Decimal(str(b))
        except InvalidOperation:
            return None
        return str(y - x) if x.is_finite() and y.is_finite() else None

    keep = [c for c in df.columns if c not in (old, new)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        text = lambda v: json.dumps(v, sort_keys=True, default=str)
        for frame in frames:
            out = []
            for r in frame.to_dict("records"):
                for path, a, b, change in walk(json.loads(r[old], parse_float=Decimal), json.loads(r[new], parse_float=Decimal), ""):
                    out.append([r[c] for c in keep] + [path, text(a), text(b), change, delta(a, b, change)])
            yield pd.DataFrame(out, columns=[*keep, "path", "old", "new", "change", "delta"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep)
    return df.dropna(subset=[old, new]).mapInPandas(run, f"{kinds + ', ' if kinds else ''}path string, old string, new string, change string, delta string")
