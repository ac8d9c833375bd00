"""Panels and data sets: constraints, coverage, merges, comparisons, differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import latest
from tidemark.operators.checks import ValidationError, duplicates, require_columns, violations

OHLC = ["open", "high", "low", "close"]


def _bad_number(c: str) -> Column:
    value = F.col(c).cast("double")
    return F.isnan(value) | (F.abs(value) == float("inf"))


def price_frame_stats(df: DataFrame) -> DataFrame:
    """(rows, symbols, missing_ratio, duplicates, infinite, nonpositive, negative_volume, invalid_bars, invalid_dates), one row.

    missing_ratio is the mean over the numeric columns of their share of nulls and NaN.
    """
    numeric = [c for c in (*OHLC, "volume") if c in df.columns]
    prices = [c for c in OHLC if c in numeric]
    copies = duplicates(df, ["symbol", "date"]).agg(F.coalesce(F.sum("copies") - F.count("*"), F.lit(0)).alias("duplicates"))
    some = lambda parts: reduce(lambda a, b: a | b, parts, F.lit(False))
    missing = sum((F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))) for c in numeric), F.lit(0))
    bar = (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high")) if set(OHLC) <= set(df.columns) else F.lit(False)
    stats = df.agg(
        F.count("*").alias("rows"), F.count_distinct("symbol").alias("symbols"),
        F.round(F.try_divide(missing, F.count("*") * max(1, len(numeric))), 6).alias("missing_ratio"),
        F.count_if(some([F.abs(F.col(c).cast("double")) == float("inf") for c in numeric])).alias("infinite"),
        F.count_if(some([F.col(c) <= 0 for c in prices])).alias("nonpositive"),
        F.count_if(F.col("volume") < 0 if "volume" in numeric else F.lit(False)).alias("negative_volume"),
        F.count_if(bar).alias("invalid_bars"), F.count_if(F.col("date").isNull()).alias("invalid_dates"),
    )
    return stats.join(copies)  # one row each


def validate_price_frame(df: DataFrame, *, required: tuple[str, ...] = ("date", "symbol", *OHLC, "volume"), max_missing_ratio: float = 0.05) -> dict:
    require_columns(df, list(required))
    found = price_frame_stats(df).first().asDict()
    if not found["rows"]:
        raise ValidationError("no rows")
    bad = [k for k in ("duplicates", "infinite", "nonpositive", "negative_volume", "invalid_bars", "invalid_dates") if found[k]]
    if bad or (found["missing_ratio"] or 0) > max_missing_ratio:
        raise ValidationError(f"price frame: {found}")
    return found


def calendar_coverage(df: DataFrame, calendar: DataFrame, *, date: str = "date", symbol: str = "symbol") -> DataFrame:
    """(symbol, expected_days, observed_days, missing_days, missing_ratio). calendar: one column ``date``.

    Counted, not listed: distinct observed days of the calendar per symbol against the calendar's size.
    """
    days = calendar.select(F.col("date").cast("date").alias("_d")).dropna().distinct()
    seen = df.select(F.col(symbol).alias("symbol"), F.col(date).cast("date").alias("_d")).distinct()
    hits = seen.join(days.withColumn("_open", F.lit(1)), "_d", "left").groupBy("symbol").agg(F.count("_open").alias("observed_days"))
    out = hits.join(days.agg(F.count("*").alias("expected_days")))  # one row
    out = out.withColumn("missing_days", F.col("expected_days") - F.col("observed_days"))
    return out.withColumn("missing_ratio", F.try_divide("missing_days", "expected_days"))


def coverage_gaps(df: DataFrame, calendar: DataFrame, *, date: str = "date", symbol: str = "symbol", interior: bool = False) -> DataFrame:
    """(symbol, date) of calendar days without a row. ``interior``: only between a symbol's first and last day."""
    days = calendar.select(F.col("date").cast("date").alias("date")).dropna().distinct()
    seen = df.select(F.col(symbol).alias("symbol"), F.col(date).cast("date").alias("date")).distinct()
    span = seen.groupBy("symbol").agg(F.min("date").alias("_a"), F.max("date").alias("_b"), F.collect_set("date").alias("_seen"))  # days of one calendar at most
    every = F.sort_array(F.collect_set("date"))
    open_days = days.agg(every.alias("_days"))
    gaps = span.join(open_days).select("symbol", "_a", "_b", F.explode(F.array_except("_days", "_seen")).alias("date"))
    return (gaps.where("date > _a and date < _b") if interior else gaps).select("symbol", "date")


def merge_by_key(old: DataFrame, new: DataFrame, keys: list[str], *, tolerance: float = 1e-12) -> tuple[DataFrame, DataFrame]:
    """(old rows that new does not replace, and new ones; the keys whose shared columns changed). Numbers within tolerance are equal, nulls too."""
    shared = [c for c in old.columns if c in new.columns and c not in keys]
    numeric = {f.name for f in old.schema if f.dataType.typeName() in {"double", "float", "long", "integer", "short", "byte"} or f.dataType.typeName().startswith("decimal")}

    def unlike(c: str) -> Column:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in numeric:
            x, y = a.cast("double"), b.cast("double")
            return ~(a.eqNullSafe(b) | F.coalesce(F.abs(x - y) <= tolerance + tolerance * F.abs(y), F.lit(False)))
        return ~a.eqNullSafe(b)

    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    kept = old.alias("o").join(new.alias("n"), same, "left_anti")
    changed = old.alias("o").join(new.alias("n"), same).where(reduce(lambda a, b: a | b, map(unlike, shared), F.lit(False)))
    return kept.unionByName(new, allowMissingColumns=True), changed.select(*[F.col(f"n.{k}").alias(k) for k in keys])


def row_hash(columns: list[str]) -> Column:
    """SHA-256 of the row's canonical JSON: columns by name, nulls written."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def version_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change) for added, removed, changed and unchanged keys, told by row hash."""
    rest = sorted((set(old.columns) | set(new.columns)) - set(keys))

    def hashed(df: DataFrame, name: str) -> DataFrame:
        full = df.select(*keys, *[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in rest])
        return full.select(*keys, row_hash(rest).alias(name))

    both = hashed(old, "_old").join(hashed(new, "_new"), keys, "full")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("changed")
    return both.select(*keys, change.alias("change"))


def multiset_diff(old: DataFrame, new: DataFrame) -> dict[str, DataFrame]:
    return {"added": new.exceptAll(old), "removed": old.exceptAll(new), "unchanged": old.intersectAll(new)}


def multiset_hash(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(rows, h0..h3, x0..x7): order-independent hash. Sums of the four 64-bit parts of row hashes, and xors of the eight 32-bit parts."""
    h = row_hash(columns or df.columns)
    part = lambda i, n: F.conv(F.substring(h, i * n + 1, n), 16, 10)
    sums = [F.coalesce(F.sum(part(i, 16).cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").alias(f"h{i}") for i in range(4)]
    xors = [F.coalesce(F.bit_xor(part(i, 8).cast("long")), F.lit(0)).alias(f"x{i}") for i in range(8)]
    return df.agg(F.count("*").alias("rows"), *sums, *xors)


def compare_prices(primary: DataFrame, shadow: DataFrame, *, value: str = "close") -> DataFrame:
    """(both, primary_only, shadow_only, max_relative, median_relative) of two providers by (symbol, date)."""
    p = primary.select("symbol", "date", F.col(value).cast("double").alias("_p"), F.lit(1).alias("_in_p"))
    s = shadow.select("symbol", "date", F.col(value).cast("double").alias("_s"), F.lit(1).alias("_in_s"))
    rel = F.abs(F.try_divide(F.col("_s") - F.col("_p"), F.col("_p")))
    both = p.join(s, ["symbol", "date"], "full")
    return both.agg(F.count_if(F.col("_in_p").isNotNull() & F.col("_in_s").isNotNull()).alias("both"), F.count_if(F.col("_in_s").isNull()).alias("primary_only"), F.count_if(F.col("_in_p").isNull()).alias("shadow_only"), F.max(rel).alias("max_relative"), F.percentile(rel, 0.5).alias("median_relative"))


def field_conflicts(left: DataFrame, right: DataFrame, keys: list[str], tolerances: dict[str, float]) -> DataFrame:
    """(keys, field, left, right) where two sources differ by more than the field's tolerance. One row of a key each side."""
    both = left.alias("l").join(right.alias("r"), keys)
    fields = [F.struct(F.lit(c).alias("field"), F.col(f"l.{c}").cast("double").alias("left"), F.col(f"r.{c}").cast("double").alias("right"), F.lit(float(t)).alias("t")) for c, t in tolerances.items()]
    return both.select(*keys, F.inline(F.array(*fields))).where("abs(left - right) > t or (left is null) <> (right is null)").drop("t")


UNIT_SCALE = {"thousand": ("one", 1000.0), "percent": ("ratio", 0.01)}


def discrepancies(observations: DataFrame, at: Column, tolerance: float = 0.0) -> DataFrame:
    """(instrument_id, field, effective_at, reason, sources, spread) where the latest words of two or more sources disagree.

    Units, currency or basis that differ make values incomparable; else a spread over tolerance is a disagreement.
    """
    unit, value = F.col("unit"), F.col("value").cast("double")
    for name, (base, factor) in UNIT_SCALE.items():
        value = F.when(F.col("unit") == name, F.col("value").cast("double") * factor).otherwise(value)
        unit = F.when(F.col("unit") == name, base).otherwise(unit)
    rows = observations.where(F.col("available_at") <= at).withColumn("_value", value).withColumn("_unit", unit)
    key = ["instrument_id", "field", "effective_at"]
    last = latest(rows.select(*key, "source", "available_at", "observation_id", "_value", "_unit", "currency", "basis"), [*key, "source"], ["available_at", "observation_id"])
    cases = last.groupBy(*key).agg(F.count("*").alias("sources"), F.count_distinct(F.struct("_unit", "currency", "basis")).alias("_kinds"), (F.max("_value") - F.min("_value")).alias("spread"))
    cases = cases.where((F.col("sources") > 1) & ((F.col("_kinds") > 1) | (F.col("spread") > tolerance)))
    return cases.withColumn("reason", F.when(F.col("_kinds") > 1, "incomparable_semantics").otherwise("value_disagreement")).drop("_kinds")


def first_observed(previous: DataFrame, observed: DataFrame, timestamp: str) -> DataFrame:
    """Observed rows with the first receipt time of any identical row (but for the timestamp) seen before."""
    content = [c for c in observed.columns if c != timestamp]
    first = previous.select(row_hash(content).alias("_h"), F.col(timestamp).alias("_t")).groupBy("_h").agg(F.min("_t").alias("_t"))
    out = observed.withColumn("_h", row_hash(content)).join(first, "_h", "left")
    return out.withColumn(timestamp, F.least(F.col(timestamp), F.col("_t"))).drop("_h", "_t").select(*observed.columns)


def coverage(df: DataFrame, *, date: str = "date", symbol: str = "symbol") -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.count_distinct(symbol).alias("symbols"), F.min(date).alias("first"), F.max(date).alias("last"))


def covers_range(df: DataFrame, start, end, *, date: str = "date") -> bool:
    a, b = df.agg(F.min(date), F.max(date)).first()
    return a is not None and a <= start and b >= end


def incremental_start(df: DataFrame, default, *, date: str = "date"):
    last = df.agg(F.date_add(F.max(F.col(date).cast("date")), 1)).first()[0]
    return last or default


def lag_by_slices(df: DataFrame, stream: list[str], order: str, column: str, output: str, width: int, ties: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """df with the column's value in the row before, of a stream, in order of a long column and, where that is equal, of ties.

    Rows are windowed in slices of ``width`` of the order; the last row of the slice before is carried over from a
    table of one row a slice. So one stream with most rows is many tasks' work.
    """
    slices = df.withColumn("_s", F.floor(F.col(order) / width).cast("long"))
    last = slices.groupBy(*stream, "_s").agg(F.max(F.struct(F.col(order).alias("o"), *[F.col(c).alias(f"t{i}") for i, c in enumerate(ties)], F.col(column).alias("v"))).alias("_l"))
    carried = last.withColumn("_c", F.lag("_l").over(Window.partitionBy(*stream).orderBy("_s")))
    carried = carried.where("_c is not null").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(stream)], F.col("_s").alias("_s2"), F.col("_c.v").alias("_v"))
    own = F.lag(F.struct(F.col(column).alias("v"))).over(Window.partitionBy(*stream, "_s").orderBy(order, *ties))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(stream)] + [F.col("_s") == F.col("_s2")]
    rows = slices.withColumn("_own", own)
    first = rows.where("_own is null").join(carried, same, "left").withColumn(output, F.col("_v")).select(*df.columns, output)
    return rows.where("_own is not null").withColumn(output, F.col("_own.v")).select(*df.columns, output).unionByName(first)


def sequence_breaks(events: DataFrame, stream: list[str], order: str, width: int | None = None, ties: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Rows whose sequence does not advance, or whose previous_sequence is not the one before, in the order of arrival.

    width: slices of a long order column, for streams too long for one task. ties: what orders rows of equal order.
    """
    if width is None:
        rows = events.withColumn("_before", F.lag("sequence").over(Window.partitionBy(*stream).orderBy(order, *ties)))
    else:
        rows = lag_by_slices(events, stream, order, "sequence", "_before", width, ties)
    broken = F.col("sequence") <= F.col("_before")
    if "previous_sequence" in events.columns:
        broken = broken | (F.col("previous_sequence") != F.col("_before"))
    return rows.where(broken).withColumnRenamed("_before", "prior_sequence")


def quarantine_streams(events: DataFrame, stream: list[str], bad: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): one bad row rejects its whole stream. Bad streams are few and are found before rows move."""
    poisoned = events.groupBy(*stream).agg(F.max(F.coalesce(bad, F.lit(True))).alias("_bad")).where("_bad").drop("_bad").alias("p")
    same = [F.col(f"e.{k}").eqNullSafe(F.col(f"p.{k}")) for k in stream]
    e = events.alias("e")
    return e.join(poisoned, same, "left_anti"), e.join(poisoned, same, "left_semi")


def contiguous_versions(df: DataFrame, key: list[str], *, start: str = "effective_from", end: str = "effective_to") -> DataFrame:
    """Versions that do not end where the next one of their key starts; only the last may be open."""
    following = F.lead(start).over(Window.partitionBy(*key).orderBy(start))
    rows = df.withColumn("_next", following)
    return rows.where("_next is not null and not (" + end + " <=> _next)").withColumnRenamed("_next", "next_start")


def membership_by_replay(current: DataFrame, events: DataFrame, days: DataFrame) -> DataFrame:
    """(date, symbol) of members on each day, from today's list undone backwards. events: date, symbol, action (add or remove).

    Between events membership is constant: after an event it is what the event says; before a symbol's first event it
    is the opposite; without events it is what the list says. An event counts from its own day on.
    """
    marks = events.select("symbol", F.col("date").cast("date").alias("_from"), (F.col("action") == "add").alias("_in"))
    first = marks.groupBy("symbol").agg(F.min_by("_in", "_from").alias("_in")).select("symbol", F.lit(None).cast("date").alias("_from"), (~F.col("_in")).alias("_in"))
    still = current.select("symbol").distinct().join(marks.select("symbol").distinct(), "symbol", "left_anti").select("symbol", F.lit(None).cast("date").alias("_from"), F.lit(True).alias("_in"))
    spans = marks.unionByName(first).unionByName(still)
    spans = spans.withColumn("_to", F.lead("_from").over(Window.partitionBy("symbol").orderBy(F.col("_from").asc_nulls_first()))).where("_in")
    open_days = days.select(F.col("date").cast("date").alias("date")).distinct()
    # a range join: broadcast are the days, of which a calendar has a few hundred a year
    return spans.join(F.broadcast(open_days), (F.col("_from").isNull() | (F.col("date") >= F.col("_from"))) & (F.col("_to").isNull() | (F.col("date") < F.col("_to")))).select("date", "symbol")


def price_rules() -> dict[str, Column]:
    c = F.col
    return {
        "positive": (c("open") > 0) & (c("high") > 0) & (c("low") > 0) & (c("close") > 0),
        "bounds": (c("high") >= F.greatest("open", "close", "low")) & (c("low") <= F.least("open", "close", "high")),
        "volume": c("volume") >= 0,
        "finite": ~reduce(lambda a, b: a | b, map(_bad_number, (*OHLC, "volume"))),
    }


def price_violations(df: DataFrame) -> DataFrame:
    return violations(df, price_rules(), ["symbol", "date"])
