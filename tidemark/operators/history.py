"""Full history of changing attributes, by presence bitmaps.

Each symbol's instants (its records and the snapshots that miss it) are numbered; for each set of attribute values one
bit is set at each instant that shows it. Runs of set bits are the versions; a snapshot without the symbol leaves a
gap in every bitmap of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import trimmed
from tidemark.sources.shared import written

#: Bits of a word of a bitmap.
WORD = 62
#: A slice of time, in bits of microseconds: some 13 days.
SLICE_BITS = 40
NUMBERS = ["price_tick", "lot_size", "commission_rate", "stamp_duty_rate", "price_limit_rate"]


def _number(value: Column) -> Column:
    return value.try_cast("decimal(38,18)")


def standing_records(records: DataFrame) -> DataFrame:
    """(symbol, at, venue, numbers): of records of one symbol and effective_from the last published, then the greatest record_id.

    Symbols count without outer blanks in upper case; those that are null or blank, and records without effective_from,
    are left out. A number that cannot be read is null.
    """
    values = F.struct(F.upper(trimmed(F.col("venue"))).alias("venue"), *[_number(trimmed(F.col(c).cast("string"))).alias(c) for c in NUMBERS])
    rows = records.select(F.upper(trimmed(F.col("symbol"))).alias("symbol"), F.unix_micros("effective_from").alias("at"), F.unix_micros("available_at").alias("_known"), "record_id", values.alias("_values")).where("symbol <> '' and at is not null")
    newest = Window.partitionBy("symbol", "at").orderBy(F.desc("_known"), F.desc("record_id"), F.desc("_values"))
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").select("symbol", "at", "_values.*")


def snapshot_slices(records: DataFrame) -> DataFrame:
    """(_slice, _times, _later): for each slice of time with records its snapshot times, and the first one beyond it.

    One row a slice, with one number for each snapshot ever taken; only slices are sorted in one place.
    """
    at = F.unix_micros("effective_from")
    known = records.where("effective_from is not null").select(F.shiftright(at, SLICE_BITS).alias("_slice"), F.when(F.col("record_kind") == "snapshot", at).alias("at")).distinct()
    by_slice = known.groupBy("_slice").agg(F.sort_array(F.collect_set("at")).alias("_times"), F.min("at").alias("_first"))
    beyond = Window.orderBy("_slice").rowsBetween(1, Window.unboundedFollowing)
    return by_slice.select("_slice", "_times", F.min("_first").over(beyond).alias("_later"))


def _first_after(rows: DataFrame) -> DataFrame:
    """rows with _next, the symbol's next instant. A symbol is cut into slices of time, whose first instants carry over."""
    rows = rows.withColumn("_slice", F.shiftright("at", SLICE_BITS))
    firsts = rows.groupBy("symbol", "_slice").agg(F.min("at").alias("at"))
    beyond = firsts.select("symbol", "_slice", F.lead("at").over(Window.partitionBy("symbol").orderBy("_slice")).alias("_beyond"))
    inside = F.lead("at").over(Window.partitionBy("symbol", "_slice").orderBy("at"))
    return rows.withColumn("_next", inside).join(beyond, ["symbol", "_slice"]).withColumn("_next", F.coalesce("_next", "_beyond")).drop("_beyond")


def presence(records: DataFrame, slices: DataFrame) -> DataFrame:
    """(symbol, at, ordinal, values): the instants of each symbol. values is null where a snapshot misses the symbol.

    Of the snapshots between two records only the first is an instant: one unset bit ends a run as well as many.
    """
    rows = _first_after(written(records.select("symbol", "at", F.struct("venue", *NUMBERS).alias("values")), "standing"))
    rows = rows.join(slices, "_slice").withColumn("_missed", F.coalesce(F.get(F.filter("_times", lambda t: t > F.col("at")), 0), "_later"))
    gap = F.when(F.col("_missed") < F.coalesce("_next", F.lit((1 << 63) - 1)), F.struct(F.col("_missed").alias("at"), F.lit(None).cast(rows.schema["values"].dataType).alias("values")))
    both = rows.select("symbol", F.explode(F.array_compact(F.array(F.struct("at", "values"), gap))).alias("_i")).select("symbol", "_i.*").withColumn("_slice", F.shiftright("at", SLICE_BITS))
    both = written(both, "presence")
    counts = both.groupBy("symbol", "_slice").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("symbol").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    inside = F.row_number().over(Window.partitionBy("symbol", "_slice").orderBy("at")) - 1
    numbered = both.withColumn("ordinal", inside).join(counts.select("symbol", "_slice", F.coalesce(before, F.lit(0)).alias("_before")), ["symbol", "_slice"])
    return numbered.select("symbol", "at", (F.col("ordinal") + F.col("_before")).alias("ordinal"), "values")


def bitmaps(instants: DataFrame) -> DataFrame:
    """(symbol, values, word, bits) for each word with a bit."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("ordinal", F.lit(WORD)))
    return instants.where("values is not null").groupBy("symbol", "values", F.call_function("div", F.col("ordinal"), F.lit(WORD)).alias("word")).agg(F.bit_or(bit).alias("bits"))


def runs(maps: DataFrame) -> DataFrame:
    """(symbol, values, first, last): ordinals of each run of set bits, across words."""
    bits = F.col("bits")
    every = F.sequence(F.lit(0), F.lit(WORD - 1))
    places = lambda mask: F.filter(every, lambda i: F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1)) == 1)
    starts = places(bits.bitwiseAND(F.bitwise_not(F.shiftleft(bits, 1))))
    ends = places(bits.bitwiseAND(F.bitwise_not(F.shiftright(bits, 1))))
    pairs = F.zip_with(starts, ends, lambda a, b: F.struct((a + F.col("word") * WORD).alias("first"), (b + F.col("word") * WORD).alias("last")))
    parts = maps.select("symbol", "values", F.inline(pairs))
    # a run that ends inside a word is whole; those at a word's edges may go on in the next one
    edge = (F.pmod("first", F.lit(WORD)) == 0) | (F.pmod("last", F.lit(WORD)) == WORD - 1)
    same = Window.partitionBy("symbol", "values").orderBy("first")
    before = F.lag("last").over(same)
    chained = parts.where(edge).withColumn("_run", F.coalesce((F.col("first") != before + 1).cast("int"), F.lit(1))).withColumn("_run", F.sum("_run").over(same.rowsBetween(Window.unboundedPreceding, 0)))
    joined = chained.groupBy("symbol", "values", "_run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_run")
    return parts.where(~edge).unionByName(joined)


def attribute_history(records: DataFrame) -> DataFrame:
    """(symbol, venue, numbers, effective_from_us, effective_to_us): each version of each symbol; effective_to_us is 0 while current.

    Snapshot times are all effective_from of kind snapshot. No records give no versions; repeated and reordered records
    change nothing. A symbol with most of the records is spread over its slices of time.
    """
    instants = written(presence(standing_records(records), snapshot_slices(records)), "instants")
    spans = runs(bitmaps(instants))
    at = instants.select("symbol", "ordinal", "at")
    begun = spans.join(at.select("symbol", F.col("ordinal").alias("first"), F.col("at").alias("effective_from_us")), ["symbol", "first"])
    ended = begun.withColumn("_end", F.col("last") + 1).join(at.select("symbol", F.col("ordinal").alias("_end"), F.col("at").alias("_to")), ["symbol", "_end"], "left")
    return ended.select("symbol", "values.*", "effective_from_us", F.coalesce("_to", F.lit(0).cast("long")).alias("effective_to_us"))
