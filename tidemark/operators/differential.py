"""Per-period aggregates by event time, restated by retraction as late rows come in.

Versions: 0 is what was known at first publication; later ones are ticks after it, up to the cut-off. A late tick emits
the old aggregate of each period it touches with sign -1 and the new one with sign +1. These signed rows are the state
too: everything in them is linear, so the present state of a period is the signed sum over its versions, and a tick
needs its own rows and the signed rows of the periods it touches, never the rows that came before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.fixed import fixed_e8, packed, packed_high, packed_low
from tidemark.sources.shared import file_system, place, shared_folder, written

HALF_HOUR = 1800 * 10**6
PERIOD = ["instrument_id", "session_id", "bar_start_us"]
_STATE = "instrument_id string, session_id string, bar_start_us long, version int, sign int, trades long, volume_e8 decimal(38,0), close_us long, close_sequence long"
_SUMS = ["trades", "volume_e8", "close_us", "close_sequence"]
#: Stands for a null sequence, which is before all others.
_NONE = -(1 << 62)


def counted_rows(trades: DataFrame, *, width: int = HALF_HOUR, publish_after: int = 60 * 10**6, cut_off: int = 6 * 3600 * 10**6, tick: int = 3600 * 10**6) -> DataFrame:
    """(period, version, event_us, sequence, quantity_e8) of rows known by the cut-off. Times are microseconds.

    Rows without instrument_id, event_time or available_at belong to no period.
    """
    rows = trades.where("instrument_id is not null and event_time is not null and available_at is not null")
    rows = rows.select("instrument_id", "session_id", F.unix_micros("event_time").alias("event_us"), F.unix_micros("available_at").alias("_known"), "sequence", fixed_e8(F.col("quantity")).alias("quantity_e8"))
    rows = rows.withColumn("bar_start_us", F.col("event_us") - F.pmod("event_us", F.lit(width)))
    late = F.col("_known") - F.col("bar_start_us") - (width + publish_after)
    version = F.when(late <= 0, 0).otherwise(F.call_function("div", late + (tick - 1), F.lit(tick)))
    return rows.where(F.col("_known") <= F.col("bar_start_us") + (width + cut_off)).select(*PERIOD, version.cast("int").alias("version"), "event_us", "sequence", "quantity_e8")


def tick_parts(counted: DataFrame) -> DataFrame:
    """(period, version, trades, volume_e8, close_us, close_sequence) of the rows of each version, added up before the shuffle."""
    close = packed(F.col("event_us"), F.coalesce("sequence", F.lit(_NONE)))
    parts = counted.groupBy(*PERIOD, "version").agg(F.count("*").alias("trades"), F.sum(F.coalesce("quantity_e8", F.lit(0)).cast("decimal(20,0)")).cast("decimal(38,0)").alias("volume_e8"), F.max(close).alias("_close"))
    return parts.select(*PERIOD, "version", "trades", "volume_e8", packed_high(F.col("_close")).alias("close_us"), packed_low(F.col("_close")).alias("close_sequence"))


class PeriodLog:
    """Signed rows under one path, a folder for each tick taken up; a path that is there already is continued."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or shared_folder(spark, "periods")
        self.fs, at = file_system(spark, self.path)
        self.fs.mkdirs(at)

    def _ticks(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(file_system(self.spark, self.path)[1]) if s.getPath().getName().startswith("tick-"))

    def deltas(self) -> DataFrame:
        """(period, version, sign, trades, volume_e8, close_us, close_sequence) of all ticks so far."""
        ticks = self._ticks()
        return self.spark.read.schema(_STATE).parquet(*[f"{self.path}/{t}" for t in ticks]) if ticks else self.spark.createDataFrame([], _STATE)

    def take(self, counted: DataFrame) -> None:
        """Take up rows of ``counted_rows`` that came in since, tick by tick; rows taken up before are not read."""
        parts = written(tick_parts(counted), "ticks", partition_by=("version",))
        for r in parts.groupBy("version").agg(F.min("bar_start_us").alias("lo"), F.max("bar_start_us").alias("hi")).orderBy("version").collect():  # as many rows as ticks up to the cut-off
            self._tick(parts.where(F.col("version") == r.version), r.lo, r.hi)

    def _tick(self, new: DataFrame, lo: int, hi: int) -> None:
        held = self.deltas().where(F.col("bar_start_us").between(lo, hi))
        same = [F.col(f"h.{k}").eqNullSafe(F.col(f"n.{k}")) for k in PERIOD]
        touched = present_state(held.alias("h").join(new.alias("n"), same, "left_semi"))
        both = touched.select(*PERIOD, "version", *_SUMS, F.lit(True).alias("_old")).unionByName(new.select(*PERIOD, "version", *_SUMS, F.lit(False).alias("_old")))
        old = lambda c: F.max(F.when(F.col("_old"), F.col(c)))  # noqa: E731  one row of either kind
        own = lambda c: F.max(F.when(~F.col("_old"), F.col(c)))
        at = both.groupBy(*PERIOD).agg(F.max("version").alias("version"), *[f(c).alias(f"{p}_{c}") for p, f in (("o", old), ("n", own)) for c in _SUMS])
        later = F.col("o_close_us").isNull() | (F.col("n_close_us") > F.col("o_close_us")) | ((F.col("n_close_us") == F.col("o_close_us")) & (F.col("n_close_sequence") > F.col("o_close_sequence")))
        plus = {c: F.col(f"n_{c}") + F.coalesce(F.col(f"o_{c}"), F.lit(0)) for c in ("trades", "volume_e8")} | {c: F.when(later, F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")) for c in ("close_us", "close_sequence")}
        row = lambda sign, values: F.struct(F.lit(sign).alias("sign"), *[values[c].cast("decimal(38,0)" if c == "volume_e8" else "long").alias(c) for c in _SUMS])
        signed = F.array_compact(F.array(F.when(F.col("o_trades").isNotNull(), row(-1, {c: F.col(f"o_{c}") for c in _SUMS})), row(1, plus)))
        staged = f"{self.path}/.tick-{len(self._ticks()):06d}"
        at.select(*PERIOD, "version", F.inline(signed)).write.mode("overwrite").option("compression", "zstd").parquet(staged)
        place(self.spark, staged, staged.replace("/.tick-", "/tick-"))  # lands as a whole

    def compact(self) -> None:
        """Put one row of sign +1 for each period in place of its signed rows so far: the state, without its history."""
        ticks = self._ticks()
        staged, number = f"{self.path}/.compacted", uuid.uuid4().hex[:8]
        present_state(self.deltas()).select(*PERIOD, "version", F.lit(1).alias("sign"), *_SUMS).write.mode("overwrite").parquet(staged)
        # the new folder comes after the old ones went: a reader between the two sees no period twice
        for t in ticks:
            place(self.spark, f"{self.path}/{t}", f"{self.path}/.old-{number}-{t}")
        place(self.spark, staged, f"{self.path}/tick-000000")


def period_deltas(counted: DataFrame, path: str | None = None) -> DataFrame:
    """(period, version, sign, trades, volume_e8, close_us, close_sequence): signed changes of each period's aggregate.

    A tick's rows of one period are added up before they are shuffled, so a hot instrument is one row a period and tick.
    A null sequence is before all others; a close that has none has close_sequence null.
    """
    log = PeriodLog(counted.sparkSession, path)
    log.take(counted)
    return log.deltas().withColumn("close_sequence", F.nullif("close_sequence", F.lit(_NONE)))


def present_state(deltas: DataFrame) -> DataFrame:
    """(period, version, trades, volume_e8, close_us, close_sequence): what the signed rows add up to."""
    total = lambda c: F.sum(F.col("sign") * F.coalesce(c, F.lit(_NONE)) if c == "close_sequence" else F.col("sign") * F.col(c)).alias(c)
    return deltas.groupBy(*PERIOD).agg(F.max("version").alias("version"), total("trades"), total("volume_e8").cast("decimal(38,0)").alias("volume_e8"), total("close_us"), total("close_sequence"))


def restated_periods(trades: DataFrame, *, path: str | None = None, **limits: int) -> DataFrame:
    """(instrument_id, session_id, bar_start_us, close_sequence) of each period with a row known after first publication.

    trades: one row for each message. The close is the row of the latest event_time, of equals of the greatest
    sequence. Restatement counts even if nothing was published before. Empty input gives no rows. path: a log to continue.
    """
    state = present_state(period_deltas(counted_rows(trades, **limits), path)).where("version > 0")
    return state.select(*PERIOD, F.nullif("close_sequence", F.lit(_NONE)).alias("close_sequence"))
