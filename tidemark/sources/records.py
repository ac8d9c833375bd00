"""Provider records to typed rows: what does not fit is returned beside them, with the reason; nothing is guessed."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.checks import ValidationError, require_columns, violations

TERMS = "event_id string, instrument_id string, kind string, effective_at timestamp, available_at timestamp, currency string, source string, evidence_id string, cash_per_unit decimal(38,18), ratio decimal(38,18), entitlement_date date"
# Kinds of terms that only a record of their own can give.
EXPLICIT = ("merger", "spin_off", "rights_distribution", "rights_exercise")
#: Bytes of a file within an archive, and how many times larger than packed it may be.
MOST_BYTES, MOST_GROWTH = 32 << 20, 200


def _exact(c: str) -> Column:
    return F.col(c).cast("string").try_cast("decimal(38,18)")


def distribution_terms(rows: DataFrame, *, currency: str = "CNY") -> tuple[DataFrame, DataFrame]:
    """(TERMS, violations of rows that give none): a distribution is an entitlement and a payment if it has cash, a split if its share ratio is not 1.

    rows: event_id, instrument_id, cash_per_share, share_ratio (decimal text or numbers), record_date, ex_date, pay_date,
    shares_available_date, captured_at, source. Known is a row from its capture on. Shares that come later than the
    ex-date are not expressed.
    """
    cash, ratio = _exact("cash_per_share"), _exact("share_ratio")
    pays, splits = F.coalesce(cash > 0, F.lit(False)), F.coalesce(ratio != 1, F.lit(False))
    there = lambda c: F.col(c).isNotNull()
    rules = {
        "amounts": (cash >= 0) & (ratio > 0), "no_terms": pays | splits, "dates": there("record_date") & there("ex_date") & there("captured_at"),
        "pay_date": ~pays | there("pay_date"), "shares_date": ~splits | there("shares_available_date"), "deferred_shares": ~splits | ~there("shares_available_date") | (F.col("shares_available_date").cast("date") == F.col("ex_date").cast("date")),
    }
    term = lambda kind, suffix, at, c, r, day: F.struct(
        F.concat("event_id", F.lit(suffix)).alias("event_id"), F.col("instrument_id"), F.lit(kind).alias("kind"), F.col(at).cast("timestamp").alias("effective_at"), F.col("captured_at").cast("timestamp").alias("available_at"),
        F.lit(currency).alias("currency"), F.col("source"), F.col("event_id").alias("evidence_id"), c.alias("cash_per_unit"), r.alias("ratio"), day.alias("entitlement_date"),
    )
    none, day = F.lit(None).cast("decimal(38,18)"), F.col("record_date").cast("date")
    made = F.array(
        F.when(pays, term("dividend_entitlement", ":entitlement", "ex_date", cash, none, day)), F.when(pays, term("dividend_payment", ":payment", "pay_date", cash, none, day)),
        F.when(splits, term("split", ":split", "ex_date", none, ratio, F.lit(None).cast("date"))),
    )
    right = [F.coalesce(r, F.lit(False)) for r in rules.values()]
    whole = right[0]
    for r in right[1:]:
        whole = whole & r
    return rows.where(whole).select(F.inline(F.array_compact(made))), violations(rows, rules, ["event_id"])


def explicit_terms(rows: DataFrame, required: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """(rows as they are, violations): records of the kinds EXPLICIT with all that their kind requires (kind -> columns)."""
    if unknown := set(required) - set(EXPLICIT):
        raise ValidationError(f"kinds without explicit terms: {sorted(unknown)}")
    require_columns(rows, ["event_id", "kind", *{c for names in required.values() for c in names}])
    rules = {"kind": F.col("kind").isin(*required)}
    for kind, names in required.items():
        for c in names:
            rules[f"{kind}.{c}"] = (F.col("kind") != kind) | F.col(c).isNotNull() | F.col("kind").isNull()
    found = violations(rows, rules, ["event_id"])
    whole = F.lit(True)
    for r in rules.values():
        whole = whole & F.coalesce(r, F.lit(False))
    return rows.where(whole), found


def traded_rows(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(traded, untraded with reason, violations) of daily rows: those without volume only refer to a price and are set aside.

    Repeated keys, and traded rows with a price that is missing or not positive, are violations and in neither.
    """
    twice = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    r = rows.alias("r").join(twice.alias("t"), same).select("r.*", "_n")
    prices = F.coalesce(F.least("open", "high", "low", "close") > 0, F.lit(False)) & F.col("open").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull() & F.col("close").isNotNull()
    idle = F.col("volume") == 0
    rules = {"repeated_key": F.col("_n") == 1, "volume": F.col("volume") >= 0, "prices": idle | prices}
    ok = (F.col("_n") == 1) & F.coalesce(F.col("volume") >= 0, F.lit(False))
    return r.where(ok & ~idle & prices).select(*rows.columns), r.where(ok & idle).select(*rows.columns, F.lit("untraded").alias("reason")), violations(r, rules, keys)


def indexed_days(trades: DataFrame, *, instrument: str = "instrument_id", sequence: str = "trade_seq", at: str = "traded_at", price: str = "price", index: str = "index_price", amount: str = "amount", slice_rows: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """((instrument, day, open, high, low, close, amount, trades), breaks): UTC days of price times index, in order of sequence.

    breaks: trades whose sequence does not follow the one before by 1, or whose time is before that one's. An instrument's
    trades are compared in slices of sequence, so a busy one is many tasks' work.
    """
    from tidemark.operators.quality import lag_by_slices

    own = trades.select(F.col(instrument).alias("instrument"), F.col(sequence).cast("long").alias("seq"), F.unix_micros(at).alias("us"), (F.col(price) * F.col(index)).alias("value"), F.col(amount).alias("amount"))
    before = lag_by_slices(lag_by_slices(own, ["instrument"], "seq", "seq", "_seq", slice_rows, ("us",)), ["instrument"], "seq", "us", "_us", slice_rows, ("us",))
    breaks = before.where("seq is null or seq <> _seq + 1 or us < _us").select("instrument", "seq", F.col("_seq").alias("before"), "us")
    days = own.withColumn("day", F.to_date(F.timestamp_micros("us"))).groupBy("instrument", "day").agg(
        F.min_by("value", "seq").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "seq").alias("close"), F.sum("amount").alias("amount"), F.count("*").alias("trades")
    )
    return days, breaks


def read_zipped_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """(path, columns as text) of ZIP archives that hold one plain CSV each; anything else raises. Archives are opened where they are read.

    The file within must have all columns, no path in its name, no encryption, at most MOST_BYTES bytes and at most
    MOST_GROWTH times its packed size.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                text = unpacked(bytes(content))
                rows = list(csv.DictReader(io.StringIO(text.decode("utf-8-sig")), strict=True))
                if rows and (missing := set(columns) - {(c or "").strip() for c in rows[0]}):
                    raise ValidationError(f"{name}: missing columns {sorted(missing)}")
                clean = [{(k or "").strip(): v for k, v in r.items()} for r in rows]
                yield pd.DataFrame([[name, *[r[c] for c in columns]] for r in clean], columns=["path", *columns])

    schema = ", ".join(["path string", *[f"`{c}` string" for c in columns]])
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def unpacked(archive: bytes) -> bytes:
    """The one CSV of a ZIP archive."""
    if not archive.startswith(b"PK"):
        raise ValidationError("no ZIP archive")
    with zipfile.ZipFile(io.BytesIO(archive)) as z:
        items = z.infolist()
        if len(items) != 1:
            raise ValidationError("an archive must hold one file")
        item = items[0]
        if not item.filename.endswith(".csv") or "/" in item.filename or "\\" in item.filename or item.flag_bits & 1:
            raise ValidationError("the file must be a plain CSV")
        if item.file_size > min(MOST_BYTES, MOST_GROWTH * max(1, item.compress_size)):
            raise ValidationError("the file is too large")
        return z.read(item)
