"""Intake by contract: typed columns and a ledger of every cell that did not fit. Rows are never dropped."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.checks import ValidationError, duplicates, require_columns

TYPES = {"string": "string", "integer": "bigint", "number": "double", "boolean": "boolean", "date": "date", "datetime": "timestamp"}
PURPOSES = {"exploration": (), "daily_bars": ("type", "duplicate_key", "missing_key", "ohlc"), "pit_factors": ("type", "duplicate_key", "missing_key", "no_availability")}


@dataclass(frozen=True)
class Contract:
    """columns: output -> (input column, type, format or None); key: output columns; zone: of datetimes without one."""

    columns: dict[str, tuple[str, str, str | None]]
    key: tuple[str, ...] = ()
    kind: str = "table"
    zone: str | None = None
    nullable: frozenset = field(default_factory=frozenset)

    def __post_init__(self) -> None:
        for name, (_, kind, fmt) in self.columns.items():
            if kind not in TYPES:
                raise ValidationError(f"{name}: unknown type {kind}")
            if kind in ("date", "datetime") and not fmt:
                raise ValidationError(f"{name}: dates need an explicit format")
        if missing := set(self.key) - set(self.columns):
            raise ValidationError(f"key columns without mapping: {sorted(missing)}")


def read_delimited(spark: SparkSession, path: str, *, delimiter: str = ",", encoding: str = "utf-8") -> DataFrame:
    """All columns as text. An empty or repeated header name, and rows of another width, raise."""
    first = spark.read.option("encoding", encoding).text(path).limit(1).collect()
    if not first:
        raise ValidationError("no header")
    import csv

    names = next(csv.reader([first[0][0].lstrip("﻿")], delimiter=delimiter))
    if any(not n.strip() for n in names) or len(set(names)) != len(names):
        raise ValidationError(f"header names must be unique and not empty: {names}")
    kind = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.option("header", True).option("sep", delimiter).option("encoding", encoding).option("mode", "FAILFAST").option("enforceSchema", True).option("emptyValue", "").schema(kind).csv(path)


def sample(df: DataFrame, rows: int = 20) -> list[dict]:
    """At most 20 rows to look at; no claim about the others."""
    return [r.asDict() for r in df.limit(min(rows, 20)).collect()]


def _cast(value: Column, kind: str, fmt: str | None, zone: str | None) -> Column:
    text = F.trim(value.cast("string"))
    if kind == "string":
        return value.cast("string")
    if kind == "integer":
        return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))
    if kind == "number":
        number = text.try_cast("double")
        return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
    if kind == "boolean":
        return F.when(F.lower(text).isin("true", "1", "yes"), True).when(F.lower(text).isin("false", "0", "no"), False)
    if kind == "date":
        return F.try_to_timestamp(text, F.lit(fmt)).cast("date")
    at = F.try_to_timestamp(text, F.lit(fmt))
    return F.to_utc_timestamp(at, zone) if zone and "X" not in fmt and "Z" not in fmt and "V" not in fmt else at


def normalize(raw: DataFrame, contract: Contract) -> tuple[DataFrame, DataFrame]:
    """(typed rows with row_number, issues). issues: row_number, column, rule, value. One pass over the cells.

    row_number tells rows apart; it follows the order of files and is not consecutive.
    """
    require_columns(raw, [source for source, *_ in contract.columns.values()])
    own = raw.select(F.monotonically_increasing_id().alias("row_number"), *[F.col(s).alias(f"_raw_{n}") for n, (s, *_) in contract.columns.items()])
    typed = own.select("*", *[_cast(F.col(f"_raw_{n}"), kind, fmt, contract.zone).alias(n) for n, (_, kind, fmt) in contract.columns.items()])
    cell = []
    for n, (_, kind, _fmt) in contract.columns.items():
        blank = F.col(f"_raw_{n}").isNull() | (F.trim(F.col(f"_raw_{n}").cast("string")) == "")
        cell.append(F.when(~blank & F.col(n).isNull(), F.struct(F.lit(n).alias("column"), F.lit("type").alias("rule"), F.col(f"_raw_{n}").cast("string").alias("value"))))
        if n in contract.key:
            cell.append(F.when(F.col(n).isNull(), F.struct(F.lit(n).alias("column"), F.lit("missing_key").alias("rule"), F.col(f"_raw_{n}").cast("string").alias("value"))))
    if {"open", "high", "low", "close"} <= set(contract.columns):
        wrong = (F.col("high") < F.greatest("open", "low", "close")) | (F.col("low") > F.least("open", "high", "close")) | (F.least("open", "high", "low", "close") <= 0)
        cell.append(F.when(wrong, F.struct(F.lit("high").alias("column"), F.lit("ohlc").alias("rule"), F.col("high").cast("string").alias("value"))))
    issues = typed.select("row_number", F.inline(F.array_compact(F.array(*cell))))
    rows = typed.select("row_number", *contract.columns)
    if contract.key:
        keys = list(contract.key)
        twice = rows.join(duplicates(rows.dropna(subset=keys), keys).drop("copies"), keys)
        issues = issues.unionByName(twice.select("row_number", F.lit(keys[0]).alias("column"), F.lit("duplicate_key").alias("rule"), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("value")))
    return rows, issues


def aggregate_issues(issues: DataFrame, samples: int = 20) -> DataFrame:
    """(column, rule, rows, samples): how often, and the first few row numbers."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("column", "rule", F.pmod("row_number", F.lit(64))).orderBy("row_number"))
    few = issues.withColumn("_n", n)  # the first few of each of 64 parts hold the first few of all
    return few.groupBy("column", "rule").agg(F.count("*").alias("rows"), F.slice(F.array_sort(F.collect_list(F.when(n_ok(samples), F.col("row_number")))), 1, samples).alias("samples"))


def n_ok(samples: int) -> Column:
    return F.col("_n") <= samples


def scope(rows: DataFrame, *, symbols: list[str] | None = None, start=None, end=None, symbol: str = "symbol", date: str = "date") -> DataFrame:
    """rows with _selected (surely in scope) and _potential (in scope, or it cannot be told for a null)."""
    yes = F.lit(True)
    maybe = F.lit(True)
    for cond, c in (
        (F.col(symbol).isin(symbols) if symbols is not None else None, symbol),
        (F.col(date) >= F.lit(start) if start is not None else None, date),
        (F.col(date) <= F.lit(end) if end is not None else None, date),
    ):
        if cond is not None:
            yes, maybe = yes & F.coalesce(cond, F.lit(False)), maybe & F.coalesce(cond, F.lit(True))
    return rows.withColumn("_selected", yes).withColumn("_potential", maybe)


def blocking_issues(rows: DataFrame, issues: DataFrame, *, purpose: str = "exploration", columns: list[str] | None = None, **where) -> DataFrame:
    """Issues that a purpose does not admit, of rows that are or may be in scope."""
    if purpose not in PURPOSES:
        raise ValidationError(f"unknown purpose {purpose}")
    found = issues.where(F.col("rule").isin(list(PURPOSES[purpose]) or [""]))
    if columns:
        found = found.where(F.col("column").isin(columns))
    return found.join(scope(rows, **where).where("_potential").select("row_number"), "row_number", "left_semi")


def read_admitted(rows: DataFrame, issues: DataFrame, *, purpose: str = "exploration", columns: list[str] | None = None, **where) -> DataFrame:
    """The rows in scope if the purpose admits them, else an error that lists the rules in the way."""
    found = [r.rule for r in blocking_issues(rows, issues, purpose=purpose, columns=columns, **where).select("rule").distinct().collect()]
    if found:
        raise ValidationError(f"not admitted for {purpose}: {sorted(found)}")
    kept = scope(rows, **where).where("_selected").drop("_selected", "_potential")
    return kept.select(*columns) if columns else kept.drop("row_number")
