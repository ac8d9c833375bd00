"""Violations as rows. An operator that cannot decide returns what it could not decide; ``strict`` turns that into an error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ValidationError(ValueError):
    """Data broke a rule; the message holds some of the rows."""


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValidationError(f"missing columns: {missing}")
    return df


def violations(df: DataFrame, rules: dict[str, Column], keep: list[str]) -> DataFrame:
    """(keep, rule) for each rule that is not true of a row; null is not true. One pass, no shuffle."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    return df.select(*keep, F.explode(broken).alias("rule"))


def strict(found: DataFrame, what: str) -> None:
    """Raise if there are violations."""
    some = found.limit(3).collect()
    if some:
        raise ValidationError(f"{what}: {[r.asDict() for r in some]}")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, copies) of keys that occur more than once; null is a key like others."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def every_copy_of_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of keys that occur more than once: an ambiguous identifier is not resolved by dropping some of its rows."""
    pairs = duplicates(df, keys).drop("copies").alias("d")
    rows = df.alias("r")
    return rows.join(pairs, reduce(lambda a, b: a & b, [F.col(f"r.{k}").eqNullSafe(F.col(f"d.{k}")) for k in keys]), "left_semi")


def positive_int(value: int, name: str) -> int:
    if type(value) is not int or value < 1:
        raise ValidationError(f"{name} must be a positive integer")
    return value
