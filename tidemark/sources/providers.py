"""Price providers as a Spark data source: one partition for each symbol, fetched on executors.

The functions that fetch are given by the caller; nothing here knows an address.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.checks import ValidationError, strict


@dataclass(frozen=True)
class Provider:
    """fetch(symbol, start, end, adjustment) gives rows (date, open, high, low, close, volume, amount); multipliers bring volume to shares and amount to currency units."""

    name: str
    fetch: Callable[[str, str, str, str], list[tuple]]
    capabilities: frozenset[str] = frozenset({"daily"})
    adjustments: frozenset[str] = frozenset({"none"})
    volume_multiplier: float = 1.0
    amount_multiplier: float = 1.0
    most_tasks: int = 8
    aliases: tuple[str, ...] = ()


@dataclass
class Registry:
    providers: dict[str, Provider] = field(default_factory=dict)

    def add(self, provider: Provider) -> None:
        for name in (provider.name, *provider.aliases):
            if name in self.providers:
                raise ValidationError(f"provider {name} exists")
            self.providers[name] = provider

    def get(self, name: str, adjustment: str = "none") -> Provider:
        if name not in self.providers:
            raise ValidationError(f"unknown provider {name}")
        if adjustment not in self.providers[name].adjustments:
            raise ValidationError(f"{name} has no prices adjusted by {adjustment}")
        return self.providers[name]

    def listed(self, spark: SparkSession, capability: str | None = None) -> DataFrame:
        rows = sorted({(p.name, ",".join(sorted(p.capabilities)), p.most_tasks) for p in self.providers.values() if capability is None or capability in p.capabilities})
        return spark.createDataFrame(rows, "name string, capabilities string, most_tasks int")


def with_retries(once: Callable[[], list], attempts: int, pause: float = 0.0) -> list:
    for n in range(attempts):
        try:
            return once()
        except Exception:  # noqa: BLE001
            if n == attempts - 1:
                raise
            time.sleep(pause)
    raise ValidationError("attempts must be positive")


def fetch_prices(spark: SparkSession, provider: Provider, symbols: list[str], start: str, end: str, *, adjustment: str = "none", attempts: int = 3, pause: float = 0.2, cover_all: bool = True) -> DataFrame:
    """Canonical daily bars of the symbols. At most most_tasks tasks call the provider at once; a symbol without rows raises unless cover_all is off."""
    asked = spark.createDataFrame([(s,) for s in sorted(set(symbols))], "symbol string").repartition(max(1, min(provider.most_tasks, len(set(symbols)))), "symbol")
    fetch, names = provider.fetch, ["date", "open", "high", "low", "close", "volume", "amount"]

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            for s in frame["symbol"]:
                rows = with_retries(lambda s=s: list(fetch(s, start, end, adjustment)), attempts, pause)
                yield pd.DataFrame(rows, columns=names).assign(symbol=s)[["symbol", *names]]

    raw = asked.mapInPandas(run, "symbol string, date string, open double, high double, low double, close double, volume double, amount double")
    out = raw.select(F.col("date").try_cast("date").alias("date"), "symbol", "open", "high", "low", "close", (F.col("volume") * provider.volume_multiplier).alias("volume"), (F.col("amount") * provider.amount_multiplier).alias("amount"), F.lit(provider.name).alias("provider"), F.lit(adjustment).alias("adjustment"))
    from tidemark.sources.shared import written

    out = written(out, "prices")  # providers are asked once
    strict(out.where("date is null or close is null"), "rows without date or close")
    if cover_all:
        strict(asked.join(out.select("symbol").distinct(), "symbol", "left_anti"), "symbols without rows")
    return out.where(F.col("date").between(F.lit(start), F.lit(end)))


def first_that_answers(spark: SparkSession, providers: list[Provider], *args, **kwargs) -> DataFrame:
    """The prices of the first provider that gives all symbols."""
    wrong: list[str] = []
    for p in providers:
        try:
            return fetch_prices(spark, p, *args, **kwargs)
        except Exception as e:  # noqa: BLE001
            wrong.append(f"{p.name}: {str(e)[:200]}")
    raise ValidationError("; ".join(wrong))
