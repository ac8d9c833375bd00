"""Fixed point numbers (struct<units long, scale int>) and instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_POWERS = [10**i for i in range(19)]


def fixed_e8(value: Column) -> Column:
    """Value times 10^8 as long; null if null or beyond long. Decimals after the eighth are cut off."""
    units, scale = value["units"], value["scale"].cast("int")
    powers = F.array(*[F.lit(p).cast("long") for p in _POWERS])
    up = F.try_multiply(units, F.get(powers, F.lit(8) - scale))
    down = F.get(powers, scale - F.lit(8))
    return F.when(scale <= 8, up).otherwise(F.call_function("div", units, down))


def _whole(value: Column) -> Column:
    return value.cast("decimal(20,0)")


_SIZE = str(1 << 64)


def packed(high: Column, low: Column) -> Column:
    """Two longs as one decimal that orders like (high, low); high is within 2^62. Unlike a struct it can be hash-aggregated."""
    return (_whole(high) * _whole(F.lit(_SIZE)) + _whole(low)).cast("decimal(38,0)")


def packed_low(value: Column) -> Column:
    size = _whole(F.lit(_SIZE))
    low = F.pmod(value, size)
    return F.when(low >= _whole(F.lit(str(1 << 63))), low - size).otherwise(low).cast("long")


def packed_high(value: Column) -> Column:
    return F.round((value - _whole(packed_low(value))) / _whole(F.lit(_SIZE)), 0).cast("long")


def micros(instant: Column) -> Column:
    return F.unix_micros(instant)


def parse_instant(text: Column) -> Column:
    """ISO text with zone to TIMESTAMP; text without a zone, or none at all, is null."""
    clean = F.trim(text)
    return F.when(clean.rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(clean))
