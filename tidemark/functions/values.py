"""Decimals to fixed point and back, rounding, canonical JSON, checksums, symbols."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDINGS = ("up", "down", "ceiling", "floor", "half_up", "half_down", "half_even", "05up")


def fixed_from_text(text: Column, scale: int, rounding: str | None = None) -> Column:
    """struct<units, scale> of decimal text; without rounding, what does not fit the scale exactly is null."""
    value = F.trim(text).try_cast("decimal(38,18)")
    scaled = value * F.lit(10**scale).cast("decimal(19,0)") if scale else value
    units = scaled.try_cast("decimal(38,18)")
    whole = F.floor(units).cast("decimal(38,0)")
    rest = units - whole
    if rounding is None:
        units = F.when(rest == 0, whole)
    else:
        negative, half = units < 0, rest == F.lit("0.5").cast("decimal(38,18)")
        up = F.ceil(units).cast("decimal(38,0)")
        above = rest > F.lit("0.5").cast("decimal(38,18)")
        nearest = F.when(above, up).otherwise(whole)
        inward, outward = F.when(negative, up).otherwise(whole), F.when(negative, whole).otherwise(up)
        units = {
            "floor": whole, "ceiling": up, "down": inward, "up": F.when(rest == 0, whole).otherwise(outward),
            "half_up": F.when(half, outward).otherwise(nearest), "half_down": F.when(half, inward).otherwise(nearest),
            "half_even": F.when(half, F.when(whole % 2 == 0, whole).otherwise(up)).otherwise(nearest),
            "05up": F.when((rest != 0) & (F.abs(inward) % 5 == 0), outward).otherwise(inward),
        }[rounding]
    return F.when(units.isNotNull(), F.struct(units.try_cast("long").alias("units"), F.lit(scale).cast("smallint").alias("scale")))


def fixed_value(fixed: Column) -> Column:
    """DECIMAL(37,18), exact: any long at scale 0 to 18 fits."""
    units = fixed["units"].cast("decimal(19,0)")
    powers = F.array(*[F.lit(f"1e-{i}").cast("decimal(18,18)") for i in range(1, 19)])
    scaled = (units * F.get(powers, fixed["scale"].cast("int") - 1)).cast("decimal(37,18)")
    return F.when(fixed["scale"] == 0, units.cast("decimal(37,18)")).otherwise(scaled)


def fixed_product(a: Column, b: Column) -> Column:
    """struct<units DECIMAL(38,0), scale int>: exact product, two longs' units fit."""
    return F.struct((a["units"].cast("decimal(19,0)") * b["units"].cast("decimal(19,0)")).alias("units"), (a["scale"].cast("int") + b["scale"].cast("int")).alias("scale"))


def canonical_json(columns: list[str]) -> Column:
    """Compact JSON, keys sorted, nulls written."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def digest(columns: list[str]) -> Column:
    return F.sha2(canonical_json(columns), 256)


def signed_crc32(text: Column) -> Column:
    value = F.crc32(text.cast("binary"))
    return F.when(value >= 2**31, value - 2**32).otherwise(value)


def six_digit_symbol(text: Column) -> Column:
    """The six digits of a domestic code, whatever its prefix, suffix or missing zeros."""
    return F.lpad(F.regexp_extract(trim_upper(text), r"(\d{1,6})", 1), 6, "0")


def exchange_symbol(code: Column) -> Column:
    """sh or sz before a six-digit code: 5, 6 and 9 lead codes of Shanghai."""
    return F.concat(F.when(F.substring(code, 1, 1).isin("5", "6", "9"), "sh").otherwise("sz"), code)


def five_digit_symbol(text: Column) -> Column:
    return F.lpad(F.regexp_extract(trim_upper(text), r"(\d{1,5})", 1), 5, "0")


def four_digit_hk(text: Column) -> Column:
    return F.concat(F.lpad(F.regexp_replace(five_digit_symbol(text), "^0+", ""), 4, "0"), F.lit(".HK"))


def us_symbol(text: Column) -> Column:
    """Upper-case letters, digits, dot and dash, led by a letter; anything else is null."""
    clean = trim_upper(text)
    return F.when(clean.rlike(r"^[A-Z][A-Z0-9.\-]{0,14}$"), clean)


def trim_upper(text: Column) -> Column:
    return F.upper(F.trim(text))


def share_quantity(eligible: Column, numerator: Column, denominator: Column, rule: Column) -> Column:
    """Whole shares of an entitlement by an evidenced rule: floor, ceil, or exact (null if it leaves a fraction)."""
    product = eligible.cast("decimal(19,0)") * numerator.cast("decimal(19,0)")
    rest = product % denominator.cast("decimal(19,0)")
    down = ((product - rest) / denominator.cast("decimal(19,0)")).cast("decimal(38,0)")
    return F.when(rule == "floor", down).when(rule == "ceil", down + (rest > 0).cast("int")).when((rule == "exact") & (rest == 0), down)
