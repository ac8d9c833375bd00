"""Text without outer white space, hex numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode's white space.
BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def plain(text: Column) -> Column:
    """Lower case, without outer white space."""
    return F.lower(trimmed(text))


def hex_number(text: Column) -> Column:
    """A hex number's value as bytes, whatever its case, prefix 0x, leading zeros or outer blanks; else its text."""
    digits = F.regexp_replace(plain(text), "^0x", "")
    short = F.ltrim(digits, F.lit("0"))
    return F.when((F.length(digits) > 0) & digits.rlike("^[0-9a-f]+$") & (F.length(short) <= 64), F.unhex(F.lpad(short, 64, "0"))).otherwise(digits.cast("binary"))
