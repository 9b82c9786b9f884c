"""Numbers, durations, sizes and colours as text, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def c_int(text: Column) -> Column:
    """Leading blanks, a sign and digits as a number; 0 where there is none or it is no 32-bit number."""
    # most fields are digits alone, which a cast reads; the pattern is only for the others
    return F.coalesce(text.try_cast("int"), F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0))


def strict_digits(text: Column) -> Column:
    """A run of digits alone as a number, else null."""
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("int"))


def thousands(number: Column) -> Column:
    """`12,345,345`."""
    return F.format_number(number, 0)


def _parts(seconds: Column) -> tuple[Column, Column, Column]:
    s = seconds.cast("bigint")
    return F.floor(s / 3600).cast("bigint"), F.floor(F.pmod(s, F.lit(3600)) / 60).cast("bigint"), F.pmod(s, F.lit(60)).cast("bigint")


def clock(seconds: Column) -> Column:
    """Whole seconds, cut off, as `HH:MM:SS`; hours go beyond 24."""
    return F.format_string("%02d:%02d:%02d", *_parts(seconds))


def clock_ceil(seconds: Column) -> Column:
    """Seconds, rounded up, as `H:MM:SS`."""
    return F.format_string("%d:%02d:%02d", *_parts(F.ceil(seconds)))


def clock_seconds(text: Column) -> Column:
    """`H:M:S` (or any number of parts in base 60) as seconds; null if a part is no number."""
    return F.aggregate(F.split(text, ":"), F.lit(0.0), lambda total, part: total * 60 + part.try_cast("double"))


def fixed(number: Column, digits: int) -> Column:
    """A double with so many decimals, as C's `%.<digits>f`: the exact binary value is rounded, ties to even.

    The product with 10^digits may land on a tie that the exact one misses; the rest of the product, exact by splitting the number
    into two halves, tells on which side it is. Numbers of 15 digits or more with their decimals are written as Java does.
    """
    scale = 10.0**digits
    x = F.abs(number.cast("double"))
    product = x * scale
    whole = F.floor(product)
    high = x * 134217729.0 - (x * 134217729.0 - x)
    rest = (high * scale - product) + (x - high) * scale
    tie = product - whole == 0.5
    up = F.when(tie, (rest > 0) | ((rest == 0) & (whole % 2 == 1))).otherwise(product - whole > 0.5)
    n = whole + up.cast("bigint")
    unit = 10**digits
    text = ((n - n % unit) / unit).cast("bigint").cast("string")
    if digits:
        text = F.concat(text, F.lit("."), F.lpad((n % unit).cast("bigint").cast("string"), digits, "0"))
    negative = (number < 0) | (number.cast("string") == "-0.0")
    exact = F.concat(F.when(negative, "-").otherwise(""), text)
    return F.when(x < 1e15 / scale, exact).when(F.isnan(x), "nan").when(x.isNotNull(), F.format_string(f"%.{digits}f", number.cast("double")))


def memory_text(kilobytes: Column) -> Column:
    """`12 KB`, `34 MB` (cut off), `5.6 GB` (rounded like C)."""
    kb = kilobytes.cast("bigint")
    return (
        F.when(kb < 1024, F.format_string("%d KB", kb))
        .when(kb < 1024 * 1024, F.format_string("%d MB", F.floor(kb / 1024)))
        .otherwise(F.concat(fixed(kb / F.lit(1024.0 * 1024.0), 1), F.lit(" GB")))
    )


def memory_short(kilobytes: Column) -> Column:
    """X11: `7G` or `12M`, rounded up, `<1M`, or `None` for nothing."""
    kb = kilobytes.cast("double")
    return (
        F.when(kb == 0, "None")
        .when(kb > 1024 * 1024, F.concat(F.ceil(kb / 1024 / 1024).cast("string"), F.lit("G")))
        .when(kb > 1024, F.concat(F.ceil(kb / 1024).cast("string"), F.lit("M")))
        .otherwise("<1M")
    )


def hex_colour(red: Column, green: Column, blue: Column) -> Column:
    """`#rrggbb`."""
    return F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex(x)), 2, "0") for x in (red, green, blue)])


def fields(line: Column) -> Column:
    """The fields of a line between blanks."""
    return F.split(F.trim(line), r"\s+")
