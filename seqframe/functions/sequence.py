"""Read names, bases and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes of bases, fixed values: the strict alphabet in code order, and the lenient table (gap 5, all else 4).
STRICT = "ACGNT"
LENIENT = {"A": 0, "C": 1, "G": 2, "T": 3, "-": 5}


def trim_mate_suffix(name: Column) -> Column:
    """The name without a final `/digit`, if something is left."""
    return F.regexp_replace(name, "(?s)(?<=.)/[0-9]$", "")


def chop2(name: Column) -> Column:
    """The name without its last two characters, whatever they are; null if it has fewer."""
    n = F.length(name)
    return F.when(n >= 2, F.substring(name, F.lit(1), n - 2))


def with_suffix(name: Column, suffix: str = "/2") -> Column:
    """P5."""
    return F.concat(name, F.lit(suffix))


def none_if_empty(text: Column) -> Column:
    """P3."""
    return F.nullif(text, F.lit(""))


def n_count(seq: Column) -> Column:
    """A5: upper-case N in a sequence."""
    return F.length(seq) - F.length(F.replace(seq, F.lit("N"), F.lit("")))


def has_n(seq: Column) -> Column:
    """F5."""
    return F.contains(seq, F.lit("N"))


def base_code(base: Column) -> Column:
    """0 to 4 for A, C, G, N, T; null for another character."""
    at = F.instr(F.lit(STRICT), base)
    return F.when((F.length(base) == 1) & (at > 0), at - 1)


def is_strict(seq: Column) -> Column:
    return seq.rlike(f"^[{STRICT}]*$")


def lenient_code(base: Column) -> Column:
    """0 to 3 for A, C, G, T in either case, 5 for a gap, 4 for all else."""
    out = F.lit(4)
    for letter, code in LENIENT.items():
        out = F.when(F.upper(base) == letter, code).otherwise(out)
    return out


def in_bounds(seq: Column, start: Column, length: Column) -> Column:
    """whether `length` bases from `start` (from 1) lie in the sequence; a negative length is none."""
    return (start >= 1) & (start - 1 + length <= F.length(seq))


def bases_at(seq: Column, start: Column, length: Column) -> Column:
    """Exactly `length` bases from `start` (from 1), else null."""
    return F.when(in_bounds(seq, start, length), F.when(length > 0, F.substring(seq, start, length)).otherwise(""))


def bkdr_hash(text: Column, factor: int = 1313) -> Column:
    """h = h * factor + code over the (ASCII) characters, modulo 2^64, as a decimal.

    In two halves of 32 bits, as longs: neither leaves 63 bits, and only the last step is a decimal's.
    """
    half, zero = F.lit((1 << 32) - 1).cast("bigint"), F.lit(0).cast("bigint")
    characters = F.filter(F.split(text, ""), lambda c: c != "")

    def step(h: Column, c: Column) -> Column:
        low = h["low"] * factor + F.ascii(c)
        high = h["high"] * factor + F.shiftright(low, 32)
        return F.struct(high.bitwiseAND(half).alias("high"), low.bitwiseAND(half).alias("low"))

    def whole(h: Column) -> Column:
        return (h["high"].cast("decimal(10,0)") * F.lit(1 << 32).cast("decimal(10,0)") + h["low"].cast("decimal(10,0)")).cast("decimal(38,0)")

    return F.aggregate(characters, F.struct(zero.alias("high"), zero.alias("low")), step, whole)
