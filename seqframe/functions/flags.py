"""The bits of an alignment's flag."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits by name, fixed values of the format.
BITS = {
    "multi_segment": 0x1,
    "both_aligned": 0x2,
    "unmapped": 0x4,
    "mate_unmapped": 0x8,
    "reverse": 0x10,
    "mate_reverse": 0x20,
    "read1": 0x40,
    "read2": 0x80,
    "secondary": 0x100,
    "filtered": 0x200,
    "duplicate": 0x400,
    "supplementary": 0x800,
}


def has(flag: Column, *names: str) -> Column:
    """Whether any of the named bits is set."""
    mask = 0
    for n in names:
        mask |= BITS[n]
    return flag.bitwiseAND(F.lit(mask)) != 0


def mapped(flag: Column) -> Column:
    return ~has(flag, "unmapped")


def primary(flag: Column) -> Column:
    """Mapped, and neither secondary nor supplementary."""
    return ~has(flag, "unmapped", "secondary", "supplementary")
