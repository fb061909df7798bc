"""Chunk numbers that keep the order of a column.

A group that holds a third of all rows must not be sorted in one task. Its rows are
spread over chunks instead; a chunk number is a plain expression of the value alone, and
never falls when the value rises. So chunks can be sorted apart, and the few chunk totals
of a group join them up again.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from staytide.functions.values import as_col

_LARGEST = 1.7e308


def number_chunk(c: Column | str, bits: int = 12) -> Column:
    """Chunk of a number: its power of two, cut into 2**bits equal parts."""
    c = as_col(c).cast("double")
    size = F.least(F.abs(c), F.lit(_LARGEST))
    power = F.floor(F.log2(size))
    parts = 1 << bits
    place = F.floor((size / F.pow(F.lit(2.0), power.cast("double")) - 1) * parts)
    place = F.greatest(F.lit(0), F.least(F.lit(parts - 1), place))
    code = (power + 1100) * parts + place
    return F.when(c > 0, code).when(c < 0, -code).when(c == 0, F.lit(0).cast("bigint"))


def time_chunk(micros: Column | str, width_us: Column | int) -> Column:
    """Chunk of a time: whole widths since 1970."""
    micros = as_col(micros)
    width = width_us if isinstance(width_us, Column) else F.lit(width_us)
    return ((micros - F.pmod(micros, width)) / width).cast("bigint")


def text_chunk(hex_text: Column | str, digits: int = 4) -> Column:
    """Chunk of a hash in hexadecimal: its first digits."""
    return F.substring(as_col(hex_text), 1, digits)
