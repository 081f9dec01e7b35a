"""Header fields as columns: tokens, separators and their codes, numeric tests and widths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that end a field, in the order of their 3-bit codes.
SEPARATORS = " .:-#"
_CLASS = r"[ #.:\-]"


def tokens(header: Column) -> Column:
    """Fields of a header without its first character; empty fields count, the last one too."""
    return F.split(F.substr(header, F.lit(2)), _CLASS, -1)


def separators(header: Column) -> Column:
    """The separators of a header in order, as one string."""
    return F.regexp_replace(F.substr(header, F.lit(2)), r"[^ #.:\-]", "")


def separator_code(char: Column) -> Column:
    return F.instr(F.lit(SEPARATORS), char) - 1


def is_numeric(value: Column, compat: bool = False) -> Column:
    """Whether the field can be stored as a number.

    ``compat`` takes any sign and leading zeros, which are lost on the way back; the default only
    takes decimals that come back as they were.
    """
    return value.rlike(r"^[+-]?[0-9]+$" if compat else r"^(0|[1-9][0-9]{0,17})$")


def digits(value: Column, base: int = 10) -> Column:
    """Digits of a non-negative integer in base 2 or 10; 1 for 0."""
    return F.length(F.bin(value)) if base == 2 else F.length(value.cast("string"))


def chunk_of(index: Column, entries: Column, chunks: int = 16) -> Column:
    """Chunk of a 0-based row when ``entries`` rows are cut at entries * i / chunks, remainders spread."""
    return F.floor((F.lit(chunks) * (index + 1) - 1) / entries).cast("int")


def bits(value: Column, width: Column) -> Column:
    """``value`` as a string of ``width`` binary digits."""
    return F.lpad(F.bin(value), width, "0")


def from_bits(text: Column) -> Column:
    """The number that a string of binary digits stands for; 0 for an empty one."""
    return F.when(F.length(text) > 0, F.conv(text, 2, 10).cast("long")).otherwise(F.lit(0).cast("long"))
