"""Bases as columns: complements, 2-bit packing and codes of base triples.

A is 0, C 1, G 2 and T 3; a triple's code is 16 * first + 4 * second + third.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"


def revcomp(seq: Column, compat: bool = False) -> Column:
    """Reverse complement; N and other letters stay themselves.

    ``compat`` leaves the middle base of an odd-length sequence uncomplemented, as archives
    written by older encoders expect.
    """
    full = F.reverse(F.translate(seq, "ACGT", "TGCA"))
    if not compat:
        return full
    middle = F.floor((F.length(seq) + 1) / 2).cast("int")
    spliced = F.concat(F.substr(full, F.lit(1), middle - 1), F.substr(seq, middle, F.lit(1)), F.substr(full, middle + 1))
    return F.when(F.length(seq) % 2 == 1, spliced).otherwise(full)


def triple_code(triple: Column) -> Column:
    """0 to 63, or null where a letter is no base or the string isn't three letters long."""
    codes = [F.instr(F.lit(BASES), F.substr(triple, F.lit(i), F.lit(1))) - 1 for i in (1, 2, 3)]
    known = (F.length(triple) == 3) & F.translate(triple, BASES, "").eqNullSafe("")
    return F.when(known, codes[0] * 16 + codes[1] * 4 + codes[2]).cast("int")


def triple_of(code: Column) -> Column:
    """The triple that a code of 0 to 63 stands for."""
    code = code.cast("int")
    parts = [F.substr(F.lit(BASES), (F.floor(code / d) % 4 + 1).cast("int"), F.lit(1)) for d in (16, 4, 1)]
    return F.when((code >= 0) & (code < 64), F.concat(*parts))


def pack_2bit(seq: Column, complement: bool = False) -> Column:
    """Four bases a byte as upper-case hex, first base in the lowest bits of the last byte.

    Letters other than ACGT count as A. With ``complement`` the complemented bases are
    packed in forward order, which equals packing the reverse complement backwards.
    """
    digits = F.translate(seq, "CGTABDEFHIJKLMNOPQRSUVWXYZ", "1230" + "0" * 22)
    if complement:
        digits = F.translate(digits, "0123", "3210")
    else:
        digits = F.reverse(digits)
    width = (F.ceil(F.length(seq) / 4) * 4).cast("int")
    padded = F.lpad(digits, width, "0")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(width, F.lit(2)) - 1, F.lit(2)), lambda i: F.conv(F.substr(padded, i, F.lit(2)), 4, 16))
    return F.when(F.length(seq) > 0, F.array_join(pairs, "")).otherwise(F.lit(""))


def gc_count(seq: Column) -> Column:
    return F.length(seq) - F.length(F.translate(seq, "GC", ""))
