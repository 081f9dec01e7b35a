"""Bit strings as bytes: packing and unpacking of columns, of batches by numpy, and a cursor for Python code.

Bits go from the highest of each byte to the lowest; the last byte is filled with zeros.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_NIBBLES = {f"{i:04b}": f"{i:X}" for i in range(16)}


def pack(bits: Column) -> Column:
    """A string of binary digits as BINARY."""
    digits = F.create_map(*(F.lit(x) for kv in _NIBBLES.items() for x in kv))
    width = (F.ceil(F.length(bits) / 8) * 8).cast("int")
    padded = F.rpad(bits, width, "0")
    hexed = F.transform(F.sequence(F.lit(1), F.greatest(width, F.lit(4)) - 3, F.lit(4)), lambda i: F.element_at(digits, F.substr(padded, i, F.lit(4))))
    return F.when(F.length(bits) > 0, F.unhex(F.array_join(hexed, ""))).otherwise(F.lit(b""))


def unpack(data: Column) -> Column:
    """BINARY as a string of binary digits, eight a byte."""
    digits = F.create_map(*(F.lit(x) for k, v in _NIBBLES.items() for x in (v, k)))
    hexed = F.hex(data)
    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.length(hexed), F.lit(1))), lambda i: F.element_at(digits, F.substr(hexed, i, F.lit(1))))
    return F.when(F.length(hexed) > 0, F.array_join(parts, "")).otherwise(F.lit(""))


def entry(data: Column, at: Column, width: int) -> Column:
    """Number ``at`` (from 0) of BINARY that holds numbers of ``width`` bits each; only its own bytes are unpacked. Null past the end."""
    first = at.cast("long") * width
    byte = F.floor(first / 8)
    own = F.substring(data, (byte + 1).cast("int"), F.lit(width // 8 + 2))
    if width <= 40:  # its bytes are one number, of 56 bits at most
        behind = F.octet_length(own) * 8 - (first - byte * 8) - width
        found = F.call_function("shiftright", F.conv(F.hex(own), 16, 10).cast("long"), behind.cast("int")).bitwiseAND((1 << width) - 1)
    else:
        found = F.conv(F.substr(unpack(own), (first - byte * 8 + 1).cast("int"), F.lit(width)), 2, 10).cast("long")
    return F.when((at >= 0) & (first + width <= F.octet_length(data) * 8), found)


def size(bits: Column) -> Column:
    """Bytes that so many bits take."""
    return F.ceil(bits / 8).cast("long")


def rows_of(values: np.ndarray, widths: np.ndarray, ends: np.ndarray) -> pa.BinaryArray:
    """Numbers of given widths (32 bits at most) as bytes; row i has those between entries i and i + 1
    of ``ends``. Each row begins with a byte of its own and is filled with zeros.
    """
    upto = np.concatenate([[0], np.cumsum(widths, dtype=np.int64)])
    bits = upto[ends]
    starts = np.concatenate([[0], np.cumsum((np.diff(bits) + 7) >> 3)])
    place = upto[:-1] + np.repeat(8 * starts[:-1] - bits[:-1], np.diff(ends))
    word, placed = place >> 5, values.astype(np.uint64) << (64 - widths - (place & 31)).astype(np.uint64)
    count = (int(starts[-1]) >> 2) + 2
    words = np.bincount(word, (placed >> np.uint64(32)).astype(np.float64), count)  # no bit is set twice, so sums are exact
    words[1:] += np.bincount(word, (placed & np.uint64(0xFFFFFFFF)).astype(np.float64), count)[:-1]
    return binary(words.astype(">u4").view(np.uint8)[: starts[-1]], starts)


def binary(data: np.ndarray, starts: np.ndarray) -> pa.BinaryArray:
    """BINARY values of ``data``, bytes one behind the other; value i has those from starts[i] to starts[i + 1] - 1."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


class Windows:
    """The bytes of a batch of BINARY without nulls, read at many bits at once. Value i has those from starts[i] to starts[i + 1] - 1."""

    def __init__(self, data: pa.BinaryArray):
        at = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
        held = data.buffers()[2]
        self.bytes = np.frombuffer(held, np.uint8)[at[0] : at[-1]] if held is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        self.starts = at - at[0]
        more = np.concatenate([self.bytes, np.zeros(16, np.uint8)])
        self.words = np.ndarray((len(more) - 7,), ">u8", more, strides=(1,)).astype(np.uint64)  # the eight bytes from each one on

    def at(self, bits: np.ndarray) -> np.ndarray:
        """What stands from each bit on, in the highest 57 bits of a number of 64."""
        return self.words[bits >> 3] << (bits & 7).astype(np.uint64)

    def numbers(self, bits: np.ndarray, widths: np.ndarray | int) -> np.ndarray:
        """The number of each width, up to 57 bits, that begins at each bit."""
        return (self.at(bits) >> np.asarray(64 - widths).astype(np.uint64)).astype(np.int64)


class BitWriter:
    """Collects numbers of given widths; ``data`` is the bytes so far, filled with zeros."""

    def __init__(self):
        self.parts: list[str] = []

    def write(self, value: int, width: int) -> None:
        if value < 0 or value >> width:
            raise ValueError(f"{value} doesn't fit in {width} bits")
        if width:
            self.parts.append(f"{value:0{width}b}")

    def bits(self, text: str) -> None:
        self.parts.append(text)

    def pad(self, to: int = 8) -> None:
        """Zeros up to a multiple of ``to`` bits."""
        self.parts.append("0" * (-sum(map(len, self.parts)) % to))

    @property
    def data(self) -> bytes:
        text = "".join(self.parts)
        text += "0" * (-len(text) % 8)
        return int(text, 2).to_bytes(len(text) // 8, "big") if text else b""


class BitReader:
    """Reads numbers of given widths; reading past the end is an error."""

    def __init__(self, data: bytes):
        self.text, self.at = f"{int.from_bytes(data, 'big'):0{len(data) * 8}b}" if data else "", 0

    def read(self, width: int) -> int:
        if self.at + width > len(self.text):
            raise EOFError("no more bits")
        self.at += width
        return int(self.text[self.at - width : self.at], 2) if width else 0

    def seek(self, bit: int) -> None:
        """Go to a bit counted from the start."""
        if not 0 <= bit <= len(self.text):
            raise EOFError("no such bit")
        self.at = bit

    def align(self) -> None:
        self.at += -self.at % 8

    @property
    def ended(self) -> bool:
        return self.at >= len(self.text)
