"""Older codecs of quality strings: run lengths, Huffman, deltas, LZW. Sizes by column functions, and round trips through bytes."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import packed
from ..functions import runs as fn

#: The Huffman code of 38 quality characters, from the histogram of 100 million scores.
HUFFMAN = {
    "#": "101111", "%": "11111101011000", "&": "11111101011001", "'": "1111110101101", "(": "111111010100",
    ")": "101110100100", "*": "111111010101", "+": "10111010011", ",": "11111000010", "-": "111111010111",
    ".": "1011101000", "/": "11111000011", "0": "11111101110", "1": "11111101111", "2": "1111100000",
    "3": "1111110100", "4": "1111110110", "5": "111110010", "6": "101110101", "7": "111110011",
    "8": "111110001", "9": "10101110", ":": "10101111", ";": "10111011", "<": "1010110", "=": "11111100",
    ">": "1011100", "?": "1111101", "@": "1111111", "A": "101010", "B": "10110", "C": "10100",
    "D": "11110", "E": "1110", "F": "110", "G": "100", "H": "0", "I": "101110100101",
}

#: Bits of each symbol of the delta code, 0 to 110; its 45th stands for no step and ends a read.
DELTA_BITS = (
    23, 23, 23, 23, 23, 23, 23, 23, 16, 16, 15, 13, 13, 13, 13, 12, 12, 11, 13, 13, 12, 12, 12, 11, 11, 11, 11, 10, 10, 10, 10, 9, 9, 9, 9, 8, 8,
    7, 7, 6, 6, 5, 4, 3, 3, 6, 3, 3, 4, 5, 6, 6, 7, 7, 8, 8, 9, 9, 9, 9, 10, 10, 10, 11, 11, 11, 12, 12, 12, 12, 13, 13, 14, 14,
    15, 17, 16, 18, 23, 23, 22, 22, 22, 22, 22, 22, 22, 22, 22, 22, 22, 4, 5, 6, 7, 7, 8, 8, 8, 9, 9, 9, 10, 10, 10, 10, 10, 10, 10, 11, 7,
)

#: Letters of quality strings, ! to ~. The older codecs knew the first 41 of them.
LETTERS = "".join(map(chr, range(33, 127)))
_FIRST = {c: i + 1 for i, c in enumerate(LETTERS)}


def _sized(quals: DataFrame, name: str, of, more: int = 0) -> DataFrame:
    """(read_id, name): the sum of ``of``, given characters and lengths of runs, over a read's runs, and ``more``. Null and empty qualities have no row."""

    def run(batches):
        for b in batches:
            chars, n, ends = fn.runs(b.column("qual"))
            upto = np.concatenate([[0], np.cumsum(of(chars, n), dtype=np.int64)])
            yield pa.RecordBatch.from_arrays([b.column("read_id"), pa.array(upto[ends[1:]] - upto[ends[:-1]] + more)], names=["read_id", name])

    return quals.where(F.length("qual") > 0).select("read_id", "qual").mapInArrow(run, f"read_id {quals.schema['read_id'].dataType.simpleString()}, {name} long")


def naive_run_size(quals: DataFrame, longest: int = 127) -> DataFrame:
    """(read_id, bytes): a byte for the character and one for a count of at most ``longest``."""
    return _sized(quals, "bytes", lambda c, n: 2 * -(-n // longest))


def bit_run_size(quals: DataFrame, char_bits: int = 6, count_bits: int = 4) -> DataFrame:
    """(read_id, bits): character and count in few bits, and a stop code. Counts reach 2**count_bits - 1, so they always fit."""
    most = (1 << count_bits) - 1
    return _sized(quals, "bits", lambda c, n: -(-n // most) * (char_bits + count_bits), char_bits)


def flagged_run_size(quals: DataFrame, char_bits: int = 6, count_bits: int = 7) -> DataFrame:
    """(read_id, bits): character, a flag, and a count - 2 where the flag is set; runs are cut so that counts fit."""
    most = (1 << count_bits) + 1

    def bits(c, n):
        rest = n % most
        return n // most * (char_bits + 1 + count_bits) + np.where(rest == 0, 0, char_bits + 1 + np.where(rest == 1, 0, count_bits))

    return _sized(quals, "bits", bits)


def huffman_size(quals: DataFrame, escape_bits: int = 22) -> DataFrame:
    """(read_id, bits, bytes): bits of the fixed code; characters without one would take an escape of ``escape_bits``."""
    bits = np.full(129, escape_bits)
    for c, code in HUFFMAN.items():
        bits[ord(c)] = len(code)
    whole = _sized(quals, "bits", lambda c, n: n * bits[np.minimum(c, 128)])
    return whole.select("read_id", "bits", F.ceil(F.col("bits") / 8).cast("long").alias("bytes"))


def delta_symbols(text: pa.Array, start: str = "H", middle: int = 45, base: int = 90, most: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Steps between neighbours as middle + step; equal ones as base + count in stretches
    of at most ``most``. The first character is compared with ``start``; all characters count. Row i of a batch has the symbols between entries i and i + 1
    of the second array.
    """
    moves, n, ends = _moves(text, start)
    return fn.stretched(moves + middle, moves != 0, n - (moves != 0), base, most, ends)


def _moves(text: pa.Array, start: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``fn.runs`` with each character's distance from the one before it, the first one's from ``start``."""
    chars, n, ends = fn.runs(text)
    prev = np.empty_like(chars)
    prev[1:] = chars[:-1]
    prev[ends[:-1][ends[:-1] < len(chars)]] = ord(start)
    return chars - prev, n, ends


def delta_runs(quals: DataFrame) -> DataFrame:
    """(read_id, ord, symbol): the symbols of ``delta_symbols``."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("read_id"), fn.lists(*delta_symbols(b.column("qual")))], names=["read_id", "p"])

    listed = quals.select("read_id", "qual").mapInArrow(run, f"read_id {quals.schema['read_id'].dataType.simpleString()}, p array<int>")
    return listed.select("read_id", F.posexplode("p").alias("ord", "symbol"))


def delta_run_size(quals: DataFrame) -> DataFrame:
    """(read_id, bits) under the fixed code, the end of the read included."""
    bits, count = np.array(DELTA_BITS), len(DELTA_BITS)

    def run(batches):
        for b in batches:
            found, at = delta_symbols(b.column("qual"))
            place = found + (found < 0)  # symbols below -1 count from the end, as the SQL's list does
            if ((found == -1) | (place < -count) | (place >= count)).any():
                raise ValueError("a step beyond the fixed code")
            upto = np.concatenate([[0], np.cumsum(bits[place])])[at]
            yield pa.RecordBatch.from_arrays([b.column("read_id"), pa.array(np.diff(upto) + DELTA_BITS[45])], names=["read_id", "bits"])

    return quals.where(F.length("qual") > 0).select("read_id", "qual").mapInArrow(run, f"read_id {quals.schema['read_id'].dataType.simpleString()}, bits long")


#: Bytes of a batch that are coded at once, and of how few rows each takes its steps by itself.
SOME, FEW = 1 << 19, 64


def _cuts(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """(first, count) of rows whose sizes add up to ``most`` or, with a longer row, somewhat above."""
    part = (np.cumsum(sizes, dtype=np.int64) - sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    return [(x, y - x) for x, y in zip(edges, edges[1:]) if y > x]


def _batched(kind: pa.DataType):
    """For a function over all values of an array, of which none is null: it gets some ``SOME`` bytes at once, and null stays null."""

    def over(code):
        @functools.wraps(code)
        def whole(given: pa.Array, *args, **named) -> pa.Array:
            full = given.drop_null()
            parts = [code(full.slice(*cut), *args, **named) for cut in _cuts(pc.binary_length(full).to_numpy(zero_copy_only=False), SOME)]
            found = pa.concat_arrays([pa.array([], kind), *parts])
            if not given.null_count:
                return found
            there = given.is_valid().to_numpy(zero_copy_only=False)
            return found.take(pa.array(np.cumsum(there) - 1, mask=~there))

        return whole

    return over


def _one(whole):
    """The same for one string or its bytes."""
    return lambda x, *args, **named: whole(pa.array([x]), *args, **named)[0].as_py()


def _repeated(chars: np.ndarray, times: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Strings of runs; row i has those from ends[i] to ends[i + 1] - 1."""
    narrow = chars.astype(np.uint8 if not len(chars) or chars.max() < 128 else np.uint32)
    return fn.text_of(np.repeat(narrow, times), np.concatenate([[0], np.cumsum(times, dtype=np.int64)])[ends])


def _letters(chars: np.ndarray, bits: int) -> np.ndarray:
    """Characters as numbers from 0; all ones are no character."""
    if len(chars) and not 33 <= chars.min() <= chars.max() < 33 + (1 << bits) - 1:
        raise ValueError(f"a character that doesn't fit in {bits} bits")
    return chars - 33


def _stopped(values: np.ndarray, widths: np.ndarray, ends: np.ndarray, bits: int) -> pa.Array:
    """Rows of numbers as bytes, behind each row all ones in place of a character."""
    return packed.rows_of(np.insert(values, ends[1:], (1 << bits) - 1), np.insert(widths, ends[1:], bits), ends + np.arange(len(ends)))


def _before(stops: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, ends) of a row's entries before its first stop."""
    at = np.append(np.flatnonzero(stops), len(stops))
    first = at[np.searchsorted(at, ends[:-1])]
    if (first >= ends[1:]).any():
        raise ValueError("a row without an end")
    sizes = first - ends[:-1]
    return fn.stretch(ends[:-1], sizes), np.concatenate([[0], np.cumsum(sizes)])


def _walked(data: packed.Windows, places: np.ndarray, stops: np.ndarray, look) -> tuple[np.ndarray, np.ndarray]:
    """(found, ends): what ``look`` finds in each row from bit ``places`` to bit ``stops``, one symbol behind the other.

    ``look`` gives symbols and their widths in bits for windows; width 0 ends a row. All rows take each step together; in the last few rows
    every bit is looked at first.
    """
    count, live, step = len(places), np.flatnonzero(places < stops), 0
    places, stop = places[live], stops[live]
    who, what, when = [], [], []
    while len(live) >= FEW:
        found, widths = look(data.at(places))
        who.append(live)
        what.append(found)
        when.append(np.full(len(live), step))
        places, step = places + widths, step + 1
        on = (widths > 0) & (places < stop)
        if not on.all():
            if (places > stop).any():
                raise ValueError("the code ends inside a symbol")
            live, places, stop = live[on], places[on], stop[on]
    for lane, place, end in zip(live.tolist(), places.tolist(), stop.tolist()):
        found = _followed(data, place, end, look)
        who.append(np.full(len(found), lane))
        what.append(found)
        when.append(step + np.arange(len(found)))
    if not who:
        return np.zeros(0, np.int64), np.zeros(count + 1, np.int64)
    lane = np.concatenate(who)
    ends = np.concatenate([[0], np.cumsum(np.bincount(lane, minlength=count))])
    out = np.empty(len(lane), np.int64)
    out[ends[lane] + np.concatenate(when)] = np.concatenate(what)
    return out, ends


def _followed(data: packed.Windows, place: int, stop: int, look) -> np.ndarray:
    """``_walked`` in one row."""
    places, width = [], 1
    while width and place < stop:
        base = place
        widths = look(data.at(np.arange(base, min(base + SOME, stop))))[1].tolist()
        while width and place - base < len(widths):
            places.append(place)
            width = widths[place - base]
            place += width
    if place > stop:
        raise ValueError("the code ends inside a symbol")
    return look(data.at(np.array(places, np.int64)))[0]


@_batched(pa.binary())
def naive_packed(text: pa.Array, longest: int = 127) -> pa.Array:
    chars, n, ends = fn.runs(text)
    run, sizes, upto = fn.pieces(n, longest)
    if len(chars) and max(chars.max(), longest) > 255:
        raise ValueError("a character or a count that doesn't fit in a byte")
    return packed.binary(np.stack([chars[run], sizes], axis=1).astype(np.uint8).ravel(), 2 * upto[ends])


@_batched(pa.string())
def naive_unpacked(data: pa.Array) -> pa.Array:
    w = packed.Windows(data)
    if (w.starts & 1).any():
        raise ValueError("half a run")
    return _repeated(w.bytes[::2], w.bytes[1::2], w.starts >> 1)


@_batched(pa.binary())
def bit_run_packed(text: pa.Array, char_bits: int = 7, count_bits: int = 4) -> pa.Array:
    """Character and count in few bits; all ones in place of a character stop. Seven bits hold all of ``LETTERS``, six the older 41."""
    chars, n, ends = fn.runs(text)
    run, sizes, upto = fn.pieces(n, (1 << count_bits) - 1)
    return _stopped(_letters(chars, char_bits)[run] << count_bits | sizes, np.full(len(run), char_bits + count_bits), upto[ends], char_bits)


@_batched(pa.string())
def bit_run_unpacked(data: pa.Array, char_bits: int = 7, count_bits: int = 4) -> pa.Array:
    w, width = packed.Windows(data), char_bits + count_bits
    most = (8 * np.diff(w.starts) - char_bits) // width + 1  # with the stop
    ends = np.concatenate([[0], np.cumsum(most)])
    found = w.numbers(np.repeat(8 * w.starts[:-1], most) + width * fn.stretch(np.zeros(len(most), np.int64), most), width)
    places, ends = _before(found >> count_bits == (1 << char_bits) - 1, ends)
    return _repeated((found[places] >> count_bits) + 33, found[places] & ((1 << count_bits) - 1), ends)


@_batched(pa.binary())
def flagged_packed(text: pa.Array, char_bits: int = 7, count_bits: int = 7) -> pa.Array:
    """Character, a flag, and a count - 2 where the flag is set; all ones in place of a character stop."""
    chars, n, ends = fn.runs(text)
    run, sizes, upto = fn.pieces(n, (1 << count_bits) + 1)
    letter, flag = _letters(chars, char_bits)[run], sizes > 1
    return _stopped(np.where(flag, (2 * letter + 1 << count_bits) + sizes - 2, 2 * letter), char_bits + 1 + count_bits * flag, upto[ends], char_bits)


@_batched(pa.string())
def flagged_unpacked(data: pa.Array, char_bits: int = 7, count_bits: int = 7) -> pa.Array:
    w, stop = packed.Windows(data), (1 << char_bits) - 1

    def look(windows):
        found = (windows >> np.uint64(63 - char_bits - count_bits)).astype(np.int64)
        return found, np.where(found >> count_bits + 1 == stop, 0, char_bits + 1 + count_bits * (found >> count_bits & 1))

    found, ends = _walked(w, 8 * w.starts[:-1], 8 * w.starts[1:], look)
    places, ends = _before(found >> count_bits + 1 == stop, ends)
    found = found[places]
    return _repeated((found >> count_bits + 1) + 33, np.where(found >> count_bits & 1, (found & ((1 << count_bits) - 1)) + 2, 1), ends)


class Prefixes:
    """A prefix code: bits by symbol. A row is a byte with the number of filling bits, then the bits."""

    def __init__(self, codes: dict[int, str]):
        self.value, self.width = np.zeros((2, max(codes) + 2), np.int64)  # a symbol without a code has width 0
        spans = []  # the first 64 bits of what a code begins; gaps between codes are no symbol
        upto = 0
        for s, bits in sorted(codes.items(), key=lambda x: x[1]):
            self.value[s], self.width[s] = int(bits, 2), len(bits)
            low = int(bits, 2) << 64 - len(bits)
            spans += [(upto, -1, 0)] * (upto < low) + [(low, s, len(bits))]
            upto = low + (1 << 64 - len(bits))
        spans += [(upto, -1, 0)] * (upto < 1 << 64)
        self.lows, self.symbols, self.widths = np.array([x[0] for x in spans], np.uint64), np.array([x[1] for x in spans]), np.array([x[2] for x in spans])

    def packed(self, symbols: np.ndarray, ends: np.ndarray) -> pa.Array:
        widths = self.width[symbols]
        fill = -np.diff(np.concatenate([[0], np.cumsum(widths)])[ends]) % 8
        return packed.rows_of(np.insert(self.value[symbols], ends[:-1], fill), np.insert(widths, ends[:-1], 8), ends + np.arange(len(ends)))

    def look(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.lows, windows, side="right") - 1
        return self.symbols[at], self.widths[at]

    def unpacked(self, data: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, ends)."""
        w = packed.Windows(data)
        found, ends = _walked(w, 8 * w.starts[:-1] + 8, 8 * w.starts[1:] - w.bytes[w.starts[:-1]], self.look)
        if len(found) and found.min() < 0:
            raise ValueError("bits that no symbol has")
        return found, ends


#: Before a string that stays as it is.
_MARK = pa.scalar(b"\x08", pa.binary())


def _unless(odd: np.ndarray, given: pa.Array, as_is, others) -> pa.Array:
    """``as_is`` of the odd rows, ``others`` of the others."""
    rest = given.filter(pa.array(~odd))
    if not odd.any():
        return others(rest)
    parts = [as_is(given.filter(pa.array(odd)))] + ([others(rest)] if len(rest) else [])
    return pa.concat_arrays(parts).take(pa.array(np.where(odd, np.cumsum(odd) - 1, odd.sum() + np.cumsum(~odd) - 1)))


def _kept(text: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(_MARK, text.cast(pa.binary()), pa.scalar(b"", pa.binary()))


def _unmarked(data: pa.Array, others) -> pa.Array:
    """Strings that stayed as they are, and ``others`` of the other rows."""
    w = packed.Windows(data)
    if (np.diff(w.starts) == 0).any():
        raise ValueError("a row without a first byte")

    def as_is(some):
        w = packed.Windows(some)
        sizes = np.diff(w.starts) - 1
        return packed.binary(w.bytes[fn.stretch(w.starts[:-1] + 1, sizes)], np.concatenate([[0], np.cumsum(sizes)])).cast(pa.string())

    return _unless(w.bytes[w.starts[:-1]] == 8, data, as_is, others)


_HUFFMAN_CODE = Prefixes({ord(c): b for c, b in HUFFMAN.items()})


@_batched(pa.binary())
def huffman_packed(text: pa.Array) -> pa.Array:
    """The fixed code; a string with a character that has no code stays as it is, marked by 8."""
    last = len(_HUFFMAN_CODE.width) - 1  # has no code
    chars, at = fn.points(text)
    none = np.concatenate([[0], np.cumsum(_HUFFMAN_CODE.width[np.minimum(chars, last)] == 0)])
    return _unless(np.diff(none[at]) > 0, text, _kept, lambda x: _HUFFMAN_CODE.packed(*fn.points(x)))


@_batched(pa.string())
def huffman_unpacked(data: pa.Array) -> pa.Array:
    return _unmarked(data, lambda x: fn.text_of(*_HUFFMAN_CODE.unpacked(x)))


def _canonical(lengths) -> dict[int, str]:
    """Prefix code with these lengths: shorter first, then by symbol."""
    code, last, out = 0, 0, {}
    for n, s in sorted((n, s) for s, n in enumerate(lengths)):
        code <<= n - last
        out[s], last = f"{code:0{n}b}", n
        code += 1
    if code > 1 << last:
        raise ValueError("no prefix code has these lengths")
    return out


_DELTA_CODE = Prefixes(_canonical(DELTA_BITS))


@_batched(pa.binary())
def delta_packed(text: pa.Array, start: str = "H", middle: int = 45, base: int = 90, most: int = 20) -> pa.Array:
    """The symbols of ``delta_symbols`` and the end, in a prefix code of the fixed lengths. A string with a step beyond the table stays as it is, marked by 8."""
    moves, _, ends = _moves(text, start)
    beyond = np.concatenate([[0], np.cumsum((moves < -middle) | (moves >= base - middle))])

    def others(some):
        found, at = delta_symbols(some, start, middle, base, most)
        return _DELTA_CODE.packed(np.insert(found, at[1:], middle), at + np.arange(len(at)))

    return _unless(np.diff(beyond[ends]) > 0, text, _kept, others)


@_batched(pa.string())
def delta_unpacked(data: pa.Array, start: str = "H", middle: int = 45, base: int = 90) -> pa.Array:
    def others(some):
        found, ends = _DELTA_CODE.unpacked(some)
        upto = np.concatenate([[0], np.cumsum(np.where(found > base, 0, found - middle))])
        chars = ord(start) + upto[1:] - np.repeat(upto[ends[:-1]], np.diff(ends))
        return _repeated(chars, np.where(found > base, found - base, found != middle), ends)

    return _unmarked(data, others)


def lzw_encode(text: str, letters: str = LETTERS) -> tuple[list[int], int]:
    """(codes, bits): code 0 stops; codes take as many bits as the table's size needs when they are written."""
    table = dict(_FIRST) if letters is LETTERS else {c: i + 1 for i, c in enumerate(letters)}
    codes, bits, match, size = [], 0, "", len(table)
    for c in text:
        longer = match + c
        if longer in table:
            match = longer
            continue
        if c not in table:
            raise ValueError(f"{c!r} is no letter of this codec")
        codes.append(table[match])
        bits += size.bit_length()
        size += 1
        table[longer], match = size, c
    if match:
        codes.append(table[match])
        bits += size.bit_length()
    return [*codes, 0], bits + size.bit_length()


def lzw_decode(codes: list[int], letters: str = LETTERS) -> str:
    table, out, last = ["", *letters], [], ""
    for code in codes:
        if code == 0:
            break
        entry = table[code] if code < len(table) else last + last[0]
        if last:
            table.append(last + entry[0])
        out.append(entry)
        last = entry
    return "".join(out)


def _code_widths(most: int) -> np.ndarray:
    """Bits of a read's codes, from its first: each code but the first follows a new entry, so both sides know the table's size."""
    return np.frexp(len(LETTERS) + np.arange(most))[1].astype(np.int64)


def lzw_codes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(codes, ends): those of ``lzw_encode`` for each string.

    All strings take each letter together, the longest first. A string's entries, by match and letter, are in an open hash table of its own with room for
    twice its letters. The last few strings are coded one by one.
    """
    flat, at = fn.points(text)
    if len(flat) and not 33 <= flat.min() <= flat.max() <= 126:
        raise ValueError("a character that is no letter of this codec")
    letters, sizes = flat.astype(np.int64) - 32, np.diff(at)
    rows = np.argsort(-sizes, kind="stable")
    place, length = at[rows], sizes[rows]
    room = place + rows  # a string has no more codes than letters, and a stop
    codes, ahead, match = np.zeros(len(flat) + len(rows), np.int64), room.copy(), np.zeros(len(rows), np.int64)
    live, step = len(rows), 0
    if live >= FEW:
        slots = 1 << np.frexp(length)[1].astype(np.int64) + 1
        first, masks, number = np.cumsum(slots) - slots, slots - 1, len(LETTERS) + 1 - room
        table = np.zeros(int(slots.sum()), np.int64)  # an entry's key before its number, of 32 bits
    while True:
        while live and length[live - 1] <= step:
            live -= 1
        if live < FEW:
            break
        letter = letters[place[:live] + step]
        step += 1
        if step == 1:
            match[:live] = letter
            continue
        key = (match[:live] << 7) + letter
        begin, mask = first[:live], masks[:live]
        slot = begin + (key * 0x9E3779B1 >> 15 & mask)
        held = table[slot]
        far = np.flatnonzero((held >> 32 != key) & (held != 0))
        while len(far):
            slot[far] = begin[far] + (slot[far] - begin[far] + 1 & mask[far])
            held[far] = table[slot[far]]
            far = far[(held[far] >> 32 != key[far]) & (held[far] != 0)]
        none = held == 0
        new = np.flatnonzero(none)
        to = ahead[new]
        codes[to] = match[new]
        ahead[new] = to + 1
        table[slot[new]] = (key[new] << 32) + number[new] + to
        match[:live] = np.where(none, letter, held & 0xFFFFFFFF)
    for i in range(live):
        found = lzw_encode(text[int(rows[i])].as_py())[0]
        codes[room[i] : room[i] + len(found)], ahead[i] = found, room[i] + len(found)
    rest = live + np.flatnonzero(length[live:])
    codes[ahead[rest]] = match[rest]
    ahead[rest] += 1
    ahead[live:] += 1
    n = np.empty(len(rows), np.int64)
    n[rows] = ahead - room
    return codes[fn.stretch(at[:-1] + np.arange(len(rows)), n)], np.concatenate([[0], np.cumsum(n)])


def lzw_strings(codes: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The string of each row of codes, without stops.

    The entry made behind code t is code t's text and the letter behind it, so each code of an entry copies what the row has said before, from the
    text of code t on. Lengths and letters are followed back to single letters by doubled steps, so rounds go with the logarithm of a row's codes.
    """
    first = np.repeat(ends[:-1], np.diff(ends))
    entry = codes > len(LETTERS)
    made = np.where(entry, first + codes - len(LETTERS) - 1, np.arange(len(codes)))
    if (codes < 1).any() or (made >= np.arange(len(codes)))[entry].any():
        raise ValueError("a code before its entry")
    sizes, back = entry.astype(np.int64), made
    while entry[back].any():
        sizes, back = sizes + sizes[back], back[back]
    upto = np.concatenate([[0], np.cumsum(sizes + 1)])
    parts = []
    for row, n in _cuts(np.diff(upto[ends]), 4 * SOME):
        some, shift = slice(ends[row], ends[row + n]), upto[ends[row]]
        place = fn.stretch(np.where(entry[some], upto[made[some]] - shift, upto[some] - shift), sizes[some] + 1)
        while True:
            further = place[place]
            if (further == place).all():
                break
            place = further
        letters = np.repeat(codes[some], sizes[some] + 1)[place]
        parts.append(fn.text_of(letters + 32, upto[ends[row : row + n + 1]] - shift))
    return pa.concat_arrays([pa.array([], pa.string()), *parts])


def lzw(quals: DataFrame) -> DataFrame:
    """(read_id, codes, bits)."""

    def run(batches):
        for b in batches:
            text = pc.fill_null(b.column("qual"), "")
            for cut in _cuts(pc.binary_length(text).to_numpy(), SOME):
                codes, ends = lzw_codes(text.slice(*cut))
                n = np.diff(ends)
                widths = _code_widths(int(n.max()))
                bits = np.concatenate([[0], np.cumsum(widths)])[n - 1] + widths[np.maximum(n - 2, 0)]  # a stop makes no entry
                yield pa.RecordBatch.from_arrays([b.column("read_id").slice(*cut), fn.lists(codes, ends), pa.array(bits)], names=["read_id", "codes", "bits"])

    return quals.select("read_id", "qual").mapInArrow(run, "read_id long, codes array<int>, bits long")


def lzw_read(coded: DataFrame) -> DataFrame:
    """(read_id, qual) from ``lzw``."""

    def run(batches):
        for b in batches:
            for cut in _cuts(pc.list_value_length(b.column("codes")).to_numpy(), SOME):
                lists = b.column("codes").slice(*cut)
                ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(), dtype=np.int64)])
                codes = lists.flatten().to_numpy().astype(np.int64)
                places, ends = _before(codes == 0, ends)
                yield pa.RecordBatch.from_arrays([b.column("read_id").slice(*cut), lzw_strings(codes[places], ends)], names=["read_id", "qual"])

    return coded.select("read_id", "codes").mapInArrow(run, "read_id long, qual string")


@_batched(pa.binary())
def lzw_packed(text: pa.Array) -> pa.Array:
    """``lzw_codes`` as bytes, each code in the bits that the table's size needs."""
    codes, ends = lzw_codes(text)
    n = np.diff(ends)
    return packed.rows_of(codes, _code_widths(int(n.max()))[fn.stretch(np.zeros(len(n), np.int64), n)], ends)


@_batched(pa.string())
def lzw_unpacked(data: pa.Array) -> pa.Array:
    """The strings of ``lzw_packed``. Widths go with a code's number alone, so all are read at once."""
    w = packed.Windows(data)
    bits = 8 * np.diff(w.starts)
    widths = _code_widths(int(bits.max()) // 7 + 1)
    upto = np.concatenate([[0], np.cumsum(widths)])
    most = np.searchsorted(upto, bits, side="right") - 1
    number = fn.stretch(np.zeros(len(most), np.int64), most)
    codes = w.numbers(np.repeat(8 * w.starts[:-1], most) + upto[number], widths[number])
    places, ends = _before(codes == 0, np.concatenate([[0], np.cumsum(most)]))
    return lzw_strings(codes[places], ends)


naive_encode, naive_decode = _one(naive_packed), _one(naive_unpacked)
bit_run_encode, bit_run_decode = _one(bit_run_packed), _one(bit_run_unpacked)
flagged_encode, flagged_decode = _one(flagged_packed), _one(flagged_unpacked)
huffman_encode, huffman_decode = _one(huffman_packed), _one(huffman_unpacked)
delta_encode, delta_decode = _one(delta_packed), _one(delta_unpacked)
lzw_bytes, lzw_text = _one(lzw_packed), _one(lzw_unpacked)


class Codec(NamedTuple):
    """What every codec of a quality string offers: its bytes, and the string again; the same for arrays of them."""

    encode: Callable[[str], bytes]
    decode: Callable[[bytes], str]
    packed: Callable[[pa.Array], pa.Array]
    unpacked: Callable[[pa.Array], pa.Array]


CODECS = {
    "naive runs": Codec(naive_encode, naive_decode, naive_packed, naive_unpacked),
    "bit runs": Codec(bit_run_encode, bit_run_decode, bit_run_packed, bit_run_unpacked),
    "flagged runs": Codec(flagged_encode, flagged_decode, flagged_packed, flagged_unpacked),
    "huffman": Codec(huffman_encode, huffman_decode, huffman_packed, huffman_unpacked),
    "delta runs": Codec(delta_encode, delta_decode, delta_packed, delta_unpacked),
    "lzw": Codec(lzw_bytes, lzw_text, lzw_packed, lzw_unpacked),
}


def coded(quals: DataFrame, codec: str) -> DataFrame:
    """(read_id, data): each quality string under a codec of ``CODECS``, in its row. Null stays null."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("read_id"), CODECS[codec].packed(b.column("qual"))], names=["read_id", "data"])

    return quals.select("read_id", "qual").mapInArrow(run, "read_id long, data binary")


def read(data: DataFrame, codec: str) -> DataFrame:
    """(read_id, qual) from ``coded``."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("read_id"), CODECS[codec].unpacked(b.column("data"))], names=["read_id", "qual"])

    return data.select("read_id", "data").mapInArrow(run, "read_id long, qual string")


def coded_each(quals: DataFrame) -> DataFrame:
    """(read_id, codec, data): ``coded`` under each of ``CODECS``."""

    def run(batches):
        for b in batches:
            for name, c in CODECS.items():
                yield pa.RecordBatch.from_arrays([b.column("read_id"), pa.repeat(name, b.num_rows), c.packed(b.column("qual"))], names=["read_id", "codec", "data"])

    return quals.select("read_id", "qual").mapInArrow(run, "read_id long, codec string, data binary")


def read_each(data: DataFrame) -> DataFrame:
    """(read_id, codec, qual) from ``coded_each``."""

    def run(batches):
        for b in batches:
            for name in b.column("codec").unique().to_pylist():
                some = b.filter(pc.equal(b.column("codec"), name))
                yield pa.RecordBatch.from_arrays([some.column("read_id"), some.column("codec"), CODECS[name].unpacked(some.column("data"))], names=["read_id", "codec", "qual"])

    return data.select("read_id", "codec", "data").mapInArrow(run, "read_id long, codec string, qual string")


def benchmark(quals: DataFrame) -> DataFrame:
    """(codec, bytes, percent, encode_seconds, decode_seconds) of all ``CODECS``; seconds are the tasks' own, added up."""

    def run(batches):
        for b in batches:
            texts = b.column("qual").filter(pc.greater(pc.binary_length(b.column("qual")), 0))
            plain = pc.sum(pc.utf8_length(texts)).as_py() or 0
            for name, c in CODECS.items():
                t0 = time.perf_counter()
                data = c.packed(texts)
                t1 = time.perf_counter()
                same = c.unpacked(data).equals(texts)
                t2 = time.perf_counter()
                if not same:
                    raise ValueError(f"{name} doesn't give a string back")
                yield pa.RecordBatch.from_pylist([{"codec": name, "plain": plain, "bytes": pc.sum(pc.binary_length(data)).as_py() or 0, "encode": t1 - t0, "decode": t2 - t1}])

    found = quals.select("qual").mapInArrow(run, "codec string, plain long, bytes long, encode double, decode double").groupBy("codec")
    whole = found.agg(F.sum("plain").alias("plain"), F.sum("bytes").alias("bytes"), F.sum("encode").alias("encode_seconds"), F.sum("decode").alias("decode_seconds"))
    return whole.select("codec", "bytes", F.round(F.lit(100.0) * F.col("bytes") / F.col("plain"), 4).alias("percent"), "encode_seconds", "decode_seconds")
