"""Quality strings: run-length symbols, frequency models, entropy, sizes and the arithmetic coder.

A run of equal characters gives its first character as a symbol (character - 33), then its
repeats in stretches of up to 60 as symbols 128 to 187. Runs end with the read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import runs as fn
from ..shared import before

OFFSET, ALPHABET, STRETCH, SYMBOLS = 33, 128, 60, 189


def runs(quals: DataFrame, column: str = "qual") -> DataFrame:
    """(read_id, run, char, n): runs of equal characters in order. Stays inside the row: no shuffle."""
    found = F.regexp_extract_all(F.col(column), F.lit(r"(?s)((.)\2*)"), F.lit(1))
    return quals.select("read_id", F.posexplode(found).alias("run", "s")).select("read_id", "run", F.substr("s", F.lit(1), F.lit(1)).alias("char"), F.length("s").cast("long").alias("n"))


def symbol_lists(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of a batch of quality strings; row i has those between entries i and i + 1 of the second array."""
    chars, n, ends = fn.runs(text)
    return fn.stretched(chars - OFFSET, np.ones(len(chars), bool), n - 1, ALPHABET - 1, STRETCH, ends)


def symbols(quals: DataFrame) -> DataFrame:
    """(read_id, ord, symbol): the symbols of each read in order."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("read_id"), fn.lists(*symbol_lists(b.column("qual")))], names=["read_id", "p"])

    listed = quals.select("read_id", "qual").mapInArrow(run, f"read_id {quals.schema['read_id'].dataType.simpleString()}, p array<int>")
    return listed.select("read_id", F.posexplode("p").alias("ord", "symbol"))


def unsymbol(codes: DataFrame) -> DataFrame:
    """(read_id, qual) from (read_id, ord, symbol)."""
    parts = F.array_sort(F.collect_list(F.struct("ord", "symbol")))
    one = codes.groupBy("read_id").agg(parts.alias("p"))
    step = F.aggregate("p", F.struct(F.lit("").alias("out"), F.lit("").alias("last")), lambda a, p: F.when(p["symbol"] < ALPHABET, F.struct(F.concat(a["out"], F.chr(p["symbol"] + OFFSET)).alias("out"), F.chr(p["symbol"] + OFFSET).alias("last"))).otherwise(F.struct(F.concat(a["out"], F.repeat(a["last"], p["symbol"] - ALPHABET + 1)).alias("out"), a["last"].alias("last"))))
    return one.select("read_id", step["out"].alias("qual"))


def run_histogram(quals: DataFrame) -> DataFrame:
    return runs(quals).groupBy(F.col("n").alias("length")).agg(F.count(F.lit(1)).alias("runs"))


def char_histogram(quals: DataFrame) -> DataFrame:
    """(char, n), from runs instead of single characters."""
    return runs(quals).groupBy("char").agg(F.sum("n").cast("long").alias("n"))


def cumulative(codes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, symbol, freq, cum_lo, cum_hi) for all 189 symbols: cum_lo counts the smaller ones."""
    return _cumulative(codes.groupBy(*keys, "symbol").agg(F.count(F.lit(1)).alias("freq")), keys)


def model(quals: DataFrame) -> DataFrame:
    """``cumulative`` of all ``symbols``, which are counted in their batches: a batch gives at most 189 rows."""

    def run(batches):
        for b in batches:
            found, n = np.unique(symbol_lists(b.column("qual"))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(n, pa.int64())], names=["symbol", "n"])

    each = quals.select("qual").mapInArrow(run, "symbol int, n long")
    return _cumulative(each.groupBy("symbol").agg(F.sum("n").alias("freq")))


def _cumulative(counts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    groups = counts.select(*keys).distinct() if keys else counts.sparkSession.range(1).select()
    every = groups.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(SYMBOLS - 1))).alias("symbol"))
    full = every.join(counts, [*keys, "symbol"], "left").withColumn("freq", F.coalesce("freq", F.lit(0)).cast("long"))
    up = F.sum("freq").over((Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("symbol"))  # 189 rows a model
    return full.select(*keys, "symbol", "freq", (up - F.col("freq")).cast("long").alias("cum_lo"), up.cast("long").alias("cum_hi"))


def entropy(codes: DataFrame) -> DataFrame:
    """(n_symbols, distinct, bits_per_symbol): order-0 entropy."""
    counts = codes.groupBy("symbol").agg(F.count(F.lit(1)).alias("c"))
    whole = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("distinct"), F.sum(F.col("c") * F.log2(F.col("c").cast("double"))).alias("s"))
    return whole.select(F.col("n").cast("long").alias("n_symbols"), "distinct", F.round(F.log2(F.col("n").cast("double")) - F.col("s") / F.col("n"), 6).alias("bits_per_symbol"))


def interval_lookup(scaled: DataFrame, model: DataFrame) -> DataFrame:
    """(scaled, symbol): the symbol whose interval holds each value. A model has 189 rows, so it is one sorted array."""
    table = model.where("freq > 0").agg(F.array_sort(F.collect_list(F.struct("cum_lo", "cum_hi", "symbol"))).alias("m"))
    hit = F.element_at(F.filter("m", lambda x: (x["cum_lo"] <= F.col("scaled")) & (F.col("scaled") < x["cum_hi"])), 1)
    return scaled.join(F.broadcast(table)).select("scaled", hit["symbol"].alias("symbol"))


def batch_totals(quals: DataFrame, batch_rows: int) -> DataFrame:
    """(batch, reads, scores, total_reads): running totals over batches of consecutive reads."""
    per = quals.groupBy(F.floor(F.col("read_id") / batch_rows).cast("long").alias("batch")).agg(F.count(F.lit(1)).alias("reads"), F.sum(F.length("qual")).cast("long").alias("scores"))
    return before(per, "batch", "reads", "ahead").select("batch", "reads", "scores", (F.col("ahead") + F.col("reads")).alias("total_reads"))


def refreeze(quals: DataFrame, batch_rows: int, threshold: int = 40, compat: bool = False) -> DataFrame:
    """(batch, cost, reuse): whether a batch keeps the model of batch 0.

    ``cost`` is ten times the bits a score under that model, with each frequency raised by one so
    that no symbol is impossible. The model stays while cost is at most ``threshold``;
    ``compat`` turns the test round, as older encoders do.
    """
    codes = symbols(quals).withColumn("batch", F.floor(F.col("read_id") / batch_rows).cast("long"))
    counts = codes.groupBy("batch", "symbol").agg(F.count(F.lit(1)).alias("c"))
    frozen = cumulative(codes.where("batch = 0")).select(F.col("symbol").alias("s"), (F.col("freq") + 1).alias("f"))
    total = frozen.agg(F.sum("f").alias("t"))
    bits = counts.join(F.broadcast(frozen), F.col("symbol") == F.col("s")).join(F.broadcast(total))  # 189 rows and one
    spent = bits.groupBy("batch").agg(F.sum(F.col("c") * (F.log2(F.col("t").cast("double")) - F.log2(F.col("f").cast("double")))).alias("b"))
    scores = quals.groupBy(F.floor(F.col("read_id") / batch_rows).cast("long").alias("q")).agg(F.sum(F.length("qual")).alias("n"))
    cost = F.floor(F.round(F.col("b"), 3) * 10 / F.col("n")).cast("long")
    keeps = cost > threshold if compat else cost <= threshold
    return spent.join(scores, F.col("batch") == F.col("q")).select("batch", cost.alias("cost"), keeps.alias("reuse"))


# The arithmetic coder: 32-bit order-0 ranges with a fixed model.
TOP, HALF, QUARTER = (1 << 32) - 1, 1 << 31, 1 << 30
END = SYMBOLS - 1
#: Reads that are coded in step.
LANES = 1024


class Fixed:
    """One table of cumulative counts for all lanes."""

    def __init__(self, cum: list[int]):
        self.cum, self.total = np.array(cum, np.int64), int(cum[-1])

    def bounds(self, lanes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        return self.cum[codes], self.cum[codes + 1], self.total

    def find(self, lanes: np.ndarray, span: np.ndarray, offset: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cum, ((offset + 1) * self.total - 1) // span, side="right") - 1

    def seen(self, lanes: np.ndarray, codes: np.ndarray) -> None:
        """Nothing changes."""


def _length(x: np.ndarray) -> np.ndarray:
    """Bits of each number."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def _settled(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How many first bits of both bounds agree, how many behind them wait (01.. beneath 10..), and the bounds without these."""
    sure = 32 - _length(low ^ high)
    low, high = (low << sure) & TOP, ((high << sure) & TOP) | ((1 << sure) - 1)
    waits = 31 - _length(~(low & ~high) & (HALF - 1))
    return sure, waits, (low << waits) & (HALF - 1), ((high << waits) & (HALF - 1)) | ((1 << waits) - 1) | HALF


def encode_lanes(rows: list[np.ndarray], model, end: int = END) -> list[bytes]:
    """Each row of symbols, and an end symbol, as bytes of its own. All rows take each step together: a lane a row, with bounds and waiting bits
    of its own.
    """
    count = len(rows)
    if not count:
        return []
    sizes = np.fromiter(map(len, rows), np.int64, count) + 1
    grid = np.full((count, int(sizes.max())), end, np.int64)
    grid[np.arange(grid.shape[1]) < (sizes - 1)[:, None]] = np.concatenate([np.asarray(r, np.int64) for r in rows])
    low, high, waiting = np.zeros(count, np.int64), np.full(count, TOP, np.int64), np.zeros(count, np.int64)
    said = []  # lane, settled bits, their number, and how many opposites of the first come behind it
    live = np.arange(count)
    for k in range(grid.shape[1]):
        live = live[sizes[live] > k]
        codes = grid[live, k]
        lower, upper, total = model.bounds(live, codes)
        a, span = low[live], high[live] - low[live] + 1
        a, b = a + span * lower // total, a + span * upper // total - 1
        model.seen(live, codes)
        sure, waits, low[live], high[live] = _settled(a, b)
        out = np.flatnonzero(sure)
        lanes = live[out]
        said.append((lanes, a[out] >> (32 - sure[out]), sure[out], waiting[lanes]))
        waiting[lanes] = 0
        waiting[live] += waits
    said.append((np.arange(count), (low >= QUARTER).astype(np.int64), np.ones(count, np.int64), waiting + 1))
    lane, value, sure, more = (np.concatenate(x) for x in zip(*said))
    order = np.argsort(lane, kind="stable")
    lane, value, sure, more = lane[order], value[order], sure[order], more[order]
    width = sure + more
    lengths = np.bincount(lane, width, count).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum((lengths + 7) // 8)])  # in bytes
    before_lane = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    each = np.repeat(np.arange(len(lane)), width)
    j = np.arange(len(each)) - np.repeat(np.cumsum(width) - width, width)  # place in an event: its first bit, opposites, other bits
    first, more, sure, value = value >> (sure - 1), more[each], sure[each], value[each]
    bit = np.where(j == 0, first[each], np.where(j <= more, 1 - first[each], (value >> np.maximum(sure - 1 - (j - more), 0)) & 1))
    bits = np.zeros(8 * starts[-1], np.uint8)
    bits[np.arange(len(each)) - before_lane[lane[each]] + 8 * starts[lane[each]]] = bit
    data = np.packbits(bits).tobytes()
    return [data[x:y] for x, y in zip(starts.tolist(), starts[1:].tolist())]


def _fetched(raw: np.ndarray, lanes: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The next ``n`` bits (31 at most) of each lane from bit ``at``; zeros behind the end."""
    byte = np.minimum(at >> 3, raw.shape[1] - 8)
    window = np.zeros(len(lanes), np.int64)
    for i in range(5):  # 7 + 31 bits at most
        window = window << 8 | raw[lanes, byte + i]
    return (window >> (40 - (at & 7) - n)) & ((1 << n) - 1)


def decode_lanes(rows: list[bytes], model, end: int = END) -> list[list[int]]:
    """The symbols of each row before its end symbol."""
    flat, ends = decode_flat(rows, model, end)
    return [x.tolist() for x in np.split(flat, ends[1:-1])] if rows else []


def decode_flat(rows: list[bytes], model, end: int = END) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of each row before its end symbol, all rows in step; row i has those between entries i and i + 1 of the second array."""
    count = len(rows)
    if not count:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    sizes = np.fromiter(map(len, rows), np.int64, count)
    raw = np.zeros((count, int(sizes.max()) + 16), np.uint8)
    raw[np.arange(raw.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(rows), np.uint8)
    low, high, at = np.zeros(count, np.int64), np.full(count, TOP, np.int64), np.full(count, 32)
    value = raw[:, :4].astype(np.int64) @ np.array([1 << 24, 1 << 16, 1 << 8, 1])
    live, who, what = np.arange(count), [], []
    while len(live):
        a, span = low[live], high[live] - low[live] + 1
        codes = model.find(live, span, value[live] - a)
        lower, upper, total = model.bounds(live, codes)
        model.seen(live, codes)
        sure, waits, low[live], high[live] = _settled(a + span * lower // total, a + span * upper // total - 1)
        now = ((value[live] << sure) & TOP) | _fetched(raw, live, at[live], sure)
        at[live] += sure
        value[live] = (now & HALF) | ((now << waits) & (HALF - 1)) | _fetched(raw, live, at[live], waits)
        at[live] += waits
        if (at[live] > 8 * sizes[live] + 64).any():
            raise ValueError("a row without an end")
        on = codes != end
        live = live[on]
        who.append(live)
        what.append(codes[on])
    lane = np.concatenate(who)
    return np.concatenate(what)[np.argsort(lane, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(lane, minlength=count))])


def _text(codes: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The strings of rows of symbols. Ends of reads among the symbols give no letter."""
    letter = codes < ALPHABET
    last = np.maximum.accumulate(np.where(letter, np.arange(len(codes)), 0))
    times = np.where(letter, 1, np.where(codes == END, 0, codes - ALPHABET + 1))
    return fn.text_of(np.repeat(codes[last] + OFFSET, times), np.concatenate([[0], np.cumsum(times)])[ends])


class Adaptive:
    """Counts of each lane that start at one and grow with what the lane codes: coder and decoder change them alike.

    Symbols stand in groups of 16. A lane keeps the sums before its groups and, in each group, those before its symbols, so a symbol is found or
    counted by one look at the groups and one into a group. A count grows by ``step``; where a lane's sum passes ``most``, its counts are halved.
    """

    GROUP = 16

    def __init__(self, lanes: int, symbols: int = SYMBOLS, step: int = 32, most: int = 1 << 16):
        self.groups = -(-symbols // self.GROUP)
        self.symbols, self.step, self.most = symbols, step, most
        self.counts = np.zeros((lanes, self.groups * self.GROUP), np.int64)
        self.counts[:, :symbols] = 1
        self.total = np.full(lanes, symbols, np.int64)
        self.outer = np.zeros((lanes, self.groups), np.int64)
        self.inner = np.zeros((lanes * self.groups, self.GROUP), np.int64)
        self._sum(np.arange(lanes))
        self._from = np.arange(max(self.groups, self.GROUP))

    def _sum(self, lanes: np.ndarray) -> None:
        """Sums before groups and symbols, from counts."""
        held = self.counts[lanes].reshape(len(lanes), self.groups, self.GROUP)
        whole = held.sum(axis=2)
        self.outer[lanes] = np.cumsum(whole, axis=1) - whole
        self.inner[(lanes[:, None] * self.groups + np.arange(self.groups)).ravel()] = (np.cumsum(held, axis=2) - held).reshape(-1, self.GROUP)

    def bounds(self, lanes: np.ndarray, codes: np.ndarray):
        group = codes // self.GROUP
        lower = self.outer[lanes, group] + self.inner[lanes * self.groups + group, codes % self.GROUP]
        return lower, lower + self.counts[lanes, codes], self.total[lanes]

    def find(self, lanes: np.ndarray, span: np.ndarray, offset: np.ndarray) -> np.ndarray:
        """The symbol of each lane's target: the last one whose sum before it isn't above."""
        left = ((offset + 1) * self.total[lanes] - 1) // span
        group = (self.outer[lanes] <= left[:, None]).sum(axis=1) - 1
        left = left - self.outer[lanes, group]
        at = group * self.GROUP + (self.inner[lanes * self.groups + group] <= left[:, None]).sum(axis=1) - 1
        return np.minimum(at, self.symbols - 1)

    def seen(self, lanes: np.ndarray, codes: np.ndarray) -> None:
        group, place = codes // self.GROUP, codes % self.GROUP
        self.counts[lanes, codes] += self.step
        self.total[lanes] += self.step
        self.outer[lanes] += self.step * (self._from[: self.groups] > group[:, None])
        self.inner[lanes * self.groups + group] += self.step * (self._from[: self.GROUP] > place[:, None])
        if (full := lanes[self.total[lanes] > self.most]).size:
            self.counts[full] = (self.counts[full] + 1) >> 1
            self.total[full] = self.counts[full].sum(axis=1)
            self._sum(full)


def arithmetic_encode(codes: list[int], cum: list[int]) -> bytes:
    """``codes`` then an end symbol under cumulative counts ``cum`` (189 + 1 entries, all rising)."""
    return encode_lanes([np.asarray(codes, np.int64)], Fixed(cum))[0]


def arithmetic_decode(data: bytes, cum: list[int]) -> list[int]:
    """The symbols before the end symbol."""
    return decode_lanes([data], Fixed(cum))[0]


#: The largest sum of frequencies a coder takes; ranges never get smaller than 2**30, so each symbol keeps a part of them.
MOST = 1 << 28


def smoothed(model: DataFrame, most: int = MOST) -> list[int]:
    """190 rising cumulative counts of a model, each frequency raised by one. Larger sums than ``most`` are scaled down to it."""
    freq = [r.freq + 1 for r in model.orderBy("symbol").collect()]  # 189 rows
    total = sum(freq)
    if total > most:
        freq = [max(1, f * (most - len(freq)) // total) for f in freq]
    cum = [0]
    for f in freq:
        cum.append(cum[-1] + f)
    return cum


def arithmetic_code(quals: DataFrame, cum: list[int] | None = None) -> DataFrame:
    """(read_id, data): each read's symbols, arithmetic-coded; null and empty qualities have no row. A read is a unit, so any
    task can decode it, and its symbols never leave its row.
    """
    table = cum or smoothed(model(quals))
    listed = quals.where(F.length("qual") > 0).select("read_id", "qual")

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, LANES):
                part = b.slice(at, LANES)
                flat, ends = symbol_lists(part.column("qual"))
                coded = encode_lanes(np.split(flat, ends[1:-1]), Fixed(table))
                yield pa.RecordBatch.from_arrays([part.column("read_id"), pa.array(coded, pa.binary())], names=["read_id", "data"])

    return listed.mapInArrow(run, "read_id long, data binary")


def arithmetic_read(coded: DataFrame, cum: list[int]) -> DataFrame:
    """(read_id, qual) from ``arithmetic_code``."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, LANES):
                part = b.slice(at, LANES)
                found, ends = decode_flat(part.column("data").to_pylist(), Fixed(cum))
                yield pa.RecordBatch.from_arrays([part.column("read_id"), _text(found, ends)], names=["read_id", "qual"])

    return coded.mapInArrow(run, "read_id long, qual string")


def adaptive_code(quals: DataFrame, rows_per_part: int = 64, parts_per_lane_set: int = 256) -> DataFrame:
    """(part, entries, ids, data): reads of ``rows_per_part`` numbers coded in one piece by counts that follow what was coded.

    Nothing is counted before, and no model is stored. Reads of a part end by a symbol each; parts decode on their own. Null and
    empty qualities have no entry.
    """
    part = F.floor(F.col("read_id") / rows_per_part).cast("long")
    listed = quals.where(F.length("qual") > 0).select("read_id", part.alias("part"), "qual")
    whole = listed.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("read_id", "qual"))).alias("r"))  # at most rows_per_part reads
    stop = SYMBOLS  # the end of the part, behind the ends of its reads
    held = whole.select("part", F.col("r.read_id").alias("ids"), F.col("r.qual").alias("quals"))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, parts_per_lane_set):
                some = b.slice(at, parts_per_lane_set)
                lists = some.column("quals")
                flat, ends = symbol_lists(lists.flatten())
                flat, ends = np.insert(flat, ends[1:], END), ends + np.arange(len(ends))
                sizes = np.diff(lists.offsets.to_numpy())
                rows = np.split(flat, ends[np.cumsum(sizes)][:-1])
                data = encode_lanes(rows, Adaptive(len(rows), SYMBOLS + 1), stop)
                yield pa.RecordBatch.from_arrays([some.column("part"), pa.array(sizes.astype(np.int64)), some.column("ids"), pa.array(data, pa.binary())], names=["part", "entries", "ids", "data"])

    return held.mapInArrow(run, "part long, entries long, ids array<long>, data binary")


def adaptive_read(coded: DataFrame, parts_per_lane_set: int = 256) -> DataFrame:
    """(read_id, qual) from ``adaptive_code``."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, parts_per_lane_set):
                some = b.slice(at, parts_per_lane_set)
                codes, _ = decode_flat(some.column("data").to_pylist(), Adaptive(some.num_rows, SYMBOLS + 1), SYMBOLS)
                ends = np.concatenate([[0], np.flatnonzero(codes == END) + 1])  # a read each, in the order of parts
                yield pa.RecordBatch.from_arrays([some.column("ids").flatten(), _text(codes, ends)], names=["read_id", "qual"])

    return coded.mapInArrow(run, "read_id long, qual string")
