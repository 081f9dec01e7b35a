"""Greedy exact alignment of reads to a reference, and decoding back to reads.

A read is matched from right to left, three bases at a time after the first length % 3. A match
grows while it occurs in the reference; the triple that ends it is kept as a code, and
matching starts anew. Each match gives a tuple: position, length, and the code of the triple in
front (64: none). Runs of N are tuples of their own (code 65), and so are one or two first bases that the reference doesn't hold
(code 66, the bases in place of a position). Of several places, the one whose suffix
sorts last is taken.

The reference is shared with tasks as numpy arrays (six bytes a base), so its size is checked
against ``MOST_BASES`` first; reads of a batch take each step together. The suffix array comes from
a stored index where one is given, and is sorted on the driver otherwise.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bases as fn
from ..shared import before
from .index import FmIndex

NONE, N_RUN, LITERAL = 64, 65, 66
TUPLE = "array<struct<pos: long, len: int, sym: int>>"
_CODE = np.full(256, 4, np.int64)
for _i, _b in enumerate(b"ACGT"):
    _CODE[_b] = _i
#: Bases of the largest reference that is sent to tasks. A larger one is an error before any of it is read.
MOST_BASES = 1 << 28
_SHARED: dict = {}


def _text(ref: DataFrame, most: int) -> str:
    c = F.col(ref.columns[0])
    n, text = ref.select(F.length(c), F.when(F.length(c) <= most, c)).first()
    if (n or 0) > most:
        raise ValueError(f"the reference has {n} bases; at most {most} are sent to tasks")
    return text or ""


def _share(kind: str, key: tuple, make, context):
    """One broadcast of each kind is kept: the last."""
    if _SHARED.get(kind, (None,))[0] != key:
        _SHARED[kind] = key, context.broadcast(make())
    return _SHARED[kind][1]


def _stored(sa: DataFrame, n: int) -> np.ndarray:
    """Positions in the order of rows of a stored (row, pos) table that must have ``n`` rows."""
    found = sa.count()
    if found != n:
        raise ValueError(f"the stored suffix array has {found} rows, its reference {n}")
    rows = sa.select(F.col("row").cast("long").alias("row"), F.col("pos").cast("long").alias("pos")).toArrow()  # as many as bases, which are bounded
    out = np.zeros(n, np.uint32)
    out[rows.column("row").to_numpy()] = rows.column("pos").to_numpy()
    return out


def shared_index(ref: DataFrame, sa: DataFrame | None = None, most: int = MOST_BASES):
    """The index of a one-row reference, broadcast once a session and text. ``sa`` is its stored suffix array."""
    context = ref.sparkSession.sparkContext
    text = _text(ref, most)
    return _share("index", (context.applicationId, text, sa is not None), lambda: FmIndex(text, _stored(sa, len(text) + 1) if sa is not None else None), context)


def shared_text(ref: DataFrame, most: int = MOST_BASES):
    """The text alone, which is all that decoding needs."""
    context = ref.sparkSession.sparkContext
    text = _text(ref, most)
    return _share("text", (context.applicationId, text), lambda: text, context)


def align_segments(index: FmIndex, segments: list[bytes]) -> list[list[tuple[int, int, int]]]:
    """Tuples of each ACGT segment, all segments in step."""
    count = len(segments)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(count)]
    lengths = np.array([len(s) for s in segments], np.int64)
    if not count or not lengths.max(initial=0):
        return out
    grid = np.full((count, int(lengths.max())), 4, np.int64)  # right-aligned codes, last base in column 0
    for i, s in enumerate(segments):
        grid[i, : len(s)] = _CODE[np.frombuffer(s, np.uint8)][::-1]
    low, high = np.zeros(count, np.int64), np.full(count, index.n, np.int64)
    match, at = np.zeros(count, np.int64), np.zeros(count, np.int64)

    def emit(i: int, row: int, length: int, sym: int) -> None:
        out[i].append((int(index.sa[row - 1]), int(length), int(sym)))

    for k in (1, 2):  # the first length % 3 bases
        m = np.flatnonzero(lengths % 3 >= k)
        if len(m):
            lo, hi = index.step(grid[m, k - 1], low[m], high[m])
            low[m], high[m], match[m], at[m] = lo, hi, k, k
    for i in np.flatnonzero(low >= high):  # the reference lacks them: they are spelled out
        r = int(lengths[i] % 3)
        out[i].append((int(grid[i, 0] + (4 * grid[i, 1] if r == 2 else 0)), r, LITERAL))
        low[i], high[i], match[i] = 0, index.n, 0
    for i in np.flatnonzero((lengths > 0) & (lengths < 3) & (match > 0)):
        emit(i, high[i], lengths[i], NONE)
    live = np.flatnonzero(lengths >= 3)
    while len(live):
        c0, c1, c2 = (grid[live, at[live] + j] for j in range(3))  # right to left
        lo, hi = low[live], high[live]
        for c in (c0, c1, c2):
            lo, hi = index.step(c, lo, hi)
        grown = lo < hi
        done = at[live] + 3 >= lengths[live]
        for j in np.flatnonzero(~grown):
            i = live[j]
            emit(i, high[i], match[i], 16 * c2[j] + 4 * c1[j] + c0[j])
        for j in np.flatnonzero(grown & done):
            emit(live[j], hi[j], match[live[j]] + 3, NONE)
        low[live], high[live] = np.where(grown, lo, 0), np.where(grown, hi, index.n)
        match[live] = np.where(grown, match[live] + 3, 0)
        at[live] += 3
        live = live[~done]
    return out


_RUNS = re.compile(rb"[ACGT]+|[^ACGT]+")


def align_reads(index: FmIndex, seqs: list[str]) -> list[list[tuple[int, int, int]]]:
    """Tuples of whole reads, right to left. Runs of other letters than ACGT count as N."""
    parts = [(i, m) for i, s in enumerate(seqs) for m in reversed(_RUNS.findall((s or "").encode()))]
    known = [(i, m) for i, m in parts if m[0] in b"ACGT"]
    found = iter(align_segments(index, [m for _, m in known]))
    out: list[list[tuple[int, int, int]]] = [[] for _ in seqs]
    for i, m in parts:
        out[i] += next(found) if m[0] in b"ACGT" else [(0, len(m), N_RUN)]
    return out


def aligned(reads: DataFrame, ref: DataFrame, seq: str = "seq", sa: DataFrame | None = None) -> DataFrame:
    """(read_id, tuples) of column ``seq``; null reads have none."""
    shared = shared_index(ref, sa)
    kind = pa.list_(pa.struct([("pos", pa.int64()), ("len", pa.int32()), ("sym", pa.int32())]))

    def run(batches):
        for b in batches:
            found = align_reads(shared.value, b.column("s").to_pylist())
            rows = [[{"pos": p, "len": n, "sym": c} for p, n, c in t] for t in found]
            yield pa.RecordBatch.from_arrays([b.column("read_id"), pa.array(rows, kind)], names=["read_id", "tuples"])

    return reads.select("read_id", F.col(seq).alias("s")).mapInArrow(run, f"read_id long, tuples {TUPLE}")


def best_strand(reads: DataFrame, ref: DataFrame, compat: bool = False, sa: DataFrame | None = None) -> DataFrame:
    """(read_id, orn, tuples): the strand with fewer tuples; the other one is tried only where the first has
    over one tuple and the read no N, and must be better to win (orn 1).
    """
    shared = shared_index(ref, sa)
    kind = pa.list_(pa.struct([("pos", pa.int64()), ("len", pa.int32()), ("sym", pa.int32())]))

    def run(batches):
        for b in batches:
            forward = align_reads(shared.value, b.column("s").to_pylist())
            other = b.column("rc").to_pylist()
            tried = [i for i, (t, n) in enumerate(zip(forward, b.column("n").to_pylist())) if len(t) > 1 and not n]
            orn = [0] * len(forward)
            for i, t in zip(tried, align_reads(shared.value, [other[i] for i in tried])):
                if len(t) < len(forward[i]):
                    forward[i], orn[i] = t, 1
            rows = [[{"pos": p, "len": n, "sym": c} for p, n, c in t] for t in forward]
            yield pa.RecordBatch.from_arrays([b.column("read_id"), pa.array(orn, pa.int32()), pa.array(rows, kind)], names=["read_id", "orn", "tuples"])

    both = reads.select("read_id", F.col("seq").alias("s"), fn.revcomp(F.col("seq"), compat).alias("rc"), F.contains("seq", F.lit("N")).alias("n"))
    return both.mapInArrow(run, f"read_id long, orn int, tuples {TUPLE}")


def tuple_rows(alignments: DataFrame) -> DataFrame:
    """(read_id, tuple_no, pos, len, sym), and the other columns but tuples: one row a tuple."""
    rest = [c for c in alignments.columns if c != "tuples"]
    return alignments.select(*rest, F.posexplode("tuples").alias("tuple_no", "t")).select(*rest, "tuple_no", "t.pos", "t.len", "t.sym")


def tuple_columns(alignments: DataFrame) -> DataFrame:
    """(read_id, cnt, orn, tuple_no, pos, len, sym, offset): flattened lists; offset numbers all tuples in read order."""
    counts = alignments.select("read_id", F.size("tuples").alias("cnt"))
    spans = counts.groupBy(F.floor(F.col("read_id") / 4096).alias("part")).agg(F.sum("cnt").alias("n"))
    base = before(spans, "part", "n", "base").select(F.col("part").alias("q"), "base")
    inside = Window.partitionBy("part").orderBy("read_id").rowsBetween(Window.unboundedPreceding, -1)
    local = counts.withColumn("part", F.floor(F.col("read_id") / 4096)).withColumn("a", F.coalesce(F.sum("cnt").over(inside), F.lit(0)))
    offsets = local.join(base, F.col("part") == F.col("q")).select(F.col("read_id").alias("r"), "cnt", (F.col("a") + F.col("base")).alias("first"))
    return tuple_rows(alignments).join(offsets, F.col("read_id") == F.col("r")).select("read_id", "cnt", "orn", "tuple_no", "pos", "len", "sym", (F.col("first") + F.col("tuple_no")).cast("long").alias("offset"))


def decode_tuples(tuples: list[dict], text: str) -> str:
    triples = []
    for t in reversed(tuples):
        if t["sym"] == N_RUN:
            triples.append("N" * t["len"])
        elif t["sym"] == LITERAL:
            triples.append("".join("ACGT"[t["pos"] // 4**k % 4] for k in reversed(range(t["len"]))))
        else:
            c = t["sym"]
            head = "" if c == NONE else "ACGT"[c // 16] + "ACGT"[c // 4 % 4] + "ACGT"[c % 4]
            triples.append(head + text[t["pos"] : t["pos"] + t["len"]])
    return "".join(triples)


def decoded(alignments: DataFrame, ref: DataFrame, compat: bool = False) -> DataFrame:
    """(read_id, seq) from (read_id, orn, tuples)."""
    shared = shared_text(ref)

    def run(batches):
        for b in batches:
            text = shared.value
            yield pa.RecordBatch.from_arrays([b.column("read_id"), b.column("orn"), pa.array([decode_tuples(t, text) for t in b.column("tuples").to_pylist()])], names=["read_id", "orn", "seq"])

    plain = alignments.select("read_id", "orn", "tuples").mapInArrow(run, "read_id long, orn int, seq string")
    return plain.select("read_id", F.when(F.col("orn") == 1, fn.revcomp(F.col("seq"), compat)).otherwise(F.col("seq")).alias("seq"))
