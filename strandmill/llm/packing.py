"""Packing documents into fixed windows by non-negative least squares on the length histogram.

A document's ids fill whole windows from its start; what remains (less than a
window) is a piece to be packed. Piece lengths fall into classes of ``width`` ids.
All combinations of two or three classes that fill a window are the columns of a
non-negative least-squares problem whose right side is the histogram; its solution,
rounded within the counts, says how often each combination is used. Pieces
that no combination takes are packed greedily: longest first, end to end, cut where
a window ends. So only the classes' rounding and the last sequence leave padding.

The histogram has ``window / width`` rows and the plan a bounded number of slots,
whatever the input; pieces get their slot from their rank within their class,
which is computed without bringing a class together.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import PART_ROWS, arrow_batches, materialize, ranked
from .tokens import default_path, encoder, with_end


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-9, most: int = 30) -> np.ndarray:
    """Lawson-Hanson active-set solution of min |a x - b|, x >= 0. It ends where the optimality conditions hold; ``most`` steps
    a row or column without reaching that are an error.
    """
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    gradient = a.T @ b
    limit = tolerance * max(1.0, np.abs(gradient).max(initial=0.0))
    for _ in range(most * max(a.shape)):
        free = np.where(active, -np.inf, gradient)
        j = int(np.argmax(free)) if n else 0
        if not n or free[j] <= limit:
            return x
        active[j] = True
        while True:
            on = np.flatnonzero(active)
            s = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            if s.min(initial=1.0) > 0:
                break
            low = s <= 0
            step = np.min(x[on][low] / np.maximum(x[on][low] - s[low], 1e-300))
            x[on] += step * (s - x[on])
            active[on[x[on] <= 1e-12]] = False
            x[~active] = 0
            if not active.any():
                break
        x[:] = 0
        on = np.flatnonzero(active)
        if len(on):
            x[on] = s
        gradient = a.T @ (b - a @ x)
    raise ValueError(f"non-negative least squares of {a.shape} didn't reach its optimum in {most * max(a.shape)} steps")


def combinations_filling(classes: int) -> np.ndarray:
    """Rows (i, j, k) of class numbers adding up to ``classes``; i >= j >= k, k = 0 where two are enough."""
    found = []
    for i in range(1, classes):
        for j in range(1, min(i, classes - i) + 1):
            k = classes - i - j
            if k <= j:
                found.append((i, j, k))
    return np.array(found, np.int64).reshape(-1, 3)


def plan(histogram: dict[int, int], classes: int) -> tuple[list[tuple[int, int, int, int, int, int]], int, dict[int, int]]:
    """Slots (class, from rank, to rank, first sequence, pieces a sequence, first slot), sequences, and pieces taken by class."""
    counts = np.zeros(classes + 1)
    for c, n in histogram.items():
        counts[c] = n
    combos = combinations_filling(classes)
    usable = [r for r in combos if all(counts[c] > 0 for c in r if c)]
    combos = np.array(usable, np.int64).reshape(-1, 3)
    matrix = np.zeros((classes + 1, len(combos)))
    for p, row in enumerate(combos):
        for c in row[row > 0]:
            matrix[c, p] += 1
    counts[0] = 0
    scale = max(1.0, counts.max())
    times = nnls(matrix, counts / scale) * scale
    left, taken, slots, sequences = counts.astype(np.int64), {}, [], 0
    for p in np.lexsort((np.arange(len(times)), -times)):
        used, multiple = np.unique(combos[p][combos[p] > 0], return_counts=True)
        n = min(int(times[p] + 0.5), *(int(left[c] // m) for c, m in zip(used, multiple)))
        if n <= 0:
            continue
        slot = 0
        for c, m in sorted(zip(used.tolist(), multiple.tolist()), reverse=True):
            at = taken.get(c, 0)
            slots.append((c, at, at + n * m, sequences, m, slot))
            taken[c] = at + n * m
            left[c] -= n * m
            slot += m
        sequences += n
    return slots, sequences, taken


def tokenized(docs: DataFrame, path: str, end_id: int, window: int) -> DataFrame:
    """One row a document: key, doc_id, n_tokens, how many whole windows its part holds before it, CRCs of its pieces, its ids.

    ``key`` is unique: part number and row of the part. Null texts are empty. Ids are
    little-endian unsigned integers of 16 bits where the vocabulary allows, else 32.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["key", "doc_id", "n_tokens", "part", "windows_before", "crcs", "ids"]
    size = 4 * window

    def run(batches):
        enc, part, row, before = encoder(path), TaskContext.get().partitionId(), 0, 0
        kind = "<u2" if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        for batch in arrow_batches(batches, 256, "text", 2 << 20):
            flat, n = with_end(*enc.batch(batch.column("text").to_pylist()), end_id)
            raw, stored = memoryview(flat).cast("B"), flat.astype(kind)
            crcs, kept, at = [], [], 0
            for m in n.tolist():
                crcs.append([zlib.crc32(raw[a : min(a + size, 4 * (at + m))]) for a in range(4 * at, 4 * (at + m), size)])
                kept.append(stored[at : at + m].tobytes())
                at += m
            wholes = np.cumsum(n // window)
            base = before + wholes - n // window
            before += int(wholes[-1])
            rows = len(n)
            keys = np.arange(row, row + rows, dtype=np.int64) + (part << 36)
            row += rows
            columns = [pa.array(keys), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(np.full(rows, part, np.int32)), pa.array(base, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, f"key long, doc_id {kind}, n_tokens long, part int, windows_before long, crcs array<long>, ids binary")


def _crc_of(pieces: DataFrame, wide: bool) -> DataFrame:
    """Adds ids_crc32 of ids[start, start + length) to rows that carry ``ids``, and drops ``ids``."""
    kept = [f for f in pieces.schema.fields if f.name != "ids"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", ids_crc32 long"

    def run(batches):
        for batch in batches:
            crc = []
            for raw, start, length in zip(batch.column("ids").to_pylist(), batch.column("start").to_pylist(), batch.column("length").to_pylist()):
                ids = np.frombuffer(raw, "<u4" if wide else "<u2")
                crc.append(zlib.crc32(ids[start : start + length].astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(crc, pa.int64())], names=[*(f.name for f in kept), "ids_crc32"])

    return pieces.mapInArrow(run, schema)


def pack(docs: DataFrame, path: str | None = None, end_id: int = 1, window: int = 2048, width: int = 8) -> tuple[DataFrame, DataFrame]:
    """(pieces, tokens): where each piece of each row of ``docs`` lies, and the stored ids by ``key``.

    Pieces: key, doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    Every id of every document, its end id included, lies in one piece. Null and
    empty texts are documents of one id; repeated rows and null ids are packed like others.
    """
    path = path or default_path()
    if window % width:
        raise ValueError("width must divide window")
    classes = window // width
    tokens = materialize(tokenized(docs, path, end_id, window), "tokens")
    narrow = tokens.select("key", "doc_id", "n_tokens", "part", "windows_before", "crcs")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    parts = narrow.groupBy("part").agg(F.sum(F.expr(f"n_tokens div {window}")).alias("n")).select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    whole = narrow.where(F.col("n_tokens") >= window).join(parts, F.col("part") == F.col("_part"))
    whole = whole.select("key", "doc_id", "n_tokens", "crcs", (F.col("base") + F.col("windows_before")).alias("base"), F.posexplode(F.sequence(F.lit(0), (F.col("n_tokens") / window).cast("long") - 1)).alias("i", "w"))
    whole = whole.select("key", "doc_id", (F.col("i") * F.lit(window).cast("long")).alias("start"), F.lit(window).cast("long").alias("length"), F.element_at("crcs", F.col("i") + 1).alias("ids_crc32"), F.col("n_tokens").alias("doc_tokens"), (F.col("base") + F.col("i")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    length = F.col("n_tokens") % window
    tails = narrow.where(length > 0).select("key", "doc_id", "n_tokens", length.alias("length"), F.element_at("crcs", -1).alias("crc"), F.expr(f"((n_tokens % {window}) + {width - 1}) div {width}").cast("int").alias("class"))
    spark = docs.sparkSession
    wholes = narrow.agg(F.coalesce(F.sum(F.expr(f"n_tokens div {window}")), F.lit(0))).first()[0]
    histogram = {r[0]: r[1] for r in tails.groupBy("class").count().collect()}  # at most `classes` rows
    slots, sequences, taken = plan(histogram, classes)
    table = spark.createDataFrame([(c, -(-n // PART_ROWS)) for c, n in histogram.items()], "of int, parts long")
    dealt = tails.join(F.broadcast(table), F.col("class") == F.col("of")).drop("of")  # at most `classes` rows
    placed = materialize(ranked(dealt, ["class"], [F.xxhash64("key"), F.col("key")], F.col("parts")).drop("parts"), "ranks")

    table = spark.createDataFrame(slots, "slot_class int, low long, high long, first long, each int, slot int")
    used = spark.createDataFrame(sorted(taken.items()) or [(0, 0)], "taken_class int, taken long")
    fits = placed.join(F.broadcast(table), (F.col("class") == F.col("slot_class")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))  # slots: bounded by the number of classes
    fits = fits.withColumn("sequence_id", F.lit(wholes) + F.col("first") + F.expr("(rank - low) div each")).withColumn("place", F.expr("slot + (rank - low) % each"))
    ahead = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    fits = fits.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("long"))
    start = (F.col("n_tokens") - F.col("length")).alias("start")
    fits = fits.select("key", "doc_id", start, "length", F.col("crc").alias("ids_crc32"), F.col("n_tokens").alias("doc_tokens"), F.col("sequence_id").cast("long"), "offset")

    rest = placed.join(F.broadcast(used), F.col("class") == F.col("taken_class"), "left").where("rank >= coalesce(taken, 0)")
    rest = materialize(stream(rest, window), "stream")
    first = wholes + sequences
    at = F.expr(f"position % {window}")
    room = F.lit(window) - at
    uncut = rest.where(F.col("length") <= room).select("key", "doc_id", start, "length", F.col("crc").alias("ids_crc32"), F.col("n_tokens").alias("doc_tokens"), (F.lit(first) + F.expr(f"position div {window}")).cast("long").alias("sequence_id"), at.cast("long").alias("offset"))
    halves = F.array(F.struct(F.lit(0).cast("long").alias("skip"), room.cast("long").alias("n")), F.struct(room.cast("long").alias("skip"), (F.col("length") - room).cast("long").alias("n")))
    cut = rest.where(F.col("length") > room).select("key", "doc_id", "n_tokens", "length", "position", F.explode(halves).alias("h"))
    cut = cut.select(F.col("key").alias("_key"), (F.col("n_tokens") - F.col("length") + F.col("h.skip")).alias("start"), F.col("h.n").alias("length"), F.col("n_tokens").alias("doc_tokens"), (F.lit(first) + F.expr(f"(position + h.skip) div {window}")).cast("long").alias("sequence_id"), F.expr(f"(position + h.skip) % {window}").cast("long").alias("offset"))
    wide = encoder_is_wide(path, end_id)
    cut = _crc_of(tokens.select("key", "doc_id", "ids").join(cut, F.col("key") == F.col("_key")).drop("_key"), wide)
    columns = ["key", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    pieces = whole.select(columns)
    for more in (fits, uncut, cut):
        pieces = pieces.unionByName(more.select(columns))
    return pieces, tokens


def encoder_is_wide(path: str, end_id: int) -> bool:
    return max(encoder(path).tokenizer.get_vocab_size(), end_id + 1) > 1 << 16


def stream(rest: DataFrame, window: int, rows_per_part: int = PART_ROWS) -> DataFrame:
    """Adds ``position``: ids of all pieces before this one, longest class first, by rank.

    Sums run within parts of a class, over the parts of a group of parts, and over the groups, so the one window that isn't
    partitioned has a row for ``rows_per_part ** 2`` pieces.
    """
    dealt = rest.withColumn("_part", F.expr(f"rank div {rows_per_part}"))
    sums = dealt.groupBy("class", "_part").agg(F.sum("length").alias("n")).withColumn("_group", F.expr(f"_part div {rows_per_part}"))
    groups = sums.groupBy("class", "_group").agg(F.sum("n").alias("n"))
    before = Window.orderBy(F.col("class").desc(), "_group").rowsBetween(Window.unboundedPreceding, -1)
    tops = groups.select(F.col("class").alias("_gc"), F.col("_group").alias("_g"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_top"))
    inside = Window.partitionBy("class", "_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.withColumn("_base", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(tops, (F.col("class") == F.col("_gc")) & (F.col("_group") == F.col("_g")))
    bases = bases.select(F.col("class").alias("_c"), F.col("_part").alias("_p"), (F.col("_base") + F.col("_top")).alias("_base"))
    within = Window.partitionBy("class", "_part").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("_local", F.coalesce(F.sum("length").over(within), F.lit(0)))
    return local.join(bases, (F.col("class") == F.col("_c")) & (F.col("_part") == F.col("_p"))).select("key", "doc_id", "n_tokens", "length", "crc", (F.col("_base") + F.col("_local")).cast("long").alias("position"))


def numbered(pieces: DataFrame, tokens: DataFrame) -> DataFrame:
    """``pieces`` with ``copy`` in place of ``key``: 0, 1, ... for the rows of ``tokens`` that share a doc_id."""
    rows = tokens.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
    many = rows.groupBy("_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumnRenamed("_id", "_of")
    shared = rows.join(many, F.col("_id").eqNullSafe(F.col("_of"))).drop("_of")
    copies = ranked(shared, ["_id"], [F.xxhash64("_key"), F.col("_key")], F.ceil(F.col("n") / PART_ROWS)).select("_key", "rank")
    joined = pieces.join(copies, F.col("key") == F.col("_key"), "left")
    return joined.select("doc_id", F.coalesce("rank", F.lit(0)).cast("long").alias("copy"), *(c for c in pieces.columns if c not in ("key", "doc_id")))


def sequences(pieces: DataFrame, tokens: DataFrame, wide: bool = False, window: int = 2048, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, n_ids): the packed sequences, padded to ``window`` unless their length is a power of two."""
    step = 4 if wide else 2
    parts = pieces.join(tokens.select(F.col("key").alias("_key"), "ids"), F.col("key") == F.col("_key"))
    parts = parts.select("sequence_id", "offset", "length", F.expr(f"substring(ids, cast(start * {step} + 1 as int), cast(length * {step} as int))").alias("ids"))
    one = parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))  # at most `window` pieces

    def run(batches):
        for batch in batches:
            ids, n = [], []
            for row in batch.column("p").to_pylist():
                flat = np.frombuffer(b"".join(x["ids"] for x in row), "<u4" if wide else "<u2").astype(np.int32)
                n.append(len(flat))
                full = len(flat) if len(flat) & (len(flat) - 1) == 0 else window
                ids.append(np.pad(flat, (0, full - len(flat)), constant_values=pad_id))
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(n, pa.int64())], names=["sequence_id", "ids", "n_ids"])

    return one.mapInArrow(run, "sequence_id long, ids array<int>, n_ids long")


def op8_packing(spark, sf_dir: str) -> DataFrame:
    pieces, _ = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
