"""Packed streams of a batch of reads, as BINARY rows: headers with their schema, and qualities with their model.

A stream is a table (part, entries, data): part 0 describes the batch, parts from 1 hold
consecutive chunks of reads. Each part can be read with part 0 alone, so parts decode in
parallel; on disk Parquet keeps them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fields as fn
from ..functions import runs
from ..functions.packed import BitReader, BitWriter
from . import metadata, quality

MAGIC_META, MAGIC_QUAL = 0x18318525, 0x12345678
CONST, ALPHA, NUMERIC, AUTOINC = range(4)
#: Parts of headers a task has at most on average, and reads of a part that are decoded at once (a multiple of 8, so that they begin with a byte).
PARTS, SOME = 16, 8192
PART = "first long, entries long, ids array<long>, data binary"


def _describe(kinds: list, words: dict[int, list[str]], separators: str, entries: int) -> bytes:
    """Part 0 of a header stream. Lengths take 32 bits, so dictionaries and values have no other limit."""
    w = BitWriter()
    w.write(MAGIC_META, 32)
    w.write(len(kinds), 16)
    w.write(entries, 40)
    w.write(len(separators), 16)
    for s in separators:
        w.write(fn.SEPARATORS.index(s), 3)
    for k in kinds:
        kind = {"CONST": CONST, "ALPHA": ALPHA, "NUMERIC": NUMERIC, "AUTOINC": AUTOINC}[k.type]
        w.write(kind, 2)
        w.write(int(k.mapped), 1)
        listed = [k.constant] if kind == CONST else words.get(k.field, []) if k.mapped else []
        w.write(k.width, 32)
        w.write(k.low or 0 if kind == AUTOINC else 0, 64)
        w.write(len(listed), 32)
        for value in listed:
            raw = value.encode()
            w.write(len(raw), 32)
            for b in raw:
                w.write(b, 8)
    return w.data


def _described(data: bytes) -> tuple[list[dict], str, int]:
    r = BitReader(data)
    if r.read(32) != MAGIC_META:
        raise ValueError("not a header stream")
    n, entries, seps = r.read(16), r.read(40), r.read(16)
    separators = "".join(fn.SEPARATORS[r.read(3)] for _ in range(seps))
    kinds = []
    for _ in range(n):
        k = {"kind": r.read(2), "mapped": r.read(1), "width": r.read(32), "low": r.read(64)}
        k["listed"] = [bytes(r.read(8) for _ in range(r.read(32))).decode() for _ in range(r.read(32))]
        kinds.append(k)
    return kinds, separators, entries


def metadata_stream(reads: DataFrame, rows_per_part: int = 65_536) -> DataFrame:
    """(part, first, entries, ids, data) of reads whose headers share their separators. A part holds the reads of ``rows_per_part``
    numbers; ``ids`` lists their read_ids where some are missing. Part 0 has the smallest read_id as ``first``.

    The schema and its dictionaries (under a hundredth of the batch's rows) are collected, as
    they are what part 0 holds. Reads with other separators are an error: see ``separator_counts``.
    """
    spark = reads.sparkSession
    seps = metadata.separator_counts(reads).limit(2).collect()
    if len(seps) > 1:
        raise ValueError("headers of one batch must share their separators")
    table = metadata.frozen(metadata.schema(reads))
    kinds = table.orderBy("field").collect()
    mapped = [k.field for k in kinds if k.mapped]
    words: dict[int, list[str]] = {}
    for r in metadata.dictionary(reads, table, used=True).where(F.col("field").isin(mapped)).orderBy("field", "code").collect() if mapped else []:
        words.setdefault(r.field, []).append(r.value)
    entries, least, most = reads.agg(F.count(F.lit(1)), *(F.coalesce(f("read_id"), F.lit(0)) for f in (F.min, F.max))).first()
    head = spark.createDataFrame([(0, least, entries, None, bytearray(_describe(kinds, words, seps[0].separators if seps else "", entries)))], f"part int, {PART}").coalesce(1)  # the first task of all, so that a look at part 0 runs no other
    rows = metadata.row_codes(reads, table).select("read_id", "bits", (F.expr(f"read_id div {rows_per_part}") + 1).cast("int").alias("part"))
    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-(most - least) // (rows_per_part * PARTS)))
    dealt = rows.repartition(tasks, "part").sortWithinPartitions("part", "read_id")
    kind = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("entries", pa.int64()), ("ids", pa.list_(pa.int64())), ("data", pa.binary())])

    def run(batches):
        now, ids, bits = None, [], []

        def out():
            i = np.concatenate(ids)
            listed = None if i[-1] - i[0] == len(i) - 1 else i
            return pa.RecordBatch.from_pylist([{"part": now, "first": int(i[0]), "entries": len(i), "ids": listed, "data": np.packbits(np.concatenate(bits)).tobytes()}], schema=kind)

        for b in batches:
            part, read = b.column("part").to_numpy(), b.column("read_id").to_numpy()
            digits, at = runs.points(b.column("bits"))
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for x, y in zip(cuts, cuts[1:]):
                if y > x and part[x] != now:
                    if ids:
                        yield out()
                    now, ids, bits = int(part[x]), [], []
                if y > x:
                    ids.append(read[x:y].astype(np.int64))
                    bits.append((digits[at[x] : at[y]] & 1).astype(np.uint8))
        if ids:
            yield out()

    return head.unionByName(dealt.mapInArrow(run, f"part int, {PART}"))


def metadata_read(stream: DataFrame) -> DataFrame:
    """(read_id, meta) from nothing but a stream's rows."""
    top = stream.where("part = 0").select("data", F.col("first").alias("first_id")).first()
    kinds, separators, _ = _described(bytes(top.data))
    least = top.first_id

    width = sum(k["width"] for k in kinds if k["kind"] in (NUMERIC, ALPHA))

    def metas(ids: np.ndarray, bits: np.ndarray) -> pa.Array:
        out, at = [], 0
        for i, k in enumerate(kinds):
            own = bits[:, at : at + k["width"]] if k["kind"] in (NUMERIC, ALPHA) else bits[:, :0]
            at += own.shape[1]
            number = np.zeros(len(ids), np.int64)
            if k["kind"] == NUMERIC or k["mapped"]:
                for j in range(own.shape[1]):
                    number = number << 1 | own[:, j]
            if k["kind"] == CONST:
                value = k["listed"][0]
            elif k["kind"] == AUTOINC:
                value = pa.array(k["low"] + ids - least).cast(pa.string())
            elif k["kind"] == NUMERIC:
                value = pa.array(number).cast(pa.string())
            elif k["mapped"]:
                value = pa.array(k["listed"], pa.string()).take(pa.array(number))
            else:
                letters = np.packbits(own, axis=1)
                ends = np.where(letters.any(axis=1), letters.shape[1] - np.argmax(letters[:, ::-1] != 0, axis=1), 0) if letters.shape[1] else np.zeros(len(ids), np.int64)
                held = letters[np.arange(letters.shape[1]) < ends[:, None]]
                value = pa.StringArray.from_buffers(len(ids), pa.py_buffer(np.concatenate([[0], np.cumsum(ends)]).astype(np.int32).tobytes()), pa.py_buffer(held.tobytes()))
            out += ["@" if i == 0 else separators[i - 1], value]
        return pc.binary_join_element_wise(pa.array([""] * len(ids)), *out, "")  # the first one gives the length

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):  # a part at a time, a few thousand reads of it at once
                first, n, listed = b.column("first")[row].as_py(), b.column("entries")[row].as_py(), b.column("ids")[row]
                ids = listed.values.to_numpy() if listed.is_valid and len(listed) else np.arange(first, first + n)
                data = np.frombuffer(b.column("data")[row].as_buffer(), np.uint8)
                if len(data) * 8 < n * width:
                    raise EOFError("no more bits")
                for at in range(0, n, SOME):
                    some = ids[at : at + SOME]
                    bits = np.unpackbits(data[at * width // 8 : -(-(at + len(some)) * width // 8)], count=len(some) * width).reshape(len(some), width)
                    yield pa.RecordBatch.from_arrays([pa.array(some), metas(some, bits)], names=["read_id", "meta"])

    return stream.where("part > 0").mapInArrow(run, "read_id long, meta string")


def quality_stream(quals: DataFrame, rows_per_part: int = 512) -> DataFrame:
    """(part, first, entries, data): part 0 holds the mark and 190 cumulative counts; others, reads with their coded lengths."""
    spark = quals.sparkSession
    cum = quality.smoothed(quality.model(quals))
    w = BitWriter()
    for value, width in ((MAGIC_QUAL, 32), *((c, 64) for c in cum)):
        w.write(value, width)
    head = spark.createDataFrame([(0, 0, 0, bytearray(w.data))], "part int, first long, entries long, data binary").coalesce(1)
    listed = quality.arithmetic_code(quals, cum).select("read_id", "data", (F.floor(F.col("read_id") / rows_per_part) + 1).cast("int").alias("part"))
    parts = listed.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("read_id", "data"))).alias("r"))  # at most rows_per_part reads

    def run(batches):
        for b in batches:
            for part, listed in zip(b.column("part").to_pylist(), b.column("r")):
                rows = listed.as_py()  # one part's
                data = b"".join(x["read_id"].to_bytes(8, "big") + len(x["data"]).to_bytes(4, "big") + x["data"] for x in rows)
                yield pa.RecordBatch.from_pylist([{"part": part, "first": rows[0]["read_id"], "entries": len(rows), "data": data}], schema=pa.schema([("part", pa.int32()), ("first", pa.int64()), ("entries", pa.int64()), ("data", pa.binary())]))

    return head.unionByName(parts.mapInArrow(run, "part int, first long, entries long, data binary"))


def quality_read(stream: DataFrame) -> DataFrame:
    """(read_id, qual) from nothing but a stream's rows."""
    r = BitReader(bytes(stream.where("part = 0").first().data))
    if r.read(32) != MAGIC_QUAL:
        raise ValueError("not a quality stream")
    cum = [r.read(64) for _ in range(quality.SYMBOLS + 1)]

    def run(batches):
        for b in batches:
            for held in b.column("data"):
                data, ids, coded, at = held.as_py(), [], [], 0
                while at < len(data):
                    n = int.from_bytes(data[at + 8 : at + 12], "big")
                    ids.append(int.from_bytes(data[at : at + 8], "big"))
                    coded.append(data[at + 12 : at + 12 + n])
                    at += 12 + n
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(coded, pa.binary())], names=["read_id", "data"])

    return quality.arithmetic_read(stream.where("part > 0").select("data").mapInArrow(run, "read_id long, data binary"), cum)
