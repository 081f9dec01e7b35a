"""Token ids in ORC: run-length integers, row indexes, and Bloom filters on document ids.

Documents are dealt by ranges of doc_id and sorted, so file number, stripe and row
follow ascending doc_id. Each row holds the document's ids as an integer list (ORC
writes those with its run-length encoding) and how many ids its file holds before
it. Row indexes carry minimum and maximum doc_id of every ``stride`` rows and a
Bloom filter, so a lookup by id reads little more than the row groups that hold it.
Readers take stripes in parallel.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_batches, scratch_path
from .tokens import default_path, encoder, with_end

NAMES = ["doc_id", "part", "part_start", "n_tokens", "ids"]


def encode(docs: DataFrame, path: str, end_id: int | None) -> DataFrame:
    """Rows of ``NAMES`` in the order of the input's partitions; null texts are empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        enc, part, before = encoder(path), TaskContext.get().partitionId(), 0
        for batch in arrow_batches(batches, 256, "text", 2 << 20):
            flat, n = with_end(*enc.batch(batch.column("text").to_pylist()), end_id)
            edges = np.concatenate([[0], np.cumsum(n)])
            ids = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(flat.view(np.int32)))
            columns = [batch.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(before + edges[:-1]), pa.array(n), ids]
            before += int(edges[-1])
            yield pa.RecordBatch.from_arrays(columns, names=NAMES)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, part int, part_start long, n_tokens long, ids array<int>")


def write(docs: DataFrame, out: str, path: str, end_id: int | None = 0, stride: int = 1024, stripe_mb: int = 16) -> None:
    """Encode ``docs`` (doc_id, text) and write ORC files in ascending doc_id order.

    Null ids come first; rows of one id follow the hash of their text. Extra columns
    are not written. Writing is a normal committed Spark job: lost executors repeat tasks.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.col("_key"), F.col("_row")]
    keyed = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("_key"), F.monotonically_increasing_id().alias("_row"))
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order)  # _row splits any number of equal rows
    options = {
        "compression": "zstd",
        "orc.create.index": "true",
        "orc.row.index.stride": str(stride),
        "orc.stripe.size": str(stripe_mb << 20),
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": "0.01",
    }
    encode(dealt, path, end_id).write.options(**options).orc(out)


def scan(spark: SparkSession, out: str, kind: str = "bigint") -> DataFrame:
    """The written rows; filters on doc_id reach the row indexes and Bloom filters."""
    return spark.read.schema(f"doc_id {kind}, part int, part_start long, n_tokens long, ids array<int>").orc(out)


def starts(stored: DataFrame) -> DataFrame:
    """(part, base): ids in all files before each. One row a file."""
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("base"))


def digests(stored: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from stored rows."""
    kind = stored.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "part", "part_start", "n_tokens", "ids_crc32"]

    def run(batches):
        for batch in batches:
            lists = batch.column("ids")
            edges = lists.offsets.to_numpy()
            flat = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)).cast("B")
            crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(edges.tolist(), edges[1:].tolist())]
            n = np.diff(edges).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names[:3]), pa.array(n), pa.array(crc, pa.int64())], names=names)

    found = stored.mapInArrow(run, f"doc_id {kind}, part int, part_start long, n_tokens long, ids_crc32 long")
    return found.join(starts(stored), F.col("part") == F.col("_part")).select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")


def op2_orc_tokens(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = scratch_path(spark, "tokens-orc")
    write(docs, out, default_path(), end_id=0)
    return digests(scan(spark, out, docs.schema["doc_id"].dataType.simpleString()))
