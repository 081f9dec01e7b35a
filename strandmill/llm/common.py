"""Helpers that the training-data operators share.

``scratch_dir`` follows the session's ``spark.checkpoint.dir``: tables that cut
lineage are written there, where driver and executors both see them, and read
back. Where that setting is missing, a session in one process takes a local folder; on a
cluster that is an error.
"""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Java regular expression of a word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one key that one window numbers.
PART_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="strandmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/strandmill-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of the written table."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote and that nothing reads any more."""
    spark = df.sparkSession
    root = scratch_dir(spark).removeprefix("file:")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = re.sub(r"^file:/*", "/", folder)
        if not at.startswith(re.sub(r"^/*", "/", root) + "/strandmill-"):
            raise ValueError(f"not a scratch table: {folder}")
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of documents whose labels training never sees; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def crc_of_ids(ids) -> int:
    """CRC-32 of token ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())


def enclosed(docs: DataFrame, *known: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` as its ``known`` columns and one struct of all others, and a function that takes a result back to the
    old columns in their order. So no name of an extra column can clash with an operator's own.
    """
    columns = docs.columns
    own = [c for c in known if c in columns]
    others = [c for c in columns if c not in own]
    extra = F.struct(*(docs[f"`{c}`"] for c in others)) if others else F.lit(None).cast("string")
    back = lambda df: df.select(*(F.col(c) if c in own else F.col("_extra").getField(c).alias(c) for c in columns))
    return docs.select(*own, extra.alias("_extra")), back


def extra_key(df: DataFrame) -> Column:
    """A hash of what ``enclosed`` put aside, to tell rows apart that agree in all known columns. It doesn't depend on the order of rows."""
    kept = df.schema["_extra"].dataType.typeName() == "struct"
    return F.xxhash64(F.to_json("_extra")) if kept else F.lit(0).cast("long")


def arrow_batches(batches, rows: int = 256, text: str | None = None, limit: int = 8 << 20):
    """Slices of at most ``rows`` rows and, unless one row is longer, ``limit`` bytes of column ``text``."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(rows, batch.num_rows - at)
            if text:
                sizes = pc.fill_null(pc.binary_length(batch.column(text).slice(at, n)), 0).to_pylist()
                total = 0
                for i, size in enumerate(sizes):
                    total += size
                    if i and total > limit:
                        n = i
                        break
            yield batch.slice(at, n)
            at += n


def training_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, longest: int) -> list:
    """(doc_id, text, label) of at most ``limit`` labelled documents outside the held-out fifth.

    The sample is the ``limit`` smallest hashes of doc_id, so it is the same in
    every run and spread over all sources. Of several texts with one doc_id the one with
    the smallest CRC-32 is taken. Texts above ``longest`` characters
    are left out of training (never of scoring), which bounds the driver's memory.
    """
    known = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y"))
        .where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & ~held_out("_id"))
        .groupBy("_id")
        .agg(F.max("_y").alias("_y"), F.min("_y").alias("_low"))
        .where("_y = _low")  # contradicting labels of one document teach nothing
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(limit)
    )
    found = (
        docs.select("doc_id", "text")
        .where(F.col("text").isNotNull() & (F.length("text") <= longest))
        .join(F.broadcast(known), F.col("doc_id") == F.col("_id"))  # at most `limit` rows of 12 bytes
        .select("doc_id", "text", "_y")
    )
    rows: dict = {}
    for r in found.toLocalIterator() if limit > 100_000 else found.collect():
        text = r[1].encode()
        old = rows.get(r[0])
        if old is None or (zlib.crc32(text), text) < (zlib.crc32(old[1].encode()), old[1].encode()):
            rows[r[0]] = tuple(r)
    return [rows[k] for k in sorted(rows)]


def repeated(df: DataFrame, times: str, number: str, keys: list[str]) -> DataFrame:
    """Each row ``times`` times, numbered 0, 1, ... in column ``number``. A row of many times is dealt over tasks in chunks of PART_ROWS, by ``keys`` and chunk."""
    chunks = df.withColumn("_chunk", F.explode(F.expr(f"sequence(0L, (cast({times} as bigint) - 1) div {PART_ROWS})"))).repartition(*keys, "_chunk")
    return chunks.withColumn(number, F.explode(F.expr(f"sequence(_chunk * {PART_ROWS}, least(cast({times} as bigint), (_chunk + 1) * {PART_ROWS}) - 1)"))).drop("_chunk")


def ranked(df: DataFrame, keys: list[str], order: list[Column], parts: Column, weight: str | None = None) -> DataFrame:
    """Add ``rank``: 0, 1, ... within ``keys``, without bringing one key's rows together. With ``weight``, a row counts as so many.

    Rows of a key are dealt into ``parts`` (a number that follows the key's rows) by a hash of
    ``order``; a window numbers the rows of each part, and prefix sums over the parts' counts
    give the offset of each. So a key holding a third of all rows still leaves few
    rows of it in one window. Null keys form one group.
    """
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.greatest(parts, F.lit(1)).cast("long")))
    within = Window.partitionBy(*keys, "_part")
    ahead = within.orderBy(*order)
    local = dealt.withColumn("_local", F.sum(weight).over(ahead.rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight) if weight else F.row_number().over(ahead) - 1)
    counts = dealt.groupBy(*keys, "_part").agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return local.join(offsets, same).withColumn("rank", (F.col("_local") + F.col("_offset")).cast("long")).drop("_part", "_local", "_offset", "_p", *(f"_k{i}" for i in range(len(keys))))
