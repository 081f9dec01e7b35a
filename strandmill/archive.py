"""Whole archives: reads to packed tables and back.

An archive is a folder of Parquet tables: ``sequences`` (tuples and strand of the alignment), ``headers``
and ``qualities`` (packed streams), ``marks`` (strand line of each read), and ``others`` for headers
that don't share the batch's separators. The three streams are written apart and
meet again by read_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fields as fn
from .operators import align, blocked, metadata, streams


def compress(reads: DataFrame, ref: DataFrame | blocked.BlockedIndex, path: str, sa: DataFrame | None = None) -> None:
    """Write reads (read_id unique, meta, seq, strand, repeated, qual) against a one-row reference and, if given, its stored suffix array, or
    against an index of blocks, whatever the reference's size.
    """
    put = lambda df, name: df.write.option("compression", "zstd").parquet(f"{path}/{name}")
    if "repeated" not in reads.columns:
        reads = reads.withColumn("repeated", F.lit(False))
    put(blocked.best_strand(reads, ref) if isinstance(ref, blocked.BlockedIndex) else align.best_strand(reads, ref, sa=sa), "sequences")
    put(reads.select("read_id", "strand", "repeated", F.col("qual").isNull().alias("bare")), "marks")
    common = metadata.separator_counts(reads).orderBy(F.desc("n"), "separators").select("separators").first()
    same = fn.separators(F.col("meta")).eqNullSafe(F.lit(common[0] if common else ""))
    alike = reads.where(same)
    put(streams.metadata_stream(alike), "headers")
    put(reads.where(~same).select("read_id", "meta"), "others")
    put(streams.quality_stream(reads.where(F.length("qual") > 0)), "qualities")


def decompress(spark: SparkSession, path: str, ref: DataFrame | blocked.BlockedIndex) -> DataFrame:
    """(read_id, meta, seq, strand, repeated, qual) from an archive and its reference."""
    get = lambda name: spark.read.parquet(f"{path}/{name}")
    seqs = (blocked if isinstance(ref, blocked.BlockedIndex) else align).decoded(get("sequences"), ref)
    headers = streams.metadata_read(get("headers")).unionByName(get("others")).withColumnRenamed("read_id", "h")
    quals = streams.quality_read(get("qualities")).withColumnRenamed("read_id", "q")
    joined = get("marks").join(seqs.withColumnRenamed("read_id", "s"), F.col("read_id") == F.col("s"))
    joined = joined.join(headers, F.col("read_id") == F.col("h")).join(quals, F.col("read_id") == F.col("q"), "left")
    return joined.select("read_id", "meta", "seq", "strand", "repeated", F.when(~F.col("bare"), F.coalesce("qual", F.lit(""))).alias("qual"))
