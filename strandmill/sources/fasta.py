"""FASTA: lines by offset, and the stored index of a reference.

Lines are read in parallel. References that can be sent to tasks are stored as one text with the tables below, larger ones as
blocks (``operators.blocked``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource

from ..operators import blocked, index
from .fastq import FastqReader

TABLES = ("ref", "sa", "bwt", "grams_1", "grams_2", "grams_3", "intervals_1", "intervals_2", "checkpoints")


def split_lines(stream, start: int, end: int):
    """(offset, line) of the lines that begin in [start, end) of a binary stream."""
    if start:
        stream.seek(start - 1)
        stream.readline()
    at = stream.tell()
    while at < end and (line := stream.readline()):
        yield at, line.rstrip(b"\r\n").decode("latin-1")
        at = stream.tell()


class FastaReader(FastqReader):
    def read(self, partition):
        import io

        with self._system()[0].open_input_file(partition.path) as f:
            for at, line in split_lines(io.BufferedReader(f, 1 << 20), partition.start, partition.end):
                yield partition.path, at, line


class FastaSource(DataSource):
    """``spark.dataSource.register(FastaSource); spark.read.format("fasta").load(path)``: (file, line_no, line).

    ``line_no`` is the line's offset in its file, so order is kept though not the count; option splitBytes.
    """

    @classmethod
    def name(cls):
        return "fasta"

    def schema(self):
        return "file string, line_no long, line string"

    def reader(self, schema):
        return FastaReader(self.options)


def build_index(ref: DataFrame, path: str) -> None:
    """Write the reference, its suffix array and the counts of its FM index as one Parquet table each."""
    spark = ref.sparkSession
    put = lambda df, name: df.write.option("compression", "zstd").parquet(f"{path}/{name}")
    get = lambda name: spark.read.parquet(f"{path}/{name}")
    put(ref, "ref")
    ref = get("ref")
    put(index.suffix_array(ref), "sa")
    sa = get("sa")
    put(index.bwt(ref, sa), "bwt")
    for k in (1, 2, 3):
        put(index.gram_counts(ref, k), f"grams_{k}")
    for k in (1, 2):
        put(index.intervals(ref, sa, k), f"intervals_{k}")
    put(index.checkpoints(get("bwt")), "checkpoints")


def load_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that ``build_index`` wrote, by name; scans are lazy."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}


def stored(spark: SparkSession, path: str) -> tuple[DataFrame | blocked.BlockedIndex, DataFrame | None]:
    """What alignment takes from an index at ``path``: its text and suffix array, or its blocks."""
    buckets = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/buckets")
    if buckets.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(buckets):
        return blocked.BlockedIndex.load(spark, path), None
    tables = load_index(spark, path)
    return tables["ref"], tables["sa"]
