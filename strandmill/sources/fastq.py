"""FASTQ: a splittable reader, folding of lines into reads, and records to write.

A record is four lines: header, sequence, strand (perhaps with the header again),
quality. A quality string may start with ``@`` like a header does; a line that starts
with ``@`` is a quality line if the next one starts with ``@`` too or there is none.
"""

from __future__ import annotations

import io
import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..shared import before

SCHEMA = "file string, offset long, meta string, seq string, strand string, repeated boolean, qual string"


def to_lines(reads: DataFrame) -> DataFrame:
    """(line_no, line) of reads with contiguous read_id."""
    lines = F.posexplode(F.array("meta", "seq", "strand", "qual")).alias("k", "line")
    return reads.select("read_id", lines).select((F.col("read_id") * 4 + F.col("k")).alias("line_no"), "line")


def fold_lines(lines: DataFrame) -> DataFrame:
    """(read_id, meta, seq, strand, qual, seq_len, meta_len, has_n) from numbered lines: one shuffle, by record."""
    pick = lambda k: F.max(F.when(F.col("line_no") % 4 == k, F.col("line")))
    rows = lines.groupBy(F.floor(F.col("line_no") / 4).cast("long").alias("read_id")).agg(pick(0).alias("meta"), pick(1).alias("seq"), pick(2).alias("strand"), pick(3).alias("qual"))
    return rows.withColumns({"seq_len": F.length("seq"), "meta_len": F.length("meta"), "has_n": F.contains("seq", F.lit("N"))})


def boundaries(lines: DataFrame) -> DataFrame:
    """(line_no, is_quality) of lines that start with ``@``; looks at the next line only.

    A line with ``@`` reports to its own number, any other to the one before, so lines are read once and shuffled by that number, without a join.
    """
    marked = F.startswith("line", F.lit("@"))
    told = lines.where("line is not null").select((F.col("line_no") - F.when(marked, 0).otherwise(1)).alias("line_no"), marked.alias("marked"))
    return told.groupBy("line_no").agg(F.bool_or("marked").alias("_at"), F.bool_and("marked").alias("is_quality")).where("_at").select("line_no", "is_quality")


def records(reads: DataFrame) -> DataFrame:
    """(read_id, record): four lines a read; where column ``repeated`` is true the header stands behind the strand again."""
    again: Column = F.when(F.col("repeated"), F.substr("meta", F.lit(2))).otherwise("") if "repeated" in reads.columns else F.lit("")
    return reads.select("read_id", F.concat_ws("\n", "meta", "seq", F.concat("strand", again), "qual").alias("record"))


def write(reads: DataFrame, path: str, parts: int | None = None) -> None:
    """FASTQ text files in read order: ranges of read_id, sorted inside."""
    rows = records(reads)
    dealt = rows.repartitionByRange(parts, "read_id") if parts else rows.repartitionByRange("read_id")
    dealt.sortWithinPartitions("read_id").select("record").write.text(path)


def numbered(reads: DataFrame, block: int = 1 << 20) -> DataFrame:
    """``reads`` of the source below with read_id, contiguous in order of file and offset.

    Reads are numbered inside blocks of bytes, which depend on the offsets alone; the counts
    of the blocks before are added.
    """
    dealt = reads.withColumn("_p", F.floor(F.col("offset") / block))
    local = dealt.withColumn("_r", F.row_number().over(Window.partitionBy("file", "_p").orderBy("offset")) - 1)
    counts = reads.groupBy(F.col("file").alias("_f"), F.floor(F.col("offset") / block).alias("_q")).agg(F.count(F.lit(1)).alias("_n"))
    ahead = before(counts, "_q", "_n", "_b", group="_f").select("_f", "_q", "_b")
    joined = local.join(ahead, (F.col("file") == F.col("_f")) & (F.col("_p") == F.col("_q")))
    return joined.withColumn("read_id", F.col("_r") + F.col("_b")).drop("_p", "_r", "_f", "_q", "_b")


class Split(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def split_records(stream, start: int, end: int):
    """Records that begin in [start, end) of a binary stream: (offset, meta, seq, strand, repeated, qual).

    A split that begins inside the file looks for its first header; the record
    that reaches over its end is read to its end.
    """
    if start:
        stream.seek(start - 1)
        stream.readline()  # the line that holds the byte before; nothing but its feed if a line starts here
    at = stream.tell()
    line = stream.readline()
    while start and line and at < end:  # a header: the next line exists and isn't one
        after = stream.tell()
        ahead = stream.readline()
        if line.startswith(b"@") and ahead and not ahead.startswith(b"@"):
            stream.seek(after)
            break
        at, line = after, ahead
    while line and at < end:
        rest = [stream.readline() for _ in range(3)]
        meta, seq, mark, qual = (x.rstrip(b"\r\n").decode("latin-1") for x in (line, *rest))
        if meta:
            yield at, meta, seq, mark[:1], len(mark) > 1, qual
        at = stream.tell()
        line = stream.readline()


class FastqReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.size = int(options.get("splitBytes", 64 << 20))

    def _system(self):
        """The file system and the path in it; lists nothing, as every task asks."""
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path else os.path.abspath(self.path))

    def _files(self):
        from pyarrow import fs

        system, path = self._system()
        info = system.get_file_info(path)
        if info.type == fs.FileType.File:
            return system, [info]
        found = system.get_file_info(fs.FileSelector(path, recursive=True))
        return system, sorted((i for i in found if i.type == fs.FileType.File and not i.base_name.startswith(("_", "."))), key=lambda i: i.path)

    def partitions(self):
        return [Split(i.path, a, min(a + self.size, i.size)) for i in self._files()[1] for a in range(0, i.size, self.size)]

    def read(self, partition):
        with self._system()[0].open_input_file(partition.path) as f:
            for row in split_records(io.BufferedReader(f, 1 << 20), partition.start, partition.end):
                yield (partition.path, *row)


class FastqSource(DataSource):
    """``spark.dataSource.register(FastqSource); spark.read.format("fastq").load(path)``; option splitBytes."""

    @classmethod
    def name(cls):
        return "fastq"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FastqReader(self.options)
