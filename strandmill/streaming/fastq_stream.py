"""FASTQ files as a stream of reads: files that come later are read later, each byte once, and batches have a limit of bytes.

An offset holds the bytes read of each file. A batch takes files in order of their paths until its limit is reached, perhaps
ending inside a file; only the first batch after a start, in any number of splits, takes all that is there. A record belongs to the batch in which it begins. Files must come whole, as by a rename. The
checkpoint's offsets decide what a restarted query reads, so nothing is lost or read twice.
"""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceStreamReader

from ..sources.fastq import SCHEMA, FastqReader, Split


def advanced(start: dict[str, int], sizes: dict[str, int], most: int | None) -> dict[str, int]:
    """Bytes read of each file after at most ``most`` more bytes, files in order of their paths; without a limit, all bytes."""
    end, left = dict(start), most
    for path in sorted(sizes):
        more = sizes[path] - end.get(path, 0)
        if left is not None:
            more = min(more, left)
            left -= max(more, 0)
        if more > 0:
            end[path] = end.get(path, 0) + more
    return end


def spans(start: dict[str, int], end: dict[str, int], size: int) -> list[Split]:
    """Parts of the files between two offsets, of at most ``size`` bytes."""
    return [Split(p, a, min(a + size, b)) for p, b in sorted(end.items()) for a in range(start.get(p, 0), b, size)]


class FastqStreamReader(FastqReader, DataSourceStreamReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.most = int(options.get("maxBytesPerTrigger", 400 << 20))
        self.reached: dict[str, int] | None = None  # unknown after a start

    def _files(self):
        system, found = super()._files()
        top = self.path.split("://")[-1].rstrip("/")
        hidden = lambda path: any(part.startswith(("_", ".")) for part in path.split(top, 1)[-1].split("/"))  # noqa: E731  files that are still being written
        return system, [i for i in found if not hidden(i.path)]

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        """At most the limit behind the last offset. Spark doesn't tell where a started query stands, so its first batch takes all there is."""
        sizes = {i.path: i.size for i in self._files()[1]}
        self.reached = advanced(self.reached or {}, sizes, None if self.reached is None else self.most)
        return {"files": self.reached}

    def partitions(self, start: dict, end: dict):
        if self.reached is None:  # a batch that was planned before a restart
            self.reached = dict(end["files"])
        return spans(start["files"], end["files"], self.size)

    def commit(self, end: dict) -> None:
        """Nothing is kept here; the checkpoint holds the offsets."""


class FastqStream(DataSource):
    """``spark.dataSource.register(FastqStream); spark.readStream.format("fastq_stream").load(path)``; options splitBytes, maxBytesPerTrigger."""

    @classmethod
    def name(cls):
        return "fastq_stream"

    def schema(self):
        return SCHEMA

    def streamReader(self, schema):
        return FastqStreamReader(self.options)
