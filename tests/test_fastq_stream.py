import os

from strandmill.sources.fastq import Split
from strandmill.streaming.fastq_stream import FastqStream, advanced, spans

SINK = "file string, offset long, meta string, seq string, strand string, repeated boolean, qual string"


def test_offsets():
    assert advanced({}, {"b": 10, "a": 5}, 8) == {"a": 5, "b": 3}
    assert advanced({"a": 5, "b": 3}, {"b": 10, "a": 5, "A": 2}, 100) == {"A": 2, "a": 5, "b": 10}
    assert advanced({"gone": 4}, {}, 5) == {"gone": 4} and advanced({"a": 1}, {"a": 9}, None) == {"a": 9}
    found = spans({"a": 3}, {"a": 10, "b": 2}, 4)
    assert all(isinstance(x, Split) for x in found) and [(x.path, x.start, x.end) for x in found] == [("a", 3, 7), ("a", 7, 10), ("b", 0, 2)]


def test_files_between_triggers_are_read_once_also_after_a_restart(spark, tmp_path):
    spark.dataSource.register(FastqStream)
    reads, sink, mark = str(tmp_path / "reads"), str(tmp_path / "sink"), str(tmp_path / "mark")
    os.makedirs(reads)
    wanted = []

    def put(name, n):
        rows = [(f"@{name}.{i}", "ACGT" * (i % 5 + 1), "@" * (4 * (i % 5 + 1)) if i % 3 == 0 else "HGFE" * (i % 5 + 1)) for i in range(n)]
        with open(f"{tmp_path}/{name}", "w") as f:
            f.writelines(f"{m}\n{s}\n+\n{q}\n" for m, s, q in rows)
        os.rename(f"{tmp_path}/{name}", f"{reads}/{name}")
        wanted.extend(rows)

    def start():
        stream = spark.readStream.format("fastq_stream").option("splitBytes", 300).option("maxBytesPerTrigger", 1000).load(reads)
        return stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", mark).start()

    def seen():
        return sorted((r.meta, r.seq, r.qual) for r in spark.read.schema(SINK).parquet(sink).collect())

    put("b", 40)
    query = start()
    try:
        query.processAllAvailable()
        assert seen() == sorted(wanted)
        put("a", 90)
        query.processAllAvailable()
        assert seen() == sorted(wanted)
        assert sum(p["numInputRows"] > 0 for p in query.recentProgress) >= 4  # the file's 3,000 bytes are more than two limits
    finally:
        query.stop()
    put("c", 30)
    query = start()
    try:
        query.processAllAvailable()
        assert seen() == sorted(wanted)
    finally:
        query.stop()
