import io
import random

import pytest

from strandmill.sources.fastq import FastqSource, numbered, split_records, write
from strandmill.streaming.batches import ReadBatches


def text(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        k = rng.randint(1, 40)
        qual = "".join(rng.choice("@+IH") for _ in range(k))
        rows.append((f"@run.{i} x:{i * 3}", "".join(rng.choice("ACGTN") for _ in range(k)), rng.choice("+-"), rng.random() < 0.3, qual))
    body = "".join(f"{m}\n{s}\n{p}{m[1:] if r else ''}\n{q}\n" for m, s, p, r, q in rows)
    return rows, body


@pytest.mark.parametrize("size", [1, 2, 7, 30, 64, 1000, 10**6])
def test_splits_meet_every_record_once(size):
    rows, body = text(60)
    data = body.encode()
    found = []
    for a in range(0, len(data), size):
        found += [r[1:] for r in split_records(io.BytesIO(data), a, min(a + size, len(data)))]
    assert found == rows


def test_source_and_writer(spark, tmp_path):
    rows, body = text(500, 2)
    path = tmp_path / "reads.fastq"
    path.write_text(body)
    spark.dataSource.register(FastqSource)
    reads = numbered(spark.read.format("fastq").option("splitBytes", 4096).load(str(path)), block=1000)
    got = reads.orderBy("read_id").collect()
    assert [r.read_id for r in got] == list(range(500))
    assert [(r.meta, r.seq, r.strand, r.repeated, r.qual) for r in got] == rows
    write(reads, str(tmp_path / "out"), parts=4)
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == body


def test_batches_carry_state(spark):
    def batch(first, n, qual="H" * 30, mark="1"):
        rows = [(i, f"@r.{i + 1} {'FOP'[i % 3]}:{i * 5}#{mark}", qual) for i in range(first, first + n)]
        return spark.createDataFrame(rows, "read_id long, meta string, qual string")

    b = ReadBatches()
    b(batch(0, 400), 0)
    b(batch(0, 400), 0)  # delivered again
    b(batch(0, 300), 1)
    b(batch(0, 200, mark="2"), 2)
    b(batch(0, 100, qual="!I" * 15, mark="2"), 3)
    assert [(n, t, kept, same) for _, n, t, kept, same, _ in b.log] == [(400, 400, False, False), (300, 700, True, True), (200, 900, False, True), (100, 1000, True, False)]


def test_stream_of_files(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(i, f"@r.{i + 1} F:{i}#1", "H" * 20) for i in range(50)], "read_id long, meta string, qual string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    b = ReadBatches()
    stream = spark.readStream.schema("read_id long, meta string, qual string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = stream.writeStream.foreachBatch(b).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert [x[1] for x in b.log] == [50, 50, 50] and [x[3] for x in b.log] == [False, True, True]


def test_batches_go_on_after_a_restart(spark, tmp_path):
    def batch(n, mark="F", qual="H" * 30):
        return spark.createDataFrame([(i, f"@r.{i + 1} {mark}{'abc'[i % 3]}:{i}#1", qual) for i in range(n)], "read_id long, meta string, qual string")

    given = [batch(400), batch(300), batch(350, mark="2"), batch(200, qual="!I" * 15, mark="2"), batch(0), batch(100, mark="2")]
    whole = ReadBatches(path=str(tmp_path / "whole"))
    for i, b in enumerate(given):
        whole(b, i)
    parts = str(tmp_path / "parts")
    for i, b in enumerate(given):
        one = ReadBatches(path=parts)  # a new driver for each batch
        if i:
            one(given[i - 1], i - 1)  # delivered again
        one(b, i)
    resumed = ReadBatches(path=parts)
    assert resumed.log == whole.log and [x[3] for x in whole.log] == [False, True, False, True, True, True]
    assert resumed.model == whole.model and resumed.total == 1350
    assert sorted(map(tuple, resumed.words.collect())) == sorted(map(tuple, whole.words.collect()))


def test_a_batch_that_was_cut_off_is_done_again(spark, tmp_path):
    reads = spark.createDataFrame([(i, f"@r.{i + 1} F:{i}#1", "H" * 20) for i in range(300)], "read_id long, meta string, qual string")
    one = ReadBatches(path=str(tmp_path / "s"))
    one._learn_schema(reads.limit(5), 0)  # tables of a batch that wasn't committed
    again = ReadBatches(path=str(tmp_path / "s"))
    assert again.log == [] and again.kinds is None
    again(reads, 0)
    assert [x[:4] for x in ReadBatches(path=str(tmp_path / "s")).log] == [(0, 300, 300, False)]
