import random

import pytest
from pyspark.sql import functions as F

from strandmill.functions.packed import BitReader, BitWriter, pack, unpack
from strandmill.operators import streams


def test_bits():
    rng = random.Random(1)
    values = [(rng.getrandbits(w) if w else 0, w) for w in (rng.randint(0, 40) for _ in range(500))]
    w = BitWriter()
    for v, n in values:
        w.write(v, n)
    r = BitReader(w.data)
    assert [r.read(n) for _, n in values] == [v for v, _ in values]
    r.align()
    assert r.ended
    with pytest.raises(EOFError):
        r.read(1)
    with pytest.raises(ValueError):
        w.write(4, 2)


def test_packed_columns(spark):
    texts = ["", "1", "00000001", "101010101", "1" * 64, "0" * 13]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", pack(F.col("t")).alias("b")).select("t", "b", unpack(F.col("b")).alias("u")).collect()
    for r in rows:
        w = BitWriter()
        w.bits(r.t)
        assert bytes(r.b) == w.data and r.u == r.t + "0" * (-len(r.t) % 8)


def test_header_stream(spark):
    metas = [f"@run.{i + 5} {'' if i % 3 else 'xé'}:{i * 7}:00{i % 4}#{'abc'[i % 3]}.{2**31 + i}" for i in range(300)]
    reads = spark.createDataFrame(list(enumerate(metas)), "read_id long, meta string").repartition(5)
    stream = streams.metadata_stream(reads, rows_per_part=20)
    assert {r.part for r in stream.collect()} == set(range(16)) and all(r.ids is None for r in stream.collect())
    assert {r.read_id: r.meta for r in streams.metadata_read(stream).collect()} == dict(enumerate(metas))
    few = streams.metadata_stream(reads.where("read_id < 3"))
    assert {r.read_id: r.meta for r in streams.metadata_read(few).collect()} == dict(enumerate(metas[:3]))
    gaps = streams.metadata_stream(reads.where("read_id % 7 <> 3 and read_id > 30"), rows_per_part=50)
    assert {r.read_id: r.meta for r in streams.metadata_read(gaps).collect()} == {i: m for i, m in enumerate(metas) if i % 7 != 3 and i > 30}
    with pytest.raises(ValueError):
        streams.metadata_stream(reads.unionByName(spark.createDataFrame([(300, "@a")], reads.schema)))


def test_quality_stream(spark):
    rng = random.Random(3)
    quals = ["".join(rng.choice("HHHHHGFI#") * rng.randint(1, 80) for _ in range(rng.randint(1, 5))) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(quals)), "read_id long, qual string").repartition(3)
    stream = streams.quality_stream(rows, rows_per_part=64)
    assert {r.part: r.entries for r in stream.collect()} == {0: 0, 1: 64, 2: 64, 3: 64, 4: 8}
    assert {r.read_id: r.qual for r in streams.quality_read(stream).collect()} == dict(enumerate(quals))
