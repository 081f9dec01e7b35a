import random

import pytest
from pyspark.sql import functions as F

from strandmill import shared
from strandmill.functions import packed
from strandmill.operators import align, index, metadata


def test_sums_before_by_spans(spark):
    rng = random.Random(3)
    rows = [(g, k, rng.randrange(9)) for g in ("b", "a", None) for k in sorted(rng.sample(range(200), 60))]
    got = shared.before(spark.createDataFrame(rows, "g string, k long, n long"), "k", "n", "ahead", group="g", span=16)
    rank = lambda r: (r[0] is not None, r[0] or "", r[1])
    assert got.columns == ["g", "k", "n", "ahead"]
    for r in got.collect():
        assert r.ahead == sum(x[2] for x in rows if rank(x) < rank(r))
    plain = shared.before(spark.createDataFrame([(k, 1) for k in range(100)], "k int, n long"), "k", "n", "ahead", span=7)
    assert sorted((r.k, r.ahead) for r in plain.collect()) == [(k, k) for k in range(100)]
    assert shared.before(spark.createDataFrame([], "k long, n long"), "k", "n", "ahead").collect() == []


def test_entries_of_seven_bits(spark):
    numbers = [random.Random(4).randrange(128) for _ in range(41)]
    w = packed.BitWriter()
    for x in numbers:
        w.write(x, 7)
    w.pad()
    r = packed.BitReader(w.data)
    r.seek(7 * 40)
    assert r.read(7) == numbers[40]
    with pytest.raises(EOFError):
        r.seek(len(w.data) * 8 + 1)
    rows = spark.createDataFrame([(i, bytearray(w.data)) for i in range(-1, 60)], "i long, d binary").select("i", packed.entry(F.col("d"), F.col("i"), 7).alias("x"))
    assert {x.i: x.x for x in rows.collect()} == {i: numbers[i] if 0 <= i < 41 else None for i in range(-1, 60)}


def test_letters_by_bits(spark):
    lines = spark.createDataFrame([(0, ">x"), (1, "acgT.!'@")], "line_no long, line string")
    assert index.normalise(lines).first().ref == "ACGTGGGG"
    assert index.normalise(lines, compat=True).first().ref == "ACGTGAGG"  # . is N, ! is A, ' is G, @ stays


def test_stored_index_must_fit(spark):
    text = "ACGTTGCAACCATGGTCAGT" * 3
    ref = spark.createDataFrame([(text,)], "ref string")
    order = index.FmIndex(text).sa.tolist()
    table = lambda rows: spark.createDataFrame(list(enumerate(rows)), "row long, pos long")
    assert align.shared_index(ref, table(order)).value.sa.tolist() == order
    with pytest.raises(ValueError, match="rows"):
        align._stored(table(order[:-1]), len(order))
    with pytest.raises(ValueError, match="isn't one"):
        index.FmIndex(text, align._stored(table([order[0], *order[:-1]]), len(order)))
    with pytest.raises(ValueError, match="at most 10"):
        align.shared_index(ref, most=10)


@pytest.mark.parametrize("few", [100_000, 0])
def test_header_codes_stay_in_their_rows(spark, few, monkeypatch):
    monkeypatch.setattr(metadata, "FEW", few)
    metas = [f"@r.{i} {'ab'[i % 2]}:x{i * i}" for i in range(300)]
    reads = spark.createDataFrame([*enumerate(metas), (300, None), (301, "@r.301"), (302, "@")], "read_id long, meta string")
    got = {r.read_id: r.meta for r in metadata.decoded(reads).collect()}
    assert got == {**dict(enumerate(metas)), 301: "@r.301", 302: "@"}
    if few:
        plan = metadata.row_codes(reads)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_ordered_rows_and_flags(spark):
    import random

    from strandmill import shared

    rng = random.Random(2)
    rows = [(k, f"w{rng.randint(0, 9)}", k % 3 == 0) for k in rng.sample(range(10_000), 500)]
    table = spark.createDataFrame([(k, w, int(f)) for k, w, f in rows], "k long, w string, f int").repartition(7)
    found = shared.ordered(table, ["w", "k"], "at", flag="f", flagged="ones").orderBy("at").collect()
    wanted = sorted((w, k, int(f)) for k, w, f in rows)
    assert [(r.w, r.k, r.f, r["at"]) for r in found] == [(*x, i) for i, x in enumerate(wanted)]
    assert [r.ones for r in found] == [sum(x[2] for x in wanted[:i]) for i in range(len(wanted))]
    assert shared.ordered(table.limit(0), ["w", "k"], "at").count() == 0
