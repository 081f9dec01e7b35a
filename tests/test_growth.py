"""Work that grows with the rows and the text, not with their product."""

import random
import time

import pytest

from strandmill.operators import index
from strandmill.sources import derived as D

SF = "/root/testdata/sf0.001"


def _both(spark, text):
    rows = [(b, text[b * index.SIZE : (b + 1) * index.SIZE]) for b in range(-(-len(text) // index.SIZE))]
    return spark.createDataFrame([(text,)], "ref string"), spark.createDataFrame(rows, "block long, bases string")


@pytest.mark.parametrize("size", [1, 2, 3, index.SIZE - 1, index.SIZE, index.SIZE + 1, 2 * index.SIZE])
def test_an_index_over_the_ends_of_blocks(spark, size):
    text = "".join(random.Random(size).choices("ACGT", k=size))
    whole, n = text + "$", size + 1
    order = sorted(range(n), key=lambda i: whole[i:])
    ring = whole * 3
    for ref in _both(spark, text):
        sa = index.suffix_array(ref)
        assert [r.pos for r in sa.orderBy("row").collect()] == order
        assert [(r.b1, r.b2, r.b3) for r in index.bwt(ref, sa).orderBy("row").collect()] == [tuple(ring[n + i - k] for k in (1, 2, 3)) for i in order]
        grams = sorted((whole + whole[:2])[i : i + 3] for i in range(n))
        assert {r.gram: (r.n, r.before) for r in index.gram_counts(ref, 3).collect()} == {g: (grams.count(g), grams.index(g)) for g in set(grams) if "$" not in g}
        starts = [whole[i : i + 2] for i in order]
        assert {r.gram: r.low for r in index.intervals(ref, sa, 2).collect()} == {g: starts.index(g) for g in set(starts) if len(g) == 2 and "$" not in g}


def test_grams_of_a_long_text_take_time_in_proportion(spark):
    ref, _ = _both(spark, "".join(random.Random(1).choices("ACGT", k=200_000)))
    began = time.monotonic()
    assert sum(r.n for r in index.gram_counts(ref, 1).collect()) == 200_000
    assert time.monotonic() - began < 30  # a window found from the text's start each time took over 100 s


@pytest.mark.parametrize("reads", [D.customer_reads, D.order_reads])
def test_no_row_of_reads_holds_the_reference(spark, reads):
    plan = reads(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "listagg" not in plan.lower()


def test_an_entry_is_one_number_of_its_bytes(spark):
    from pyspark.sql import functions as F

    from strandmill.functions import packed

    for width in (1, 7, 8, 13, 40, 41):
        values = [random.Random(width + i).getrandbits(width) for i in range(30)]
        data = spark.createDataFrame([("".join(f"{v:0{width}b}" for v in values),)], "bits string").select(packed.pack(F.col("bits")).alias("d"), F.explode(F.sequence(F.lit(0), F.lit(29))).alias("i"))
        assert [r.v for r in data.select("i", packed.entry(F.col("d"), F.col("i"), width).alias("v")).orderBy("i").collect()] == values
    plan = data.select(packed.entry(F.col("d"), F.col("i"), 7))._jdf.queryExecution().analyzed().toString()
    assert "transform" not in plan.split("Project")[1]  # no letters of single bits


def test_coders_get_four_tasks_a_core(spark):
    from strandmill.plans import queries

    assert queries._spread(D.order_quals(spark, SF)).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def _plain_runs(text):
    import itertools

    return [(c, len(list(g))) for c, g in itertools.groupby(text)]


ODD = ["", None, "H", "HHHH", "IIH#" + "G" * 61, "é" * 130 + "zz", "\n\n~!", "H" * 300 + "G" * 41, "", "!I!I"]


def test_sizes_of_runs_come_without_a_regular_expression(spark):
    from strandmill.operators import legacy

    quals = spark.createDataFrame(list(enumerate(ODD)), "read_id long, qual string").coalesce(1)
    sizes = {
        "naive": (legacy.naive_run_size(quals), "bytes", lambda q: sum(2 * -(-n // 127) for _, n in _plain_runs(q))),
        "bits": (legacy.bit_run_size(quals), "bits", lambda q: 6 + sum(10 * -(-n // 15) for _, n in _plain_runs(q))),
        "flags": (legacy.flagged_run_size(quals), "bits", lambda q: sum(n // 129 * 14 + (0, 7, 14)[min(n % 129, 2)] for _, n in _plain_runs(q))),
        "huffman": (legacy.huffman_size(quals), "bits", lambda q: sum(n * len(legacy.HUFFMAN.get(c, " " * 22)) for c, n in _plain_runs(q))),
    }
    for rows, column, plain in sizes.values():
        assert {r.read_id: r[column] for r in rows.collect()} == {i: plain(q) for i, q in enumerate(ODD) if q}
        assert "regexp" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_delta_symbols_come_without_a_regular_expression(spark):
    from strandmill.operators import legacy

    quals = spark.createDataFrame(list(enumerate(ODD)), "read_id long, qual string").coalesce(1)
    plain = {}
    for i, q in enumerate(ODD):
        last, out = "H", []
        for c, n in _plain_runs(q or ""):
            out += [45 + ord(c) - ord(last)] * (c != last)
            n -= c != last
            out += [110] * (n // 20) + [90 + n % 20] * (n % 20 > 0)
            last = c
        plain[i] = out
    rows = legacy.delta_runs(quals)
    found = {i: [] for i in plain}
    for r in rows.orderBy("read_id", "ord").collect():
        found[r.read_id].append(r.symbol)
    assert found == plain
    sized = legacy.delta_run_size(quals.where("read_id not in (5, 6)"))
    assert {r.read_id: r.bits for r in sized.collect()} == {i: sum(legacy.DELTA_BITS[x] for x in p) + legacy.DELTA_BITS[45] for i, p in plain.items() if p and i not in (5, 6)}
    for df in (rows, sized):
        assert "regexp" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_adaptive_codes_come_without_a_regular_expression(spark):
    from strandmill.operators import quality

    given = [q if q is None else q.replace("é", "~").replace("\n", "!") for q in ODD]  # letters of a quality string
    quals = spark.createDataFrame(list(enumerate(given)), "read_id long, qual string")
    coded = quality.adaptive_code(quals, rows_per_part=4)
    assert {r.read_id: r.qual for r in quality.adaptive_read(coded).collect()} == {i: q for i, q in enumerate(given) if q}
    for df in (coded, quality.arithmetic_code(quals, list(range(190))), quality.symbols(quals)):
        assert "regexp" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_adaptive_symbols_are_found_in_two_looks():
    import numpy as np

    from strandmill.operators import quality

    rng, lanes = random.Random(3), np.arange(5)
    model = quality.Adaptive(5, quality.SYMBOLS + 1, most=3000)
    for _ in range(200):
        model.seen(lanes, np.array([rng.randrange(190) for _ in lanes]))
        codes = np.array([rng.randrange(190) for _ in lanes])
        lower, upper, total = model.bounds(lanes, codes)
        assert lower.tolist() == [int(model.counts[i, :c].sum()) for i, c in enumerate(codes)]
        for offset in (lower, upper - 1):  # a span as long as the total: an offset is a place among the counts
            assert (model.find(lanes, total, offset) == codes).all()


def test_a_header_stream_is_read_a_few_reads_at_once(spark):
    from strandmill.operators import streams

    n = streams.SOME + 77
    metas = [(2 * i + 5, f"@{('ab', 'cdé', '')[i % 3]}{i} {i % 7}:w{i % 3}#{i * i % 1013}") for i in range(n)]
    reads = spark.createDataFrame(metas, "read_id long, meta string")
    stream = streams.metadata_stream(reads, rows_per_part=5 * streams.SOME)  # parts with gaps, one of more reads than are decoded at once
    assert stream.where("part > 0").selectExpr("max(entries)").first()[0] > streams.SOME
    assert sorted(map(tuple, streams.metadata_read(stream).collect())) == metas


def test_tasks_of_a_header_stream_grow_with_its_parts(spark):
    from strandmill.operators import streams

    reads = spark.range(0, 4000).selectExpr("id as read_id", "concat('@a', id % 5, ':', id) as meta")
    few, many = (streams.metadata_stream(reads, rows_per_part=k).rdd.getNumPartitions() for k in (4000, 1))
    assert many >= 4000 // streams.PARTS > few


def test_a_model_counts_symbols_in_batches(spark):
    from strandmill.operators import quality

    quals = spark.createDataFrame([(i, q) for i, q in enumerate(["HHH#", None, "", "G" * 130, "~I"] * 9)], "read_id long, qual string")
    assert sorted(quality.model(quals).collect()) == sorted(quality.cumulative(quality.symbols(quals)).collect())


@pytest.mark.parametrize("name", ["archive_roundtrip", "read_roundtrip"])
def test_reads_of_round_trips_are_coded_by_all_cores(spark, monkeypatch, name):
    from strandmill.plans import queries

    class Seen(Exception):
        pass

    def seen(rows, label):
        raise Seen(rows.rdd.getNumPartitions())

    monkeypatch.setattr(queries, "_stored", lambda *a: {})
    monkeypatch.setattr(queries.shared, "materialize", seen)
    with pytest.raises(Seen) as found:
        queries.QUERIES[name](spark, SF)
    assert found.value.args[0] == 4 * spark.sparkContext.defaultParallelism


def test_rounds_of_alignment_go_with_matches(spark, tmp_path, monkeypatch):
    from strandmill.operators import align, blocked

    rng = random.Random(3)
    text = "".join(rng.choices("ACGT", k=1500)) + "A" * 90
    rows = [(b, text[b * 256 : (b + 1) * 256]) for b in range(-(-len(text) // 256))]
    blocked.build(spark.createDataFrame(rows, "block long, bases string"), str(tmp_path / "idx"), 256)
    found = blocked.BlockedIndex.load(spark, str(tmp_path / "idx"), 256)
    reads = [text[a : a + 60] for a in range(0, 1400, 350)] + [text[40:100]] * 20 + ["A" * 60, text[500:529] + "N" + text[530:550], text[:7], "", None]
    reads += [text[300:320] + "ACGTT"[i:] + text[900:930] for i in range(5)]
    table = spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string")
    names, real = [], blocked.materialize
    monkeypatch.setattr(blocked, "materialize", lambda df, name: names.append(name) or real(df, name))
    got = sorted(map(str, blocked.aligned(table, found).collect()))
    assert len(names) < 12  # a table for every triple of the longest read was 20 and more
    assert got == sorted(map(str, align.aligned(table, spark.createDataFrame([(text,)], "ref string")).collect()))
    assert got == sorted(map(str, blocked.aligned(table, found, rounds=5, widest=50).collect()))  # longer ones by single triples
    assert {"state", "walk"} <= set(names)


def test_letters_of_a_text_become_rows_in_all_tasks(spark):
    from pyspark.sql import functions as F

    text = "".join(random.Random(5).choices("ACGT", k=200 * index.SIZE))
    whole, blocks = _both(spark, text)
    for ref in (whole, blocks.coalesce(1)):  # a text's blocks are so few bytes that they come as one task
        seen = index._grams(index._ended(ref), 3).groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()
        assert sum(r.n for r in seen) == len(text) + 1 and len(seen) > spark.sparkContext.defaultParallelism
        assert max(r.n for r in seen) < len(text) / 4


def test_lines_are_read_once_for_their_boundaries(spark):
    from strandmill.sources.fastq import boundaries, to_lines

    lines = ["@a", "AC", "+", "@I", "@b", "", "@", "@@", "", "@c", None, "@d", "II", None, "@e"]
    for order in (range(len(lines)), [0, 1, 2, 4, 6, 9, 11, 14], [14]):  # whole, with gaps, one
        given = {i: lines[i] for i in order}
        table = spark.createDataFrame(list(given.items()), "line_no long, line string")
        wanted = sorted((i, (given.get(i + 1) or ("@" if given.get(i + 1) is None else "")).startswith("@")) for i, s in given.items() if s and s[0] == "@")
        assert sorted(map(tuple, boundaries(table).collect())) == wanted
    plan = boundaries(to_lines(D.order_reads(spark, SF)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("o_custkey") and sum("Relation" in x and "o_orderkey" in x for x in plan.splitlines()) == 1


def test_a_split_is_read_without_a_list_of_files(tmp_path, monkeypatch):
    import itertools

    from strandmill.sources.fasta import FastaReader
    from strandmill.sources.fastq import FastqReader, Split
    from strandmill.streaming.fastq_stream import FastqStreamReader

    n, path = 100, str(tmp_path / "a.fastq")
    records = [f"@r{i} é\nACG\n{'+-'[i % 2]}{'x' * (i % 3)}\nHH{i}\n" for i in range(n)]
    body, starts = "".join(records), [0, *itertools.accumulate(map(len, records))]
    with open(path, "w", encoding="latin-1") as f:
        f.write(body)
    monkeypatch.setattr(FastqReader, "_files", None)  # every task asked for all files, so time went with tasks times files
    for kind in (FastqReader, FastqStreamReader):
        reader = kind({"path": str(tmp_path)})
        rows = [r for a in (0, 999) for r in reader.read(Split(path, a, 999 if not a else len(body)))]
        assert rows == [(path, starts[i], f"@r{i} é", "ACG", "+-"[i % 2], i % 3 > 0, f"HH{i}") for i in range(n)]
        assert list(reader.read(Split(path, len(body), len(body)))) == []
    assert sum(1 for _ in FastaReader({"path": path}).read(Split(path, 0, len(body)))) == 4 * n


QUALITY = [q if q is None else q.replace("é", "~").replace("\n", "!") for q in ODD] + ["".join(random.Random(i).choices("HHHHGGF#E" + "J~" * (i % 5 == 0), k=i * 7 % 230)) for i in range(240)]


class _Rows:
    """A table of one batch, whose tasks run in this process."""

    def __init__(self, *batches):
        self.batches = batches

    def select(self, *names):
        return _Rows(*(b.select([n for n in names if isinstance(n, str)]) for b in self.batches))

    def mapInArrow(self, run, schema):
        return _Rows(*run(iter(self.batches)))


def _calls(work):
    import sys

    seen = []
    sys.setprofile(lambda frame, event, arg: seen.append(1) if event in ("call", "c_call") else None)
    try:
        work()
    finally:
        sys.setprofile(None)
    return len(seen)


@pytest.mark.parametrize("name", ["naive runs", "bit runs", "flagged runs", "huffman", "delta runs", "lzw"])
def test_a_codec_takes_a_batch_and_not_a_read_a_time(name):
    import pyarrow as pa

    from strandmill.operators import legacy

    def calls(times):
        texts = QUALITY * times
        table = _Rows(pa.RecordBatch.from_pydict({"read_id": list(range(len(texts))), "qual": texts}))
        return _calls(lambda: legacy.read(legacy.coded(table, name), name))

    calls(1)  # what is made once
    assert calls(10) < 2 * calls(1)


#: Of the bytes that the codecs of single strings gave, by codec.
BYTES = {"naive runs": "ae8f066aa4d2369b", "bit runs": "e3a68a626cf16c9c", "flagged runs": "e8a3c5f7ac23f0cd", "huffman": "565ce02d62a26b67", "delta runs": "8bcf7c2539de4738", "lzw": "8787db4599474ed3"}


@pytest.mark.parametrize("some, few", [(1 << 19, 16), (400, 3), (1 << 19, 1000)])
def test_codecs_of_a_batch_give_the_bytes_of_single_strings(monkeypatch, some, few):
    import hashlib

    import numpy as np
    import pyarrow as pa

    from strandmill.operators import legacy

    monkeypatch.setattr(legacy, "SOME", some)
    monkeypatch.setattr(legacy, "FEW", few)
    text = pa.array(["", *QUALITY, None])
    for name, codec in legacy.CODECS.items():
        data = codec.packed(text.slice(1))
        assert hashlib.sha256(repr(data.to_pylist()).encode()).hexdigest()[:16] == BYTES[name]
        assert codec.unpacked(data).equals(text.slice(1)) and codec.unpacked(data.slice(3, 50)).equals(text.slice(4, 50))
    codes, ends = legacy.lzw_codes(text.fill_null(""))
    assert [codes[a:b].tolist() for a, b in zip(ends, ends[1:])] == [legacy.lzw_encode(t or "")[0] for t in text.to_pylist()]
    for name in ("flagged runs", "delta runs", "lzw"):
        with pytest.raises(ValueError):  # without their ends
            legacy.CODECS[name].unpacked(pa.array([x[: len(x) // 2] for x in legacy.CODECS[name].packed(pa.array(["HGGGF#" * 40] * 30)).to_pylist()]))
    with pytest.raises(ValueError):
        legacy.lzw_strings(np.array([41, 97]), np.array([0, 2]))


def test_lzw_columns(spark):
    from strandmill.operators import legacy

    quals = spark.createDataFrame(list(enumerate(QUALITY)), "read_id long, qual string")
    assert {r.read_id: (r.codes, r.bits) for r in legacy.lzw(quals).collect()} == {i: legacy.lzw_encode(q or "") for i, q in enumerate(QUALITY)}
    assert {r.read_id: r.qual for r in legacy.lzw_read(legacy.lzw(quals)).collect()} == {i: q or "" for i, q in enumerate(QUALITY)}


def test_all_codecs_read_a_string_once(spark):
    from strandmill.operators import legacy

    quals = spark.createDataFrame(list(enumerate(QUALITY)), "read_id long, qual string")
    found = legacy.read_each(legacy.coded_each(quals))
    assert {(r.read_id, r.codec): r.qual for r in found.collect()} == {(i, c): q for i, q in enumerate(QUALITY) for c in legacy.CODECS}
    from strandmill.plans import queries

    plan = queries.codecs_roundtrip(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in x for x in plan.splitlines()) == 1
