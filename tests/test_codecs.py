"""Round trips, edge cases and golden vectors of the codecs and functions."""

import random

import pytest
from pyspark.sql import functions as F

from strandmill.functions import bases, fields
from strandmill.operators import align, index, legacy, metadata, quality

QUALS = ["", "H", "HH", "H" * 60, "H" * 61, "H" * 62, "H" * 121, "H" * 122, "H" * 100, "@@A", "!I" * 40, "A" + "B" * 61 + "A"]


def table(spark, values, name="qual"):
    return spark.createDataFrame(list(enumerate(values)), f"read_id long, {name} string")


def plain_symbols(q):
    out, at = [], 0
    while at < len(q):
        n = 1
        while at + n < len(q) and q[at + n] == q[at]:
            n += 1
        out.append(ord(q[at]) - 33)
        rest = n - 1
        out += [187] * (rest // 60) + ([127 + rest % 60] if rest % 60 else [])
        at += n
    return out


def test_symbols(spark):
    got = {}
    for r in quality.symbols(table(spark, QUALS)).orderBy("read_id", "ord").collect():
        got.setdefault(r.read_id, []).append(r.symbol)
    assert got == {i: plain_symbols(q) for i, q in enumerate(QUALS) if q}
    assert got[QUALS.index("H" * 100)] == [39, 187, 166]
    assert {r.read_id: r.qual for r in quality.unsymbol(quality.symbols(table(spark, QUALS))).collect()} == {i: q for i, q in enumerate(QUALS) if q}


def test_arithmetic_coder():
    rng = random.Random(1)
    cum = [0]
    for i in range(quality.SYMBOLS):
        cum.append(cum[-1] + (5000 if i == 39 else 1 + i % 7))
    for n in (0, 1, 2, 50, 2000):
        codes = [39 if rng.random() < 0.8 else rng.randrange(188) for _ in range(n)]
        data = quality.arithmetic_encode(codes, cum)
        assert quality.arithmetic_decode(data, cum) == codes
    assert len(quality.arithmetic_encode([39] * 8000, cum)) < 500


def test_arithmetic_columns(spark):
    quals = table(spark, [q for q in QUALS if q])
    cum = quality.smoothed(quality.cumulative(quality.symbols(quals)))
    coded = quality.arithmetic_code(quals, cum)
    assert {r.read_id: r.qual for r in quality.arithmetic_read(coded, cum).collect()} == dict(enumerate(q for q in QUALS if q))


def test_lzw():
    rng = random.Random(2)
    for text in ["", "A", "AAAA", "ABABABA", *("".join(rng.choice("#GHI") for _ in range(rng.randint(1, 400))) for _ in range(50))]:
        codes, bits = legacy.lzw_encode(text)
        assert legacy.lzw_decode(codes) == text and bits >= 6 * len(codes)
    with pytest.raises(ValueError):
        legacy.lzw_encode("é")


def test_every_codec_gives_strings_back(spark):
    rng = random.Random(7)
    texts = ["", "H", "#" * 500, "".join(map(chr, range(33, 127))), *("".join(rng.choice("HHHHGFI#!J~") * rng.randint(1, 90) for _ in range(rng.randint(1, 12))) for _ in range(80))]
    for name, codec in legacy.CODECS.items():
        for t in texts:
            assert codec.decode(codec.encode(t)) == t, (name, t)
    t = table(spark, texts)
    found = {r.codec: r for r in legacy.benchmark(t).collect()}
    assert found.keys() == legacy.CODECS.keys() and all(r.bytes > 0 and r.encode_seconds > 0 for r in found.values())
    plain = [x for x in texts if x and all(c in legacy.HUFFMAN for c in x)]
    sizes = {r.read_id: r for r in legacy.huffman_size(table(spark, plain)).collect()}
    assert all(len(legacy.huffman_encode(x)) == 1 + sizes[i].bytes for i, x in enumerate(plain))
    bits = {r.read_id: r.bits for r in legacy.delta_run_size(table(spark, plain)).collect()}
    assert all(len(legacy.delta_encode(x)) == 1 + -(-bits[i] // 8) for i, x in enumerate(plain))
    assert {r.read_id: r.bytes for r in legacy.naive_run_size(t).collect()} == {i: len(legacy.naive_encode(x)) for i, x in enumerate(texts) if x}


def test_symbols_stay_in_their_rows(spark):
    t = table(spark, QUALS)
    cum = quality.smoothed(quality.cumulative(quality.symbols(t)))
    for found in (quality.arithmetic_code(t, cum), legacy.naive_run_size(t), legacy.bit_run_size(t), legacy.flagged_run_size(t), legacy.huffman_size(t), legacy.delta_run_size(t)):
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_huffman_code_is_prefix_free_and_compact(spark):
    codes = sorted(legacy.HUFFMAN.values())
    assert len(codes) == 38 and not any(b.startswith(a) for a, b in zip(codes, codes[1:]))
    assert sum(2.0 ** -len(c) for c in codes) == 1
    rows = {r.read_id: r.bits for r in legacy.huffman_size(table(spark, ["HHG", "!"])).collect()}
    assert rows == {0: 5, 1: 22}


def test_run_sizes(spark):
    t = table(spark, ["a" * 11 + "b" * 15 + "c" * 23 + "abac" + "c" * 13, "x" * 300])
    assert {r.read_id: r.bytes for r in legacy.naive_run_size(t).collect()} == {0: 14, 1: 6}
    assert {r.read_id: r.bits for r in legacy.bit_run_size(t).collect()} == {0: 10 * 8 + 6, 1: 10 * 20 + 6}


@pytest.mark.parametrize("seq", ["A", "AC", "ACG", "ACGT" * 25, "ACGTN" * 20, "G" * 99, ""])
def test_reverse_complement(spark, seq):
    row = spark.createDataFrame([(seq,)], "s string").select(bases.revcomp(F.col("s")).alias("a"), bases.revcomp(F.col("s"), True).alias("b"), bases.revcomp(bases.revcomp(F.col("s"), True), True).alias("c")).first()
    full = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert row.a == full and row.c == seq
    m = len(seq) // 2
    assert row.b == (full[:m] + seq[m] + full[m + 1 :] if len(seq) % 2 else full)


def test_triples(spark):
    rows = spark.range(64).select("id", bases.triple_of(F.col("id")).alias("t")).select("id", "t", bases.triple_code(F.col("t")).alias("c")).collect()
    assert all(r.id == r.c for r in rows) and rows[27].t == "CGT"
    assert [r.c for r in spark.createDataFrame([("ACN",), ("AC",), (None,), ("ACGT",)], "t string").select(bases.triple_code(F.col("t")).alias("c")).collect()] == [None] * 4


def test_fields(spark):
    header = "@ERR161544.3 B81CBVABXX:5:1:1216:2238#CNNNNNNN/1"
    row = spark.createDataFrame([(header,)], "h string").select(fields.tokens(F.col("h")).alias("t"), fields.separators(F.col("h")).alias("s")).first()
    assert row.t == ["ERR161544", "3", "B81CBVABXX", "5", "1", "1216", "2238", "CNNNNNNN/1"] and row.s == ". ::::#"
    assert spark.createDataFrame([("@a..b:",)], "h string").select(fields.tokens(F.col("h"))).first()[0] == ["a", "", "b", ""]
    values = ["0", "7", "007", "+5", "-3", "2147483648", "", "1a", "9" * 18, "9" * 19]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(fields.is_numeric(F.col("v")).alias("a"), fields.is_numeric(F.col("v"), True).alias("b")).collect()
    assert [r.a for r in rows] == [True, True, False, False, False, True, False, False, True, False]
    assert [r.b for r in rows] == [True] * 6 + [False, False, True, True]


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 100, 1500])
def test_chunks(spark, n):
    rows = spark.range(n).select("id", fields.chunk_of(F.col("id"), F.lit(n)).alias("c")).collect()
    for r in rows:
        assert n * r.c // 16 <= r.id < n * (r.c + 1) // 16


def test_metadata_round_trip_on_odd_fields(spark):
    metas = [f"@run.{i + 5} {'' if i % 3 else 'x'}:{i * 7}:00{i % 4}#{'abc'[i % 3]}.{2**31 + i}" for i in range(400)]
    reads = table(spark, metas, "meta")
    kinds = {r.field: r for r in metadata.schema(reads).collect()}
    assert [kinds[i].type for i in range(7)] == ["CONST", "AUTOINC", "ALPHA", "NUMERIC", "ALPHA", "ALPHA", "AUTOINC"]
    assert kinds[5].mapped and kinds[1].low == 5
    assert {r.read_id: r.meta for r in metadata.decoded(reads).collect()} == dict(enumerate(metas))


@pytest.mark.parametrize("distinct, mapped", [(3, True), (4, False)])
def test_dictionary_rule_at_its_edge(spark, distinct, mapped):
    reads = table(spark, [f"@v{chr(97 + i % distinct)}" for i in range(400)], "meta")
    assert metadata.schema(reads).first().mapped == mapped


def test_suffix_array_of_repetitive_text(spark):
    for text in ("A", "ACGT", "A" * 70, "ACAC" * 30, "GATTACA" * 9):
        rows = sorted(map(tuple, index.suffix_array(spark.createDataFrame([(text,)], "ref string"), start=4).collect()))
        s = text + "$"
        assert [p for _, p in rows] == sorted(range(len(s)), key=lambda i: s[i:])


def test_suffix_array_of_a_longer_text(spark):
    """Over several parts and rounds."""
    rng = random.Random(9)
    text = "".join(rng.choice("ACGT") for _ in range(9000)) + "ACGTTGCA" * 60
    rows = sorted(map(tuple, index.suffix_array(spark.createDataFrame([(text,)], "ref string"), start=8).collect()))
    s = text + "$"
    assert [p for _, p in rows] == sorted(range(len(s)), key=lambda i: s[i:]) and [r for r, _ in rows] == list(range(len(s)))


def plain_greedy(text, seq):
    """The rule on strings: reads from right to left, the greatest suffix among several."""
    suffixes = sorted(range(len(text) + 1), key=lambda i: text[i:] + "$")
    place = lambda s: [p for p in suffixes if text.startswith(s, p)][-1]
    out, at, m = [], len(seq) - len(seq) % 3, len(seq) % 3
    if len(seq) < 3:
        return [(place(seq), len(seq), 64)]
    while at:
        at -= 3
        if seq[at : at + 3 + m] in text:
            m += 3
            if not at:
                out.append((place(seq[:m]), m, 64))
        else:
            out.append((place(seq[at + 3 : at + 3 + m]), m, sum("ACGT".index(c) * w for c, w in zip(seq[at : at + 3], (16, 4, 1)))))
            m = 0
    return out


def test_alignment_matches_the_rule_on_strings():
    rng = random.Random(4)
    text = "".join(rng.choice("ACGT") for _ in range(700))
    fm = index.FmIndex(text)
    seqs = []
    for _ in range(150):
        a = rng.randrange(600)
        s = list(text[a : a + rng.randint(1, 90)])
        for _ in range(rng.randint(0, 3)):
            s[rng.randrange(len(s))] = rng.choice("ACGT")
        seqs.append("".join(s))
    found = align.align_segments(fm, [s.encode() for s in seqs])
    assert found == [plain_greedy(text, s) for s in seqs]


def test_reads_with_n_and_both_strands_come_back(spark):
    rng = random.Random(5)
    text = "".join(rng.choice("ACGT") for _ in range(900))
    seqs = ["N", "NNN", "A", "AC", "ACG", text[:100], text[300:399][::-1].translate(str.maketrans("ACGT", "TGCA")), "NN" + text[5:40] + "N" + text[80:83] + "NNNN", "ACGT" * 25, "", None]
    ref = spark.createDataFrame([(text,)], "ref string")
    for compat in (False, True):
        best = align.best_strand(table(spark, seqs, "seq"), ref, compat)
        rows = {r.read_id: r for r in best.collect()}
        assert rows[6].orn == 1 or compat
        assert {r.read_id: r.seq for r in align.decoded(best, ref, compat).collect()} == {i: s or "" for i, s in enumerate(seqs)}


def test_references_that_lack_bases(spark):
    rng = random.Random(3)
    for text in ("A" * 30, "ACAC" * 9, "A"):
        ref = spark.createDataFrame([(text,)], "ref string")
        seqs = ["", "C", "GT", "TTT", "ACGTA", "N", "GNT", *("".join(rng.choice("ACGTN") for _ in range(rng.randint(1, 20))) for _ in range(60))]
        reads = spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string")
        assert {r.read_id: r.seq for r in align.decoded(align.best_strand(reads, ref), ref).collect()} == dict(enumerate(seqs))


def test_fasta(spark):
    lines = [(0, ">x acgt"), (1, "acgtNNNNN"), (2, "NNNNNNcc"), (3, "NNNNNNNNNN"), (4, "Rg")]
    assert index.normalise(spark.createDataFrame(lines, "line_no long, line string")).first().ref == "ACGT" + "CC" + "G" * 10 + "GG"


def plain_coder(codes, cum, end):
    """The arithmetic coder bit by bit, over whole numbers."""
    low, high, pending, out = 0, 2**32 - 1, 0, []
    for c in (*codes, end):
        span = high - low + 1
        low, high = low + span * cum[c] // cum[-1], low + span * cum[c + 1] // cum[-1] - 1
        while True:
            if high < 2**31 or low >= 2**31:
                bit = int(low >= 2**31)
                out += [bit] + [1 - bit] * pending
                pending, move = 0, bit * 2**31
            elif low >= 2**30 and high < 3 * 2**30:
                pending, move = pending + 1, 2**30
            else:
                break
            low, high = 2 * (low - move), 2 * (high - move) + 1
    bit = int(low >= 2**30)
    out += [bit] + [1 - bit] * (pending + 1)
    out += [0] * (-len(out) % 8)
    return bytes(int("".join(map(str, out[i : i + 8])), 2) for i in range(0, len(out), 8))


@pytest.mark.parametrize("kind", ["even", "skewed", "large"])
def test_lanes_give_the_bytes_of_the_plain_coder(kind):
    import numpy as np

    rng = random.Random(kind)
    freq = [{"even": 1, "skewed": rng.choice([1, 1, 1, 50_000]), "large": rng.randint(1, 2**20)}[kind] for _ in range(189)]
    cum = [0]
    for f in freq:
        cum.append(cum[-1] + f)
    rows = [rng.choices(range(188), freq[:188], k=rng.randint(0, 90)) for _ in range(60)] + [[], [3] * 300, [187] * 40]
    coded = quality.encode_lanes([np.array(r, np.int64) for r in rows], quality.Fixed(cum))
    assert coded == [plain_coder(r, cum, 188) for r in rows]
    assert quality.decode_lanes(coded, quality.Fixed(cum)) == rows
    with pytest.raises(ValueError):
        quality.decode_lanes([b"\x00\x01"], quality.Fixed([0, *range(10**6, 10**6 + 189)]))
    learnt = quality.encode_lanes([np.array(r, np.int64) for r in rows], quality.Adaptive(len(rows), most=2000))
    assert quality.decode_lanes(learnt, quality.Adaptive(len(rows), most=2000)) == rows


def test_adaptive_trees_sum_their_counts():
    import numpy as np

    model, rng = quality.Adaptive(3, 20, 5, 200), random.Random(8)
    for _ in range(150):
        codes = np.array([rng.randrange(20) for _ in range(3)])
        model.seen(np.arange(3), codes)
        asked = np.array([rng.randrange(20) for _ in range(3)])
        lower, upper, total = model.bounds(np.arange(3), asked)
        assert lower.tolist() == [int(model.counts[i, :c].sum()) for i, c in enumerate(asked)] and (upper - lower == model.counts[np.arange(3), asked]).all()
        assert (total == model.counts.sum(axis=1)).all() and (total <= 200).all()


def test_adaptive_code_learns(spark):
    quals = ["HHHHGGGF" * 6, "", None, "#"] + ["HHHHHHGGGG" * k for k in range(1, 40)]
    coded = quality.adaptive_code(table(spark, quals), rows_per_part=16)
    assert {r.read_id: r.qual for r in quality.adaptive_read(coded).collect()} == {i: q for i, q in enumerate(quals) if q}
    assert coded.count() == 3 and quality.adaptive_read(coded.limit(0)).count() == 0


def test_models_of_huge_counts_are_scaled(spark):
    model = spark.createDataFrame([(i, 10**12 if i == 7 else i % 3) for i in range(189)], "symbol int, freq long")
    cum = quality.smoothed(model)
    assert cum[-1] <= quality.MOST and all(b > a for a, b in zip(cum, cum[1:])) and cum[8] - cum[7] > 0.99 * cum[-1]


def test_lzw_bytes_take_the_bits_of_their_codes():
    rng = random.Random(4)
    for text in ("", "H", "HH" * 400, "".join(rng.choice("HGF#") for _ in range(3000))):
        data = legacy.lzw_bytes(text)
        assert legacy.lzw_text(data) == text
        assert abs(len(data) * 8 - legacy.lzw_encode(text)[1]) <= 8
