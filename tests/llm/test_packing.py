import random
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandmill.llm.packing import combinations_filling, nnls, op8_packing, pack, plan, sequences
from strandmill.llm.tokens import default_path

SCHEMA = "doc_id long, text string, lang string, key string, class int"


def test_nnls_meets_the_optimality_conditions():
    rng = np.random.default_rng(0)
    for _ in range(30):
        a = (rng.random((12, 30)) < 0.2).astype(float)
        b = rng.random(12) * 10
        x = nnls(a, b)
        g = a.T @ (b - a @ x)
        assert (x >= 0).all() and (g < 1e-6).all() and abs(g[x > 0]).max(initial=0) < 1e-6


def test_plan_uses_ranks_once():
    assert combinations_filling(4).tolist() == [[2, 1, 1], [2, 2, 0], [3, 1, 0]]
    slots, n, taken = plan({1: 50, 2: 30, 3: 70, 4: 5, 5: 9, 7: 40}, 8)
    by_class = defaultdict(list)
    filled = defaultdict(int)
    for c, low, high, first, each, _ in slots:
        by_class[c] += range(low, high)
        for r in range(low, high):
            filled[first + (r - low) // each] += c
    assert {c: sorted(v) for c, v in by_class.items()} == {c: list(range(v)) for c, v in taken.items()}
    assert set(filled.values()) == {8} and sorted(filled) == list(range(n)) and n > 60
    assert plan({}, 8) == ([], 0, {})


def check(rows, pieces, end_id, window, library, gaps=False):
    wanted = defaultdict(int)
    for d, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [end_id]
        wanted[d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    by_id = defaultdict(set)
    for d, text in rows:
        by_id[d].add(text or "")
    seqs, docs = defaultdict(list), defaultdict(list)
    for p in pieces:
        seqs[p.sequence_id].append((p.offset, p.length))
        docs[p.key].append(p)
    for parts in docs.values():
        parts.sort(key=lambda p: p.start)
        at = 0
        for p in parts:
            assert p.start == at and p.length > 0
            at += p.length
        assert at == parts[0].doc_tokens
        for text in by_id[parts[0].doc_id]:
            ids = np.array(library.encode(text, add_special_tokens=False).ids + [end_id], "<u4")
            if len(ids) == at and all(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in parts):
                break
        else:
            raise AssertionError(parts)
    assert len(docs) == len(rows)
    padding = total = 0
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert gaps or offset == at
            at += length
        assert at <= window
        total += at
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding / max(1, total), len(seqs)


def test_every_id_lies_in_one_piece(spark):
    library = Tokenizer.from_file(default_path())
    rng = random.Random(1)
    words = ["alpha", "beta,", "gamma.\n", "x", "Ünï"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 30, 60, 200, 900])))) for i in range(400)]
    rows += [(None, "no id"), (None, None), (5, rows[5][1]), (5, rows[5][1]), (5, "other"), (9999, None)]
    rows += [(20000 + i, "same text here " * 20) for i in range(200)]  # one class with many pieces
    docs = spark.createDataFrame([(d, t, "en", "k", 1) for d, t in rows], SCHEMA).repartition(5)
    pieces, tokens = pack(docs, end_id=1, window=256, width=8)
    padding, n = check(rows, pieces.collect(), 1, 256, library)
    assert padding < 0.02
    packed = sequences(pieces, tokens, window=256).collect()
    assert len(packed) == n
    assert sum(r.n_ids for r in packed) == pieces.agg(F.sum("length")).first()[0]
    assert all(len(r.ids) == (r.n_ids if r.n_ids & (r.n_ids - 1) == 0 else 256) for r in packed)


def test_lengths_that_no_combination_fills(spark):
    docs = spark.createDataFrame([(i, "word " * 150, "en", "k", 1) for i in range(100)], SCHEMA)
    pieces, _ = pack(docs, window=256)
    padding, _ = check([(i, "word " * 150) for i in range(100)], pieces.collect(), 1, 256, Tokenizer.from_file(default_path()))
    assert padding < 0.02


def test_empty_and_single(spark):
    assert pack(spark.createDataFrame([], SCHEMA))[0].count() == 0
    one = pack(spark.createDataFrame([(3, None, None, None, None)], SCHEMA))[0].collect()
    assert [(r.doc_id, r.start, r.length, r.doc_tokens, r.offset) for r in one] == [(3, 0, 1, 1, 0)]


def test_query_on_the_small_tables(spark):
    import duckdb

    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    found = op8_packing(spark, "/root/testdata/sf0.001").withColumn("key", F.col("doc_id")).collect()
    padding, _ = check(rows, found, 1, 2048, Tokenizer.from_file(default_path()))
    assert padding < 0.02
