import random
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from strandmill.llm import simhash
from strandmill.llm.components import components
from strandmill.llm.simhash import fingerprint, grouped, keep_one, links, near_duplicates

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, radius=3):
    """Brute force: (doc_id, fp) -> smallest doc_id reachable."""
    up = {fp: fp for _, fp in prints}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sorted(up), 2):
        if (a ^ b).bit_count() <= radius:
            up[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for d, fp in prints:
        if d is not None:
            least[top(fp)] = min(d, least.get(top(fp), d))
    return sorted(((d, fp, least.get(top(fp))) for d, fp in prints), key=str)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint_matches_the_definition():
    for text in (None, "", " \n\t", "One", "one TWO", "A b c", "a b c d e f g a b c", "Éa éa\x0b\x0cx É", "x " * 5000):
        assert fingerprint(text) == plain(text), text
    assert fingerprint("ABC def") == fingerprint("abc  DEF\n")
    assert fingerprint("É b c") != fingerprint("é b c")


def test_blocks_change_nothing(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "B", "cc", " ", " ", "\n", "\t", "é", " "]) for _ in range(rng.randint(0, 300))) for _ in range(300)] + ["x" * 500, "y" * 50 + " z", "one two", ""]
    for size in (1, 7, 40):
        monkeypatch.setattr(simhash, "BLOCK", size)
        for t in texts:
            assert fingerprint(t) == plain(t), (size, t)


def test_memory_of_long_texts_is_bounded():
    import tracemalloc

    text = "some words " * 1_500_000
    tracemalloc.start()
    fingerprint(text)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 100 << 20  # two copies of the text are 33


def test_rows_equal_in_id_and_text_keep_the_same_one(spark):
    rows = [(d % 3, "same words in all of them" if d % 2 else "others are in these", "en", f"x{d}", d) for d in range(60)] + [(7, "no others here at all", "en", None, None)] * 3
    found = []
    for parts in (1, 3, 8):
        docs = spark.createDataFrame(rows[::-1] if parts == 3 else rows, SCHEMA).repartition(parts)
        found.append(sorted(map(tuple, keep_one(docs).collect())))
        assert len(keep_one(docs.select("doc_id", "text")).collect()) == 3
    assert found[0] == found[1] == found[2] and len(found[0]) == 3


@pytest.mark.parametrize("kind", ["int", "string"])
def test_other_types_of_id(spark, kind):
    docs = spark.createDataFrame([(i, f"text of {i // 2}") for i in range(10, 20)], "doc_id long, text string").selectExpr(f"cast(doc_id as {kind}) as doc_id", "text")
    assert sorted(int(r.doc_id) for r in keep_one(docs).collect()) == [10, 12, 14, 16, 18]


def test_spark_hash_is_the_same_xxhash(spark):
    row = spark.sql("select xxhash64('one two three') h").first()
    assert row.h % (1 << 64) == xxhash.xxh64_intdigest(b"one two three", 42)


def test_links_are_all_pairs_within_the_radius(spark):
    rng = random.Random(7)
    values = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        values.add(x)
        for _ in range(8):
            y = x
            for b in rng.sample(range(64), rng.randint(1, 5)):
                y ^= 1 << b
            values.add(y)
    values |= {0, 1, 3, 7, 15, (1 << 64) - 1}
    wanted = {(min(signed(a), signed(b)), max(signed(a), signed(b))) for a, b in combinations(values, 2) if (a ^ b).bit_count() <= 3}
    found = [tuple(r) for r in links(spark.createDataFrame([(signed(v),) for v in values], "fp long")).collect()]
    assert len(found) == len(set(found))  # each link once
    assert set(found) == wanted and len(wanted) > 100


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5), (None, 3)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()))
    assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def test_classes_match_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randint(0, 99)) for _ in range(rng.randint(1, 300))) for _ in range(60)]
    texts = []
    for t in base:
        texts += [t] * rng.randint(1, 3)
        words = t.split()
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [None, "", " ", "one", "ONE"]
    rows = [(i, t, "en", None, 1) for i, t in enumerate(texts)] + [(None, "x y z", None, None, None), (None, None, None, None, None), (5, texts[5], "en", None, 1)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"fp": F.lit(1), "component_id": F.lit("x"), "label": F.lit(2), "u": F.lit(0)})
    found = sorted([(r.doc_id, r.fp % (1 << 64), r.component_id) for r in near_duplicates(docs).collect()], key=str)
    assert found == classes([(r[0], plain(r[1])) for r in rows])


def test_one_document_of_each_group_stays(spark):
    rows = [(1, "a b c d", "en", "s", 7), (2, "a b c d", "en", "s", 7), (2, "other words are here", "en", "s", 7), (3, "q w e r", "en", "s", 7), (3, "q w e r", "en", "s", 7), (None, "n u l l", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("1", "a b c d"), ("2", "other words are here"), ("3", "q w e r"), ("None", "n u l l")]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(empty).count() == 0
    assert grouped(spark.createDataFrame([], "doc_id long, fp long")).count() == 0


def test_query_matches_brute_force_on_the_small_tables(spark):
    import duckdb

    from strandmill.llm.queries import QUERIES

    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    found = sorted([(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in QUERIES["op10_simhash"](spark, "/root/testdata/sf0.001").collect()], key=str)
    assert found == classes([(d, plain(t)) for d, t in rows])
