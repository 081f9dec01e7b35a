import math
import random
from collections import Counter, defaultdict

import pytest

from strandmill.llm.mixing import mix, mixed_documents, op5_mixing

SCHEMA = "doc_id long, text string, lang string, source string, size long, total int, n string, target string"


def reshared(sizes, weights=(5, 2, 1), share=1.5):
    """Targets by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        t = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if t[s] > 2 * sizes[s]]
        if not over:
            return t | capped
        capped |= {s: 2.0 * sizes[s] for s in over}


def table(seed=1, n=600):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["hot"] * 6 + ["b", "ä", "Z", None, "tiny"])
        if source == "tiny" and rng.random() < 0.9:
            source = "hot"
        words = rng.choice([0, 1, 3, 10, 40, 200, 900])
        rows.append((i, None if words == 0 else " ".join(["wörd\t"] * words), "en", source, 5, 1, "x", "y"))
    rows += [(7, rows[7][1], "en", rows[7][3], 1, 1, "x", "y")] * 5 + [(None, "a b c", None, "b", None, None, None, None), (8, "x y", "en", "empty", 1, 1, "", "")]
    rows += [(5000 + i, "one two three four", "en", "hot", 1, 1, "", "") for i in range(300)]
    return rows


def test_targets_and_limits(spark):
    rows = table()
    found = mix(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()
    assert len(found) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    wanted, taken, by = reshared(sizes), Counter(), defaultdict(list)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(wanted[r.source])
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
        by[r.source, r.size].append(r.copies)
    for s, t in wanted.items():
        assert abs(taken[s] - t) <= max(4, 0.001 * t), (s, taken[s], t)
    assert all(max(v) - min(v) <= 1 for v in by.values())


def test_rates_follow_the_exponential_tilt(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(1, 300), "en", rng.choice("ab"), 1, 1, "", "") for i in range(3000)]
    found = mix(spark.createDataFrame(rows, SCHEMA)).collect()
    for s in "ab":
        docs = [r for r in found if r.source == s]
        target = docs[0].target
        low, high = -1.0, 1.0
        for _ in range(200):
            lam = (low + high) / 2
            low, high = (lam, high) if sum(r.size * min(2, math.exp(min(5, lam * r.size))) for r in docs) < target else (low, lam)
        for edge in range(0, 300, 100):
            some = [r for r in docs if edge < r.size <= edge + 100]
            expected = sum(min(2, math.exp(lam * r.size)) for r in some)
            assert abs(sum(r.copies for r in some) - expected) < 4


def test_reruns_agree_and_documents_repeat(spark):
    rows = table(2, 200)
    key = lambda r: (str(r.doc_id), r.text_key, r.copies)
    a = mix(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    b = mix(spark.createDataFrame(rows[::-1], SCHEMA).repartition(5)).collect()
    assert sorted(map(key, a)) == sorted(map(key, b))
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    assert Counter(str(r.doc_id) for r in out.collect()) == +Counter(x for r in a for x in [str(r.doc_id)] * r.copies)


def test_rows_that_repeat_often_and_rows_that_differ_elsewhere(spark):
    rows = [(1, "a b c", "en", "s", 1, 1, "", "")] * 2000 + [(1, "a b c", "en", "s", k, 1, "", "") for k in range(2, 9)] + [(k, "w " * k, "en", "t", 1, 1, "", "") for k in range(60)]
    found = []
    for parts, table in ((1, rows), (5, rows[::-1])):
        docs = spark.createDataFrame(table, SCHEMA).repartition(parts)
        taken = sum(r.copies for r in mix(docs).collect() if r.source == "s")
        out = Counter(map(tuple, mixed_documents(docs).collect()))
        assert sum(n for r, n in out.items() if r[3] == "s") == taken
        assert all(n <= 2 for r, n in out.items() if r[4] > 1)
        found.append(out)
    assert found[0] == found[1]
    few = spark.createDataFrame([(1, "a b c", "s")] * 3, "doc_id long, text string, source string")
    assert mixed_documents(few).count() == sum(r.copies for r in mix(few).collect())


@pytest.mark.parametrize("kind", ["int", "string"])
def test_other_types_of_id(spark, kind):
    docs = spark.createDataFrame(table(5, 60), SCHEMA).selectExpr(f"cast(doc_id as {kind}) as doc_id", "text", "source")
    assert mixed_documents(docs).count() == sum(r.copies for r in mix(docs).collect()) > 0


def test_query_on_the_small_tables(spark):
    import re

    import duckdb

    docs = {d: (s, len(re.findall("[^ \t-\r]+", t or ""))) for d, s, t in duckdb.sql("select doc_id, source, text from '/root/testdata/sf0.001/documents.parquet'").fetchall()}
    found = op5_mixing(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.doc_id for r in found) == sorted(docs)
    sizes, taken = Counter(), Counter()
    for s, n in docs.values():
        sizes[s] += n
    wanted = reshared(sizes)
    for r in found:
        s, n = docs[r.doc_id]
        assert r.size == n and r.source_size == sizes[s] and r.target == pytest.approx(wanted[s]) and 0 <= r.taken <= 2 * n and r.taken == r.copies * n
        taken[s] += r.taken
    assert all(abs(taken[s] - t) <= max(4, 0.001 * t) for s, t in wanted.items())


def test_empty_and_wordless(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [(r.size, r.source_size, r.target, r.copies) for r in mix(spark.createDataFrame([(1, None, None, None, 1, 1, "", "")], SCHEMA)).collect()] == [(0, 0, 0.0, 1)]


def test_no_python_in_the_plan(spark):
    plan = mix(spark.createDataFrame(table(3, 50), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
