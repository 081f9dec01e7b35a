import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.llm import negatives as N
from strandmill.llm.oracles import OP12_NEGATIVES

SCHEMA = "vec_id long, embedding array<float>, label int, slot int, score string, id string, copies int, vector string"


def plain(rows, positives=5, negatives=5):
    """Results by comparing each anchor with every row."""
    known = []
    for vec_id, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if vec_id is not None and math.fmod(vec_id, 7) == 0:
            label = int(math.fmod(label + 1, 10))
        known.append((vec_id, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out, key = [], lambda t: (-t[0], t[1] is None, t[1] or 0)
    for i, (a, label, v) in enumerate(known):
        if a is None or math.fmod(a, 100) != 0:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), b, c) for j, (b, c, w) in enumerate(known) if j != i]
        for s, p, _ in sorted((t for t in scored if t[2] == label), key=key)[:positives]:
            found = sorted((t for t in scored if t[2] != label and 80 * s <= 100 * t[0] <= 100 * s), key=key)[:negatives]
            out += [(a, p, r, n, s, t) for r, (t, n, _) in enumerate(found, 1)]
    return Counter(out)


def run(spark, rows, **options):
    docs = spark.createDataFrame([(a, v, c, 1, "e", "e", 3, "e") for a, v, c in rows], SCHEMA).repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = N.mined(N.quantised(docs, changed=label), F.col("vec_id") % 100 == 0, **options)
    return Counter(map(tuple, found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def some_rows(seed, n=500, width=6):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(6, width))
    rows = [(int(rng.integers(0, 60) * 50 if rng.random() < 0.2 else rng.integers(-300, 900)), (middles[rng.integers(6)] + 0.2 * rng.normal(size=width)).tolist(), int(rng.integers(0, 12))) for _ in range(n)]
    rows += [(1000 + i, [0.5] * width, i % 3) for i in range(120)] + [(1100, [0.5] * width, 1)] * 9 + [(None, [0.5] * width, 1)] * 2  # ties, equal rows, null ids
    rows += [(100, None, 1), (100, [None] + [1.0] * (width - 1), 1), (200, [float("nan")] * width, 1), (300, [float("inf")] + [0.0] * (width - 1), 2), (400, [1.0] * width, None), (500, [], 1), (600, [1.0, -1.0], 2), (700, [1.0] * (width + 2), 2)]
    return rows


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"tree_rows": 40, "block_rows": 4})])
def test_against_all_pairs(spark, seed, options):
    rows = some_rows(seed)
    found = run(spark, rows, **options)
    assert found == plain(rows) and sum(found.values()) > 100


def test_a_tree_bounds_and_prunes():
    rng = np.random.default_rng(3)
    middles = rng.integers(-200, 200, (20, 8))
    rows = middles[rng.integers(0, 20, 5000)] + rng.integers(-6, 7, (5000, 8))
    tree = N.Tree(np.arange(5000), rng.integers(0, 3, 5000), rows)
    for (start, stop, _, _), c, r, b in zip(tree.nodes, tree.centres, tree.radii, tree.bounds):
        away = np.sqrt(((tree.vectors[start:stop] - c) ** 2).sum(axis=1))
        assert away.max() <= r and (tree.labels[start:stop].min(), tree.labels[start:stop].max(), tree.ids[start:stop].min()) == tuple(b)
    again = N.Tree.read(tree.row(0))
    assert (again.vectors == tree.vectors).all() and (again.nodes == tree.nodes).all() and sorted(again.ids) == list(range(5000))
    q, window = rows[:1], (40_000, 60_000)
    s = N.Search(q, np.array([1]), np.array([0]), np.array([window[0]]), np.array([window[1]]), np.array([N.LOW]), np.array([N.HIGH]), 5, False)
    s.run(again)
    scores = tree.vectors @ q[0]
    good = (tree.labels != 1) & (scores >= window[0]) & (scores <= window[1])
    wanted = sorted(zip(-scores[good], tree.ids[good]))[:5]
    assert [(-a, b) for a, b in zip(s.scores[0], s.ids[0]) if a > N.LOW] == [(a, b) for a, b in wanted]
    assert s.leaves < sum(left < 0 for _, _, left, _ in tree.nodes) / 3
    known = N.Search(q, np.array([1]), np.array([0]), np.array([N.LOW]), np.array([N.HIGH]), np.array([10**9]), np.array([0]), 5, False)
    known.run(again)
    assert known.leaves == 0  # strictly beneath what is known


def test_large_components(spark):
    wide = [(i * 50, [5e6 + i, 1.0], i % 2) for i in range(12)]
    assert run(spark, wide) == plain(wide)
    a = np.array([[2**40, 1]])
    with pytest.raises(ValueError):
        N.products(a, a)
    assert N.products(np.array([[2**30 + 1, 3]]), np.array([[2**30 + 1, 5]])).tolist() == [[(2**30 + 1) ** 2 + 15]]


def test_no_rows_and_no_anchors(spark):
    assert not run(spark, []) and not run(spark, [(1, [1.0, 2.0], 3)]) and not run(spark, [(100, [1.0], 3)])


def test_query_and_sql_on_the_small_tables(spark):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    asked = c.sql(OP12_NEGATIVES)
    found = N.op12_negatives(spark, sf)
    assert sorted(found.columns) == sorted(asked.columns)
    assert Counter(map(tuple, found.select(*asked.columns).collect())) == Counter(asked.fetchall())
