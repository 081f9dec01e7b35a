import random
import zlib

import numpy as np
import pytest

from strandmill.llm import quality as q

SCHEMA = "doc_id long, text string, lang string, score string, _x int"


def plain_rows(text):
    """The same rows without vectorised hashing."""
    data = (text or "").encode()
    m = 1 << 32

    def poly(bs):
        return sum((b + 1) * pow(0x01000193, i, m) for i, b in enumerate(bs)) % m

    def mixed(h):
        h = (h ^ (h >> 15)) * 0x2C1B3C6D % m
        return (h ^ (h >> 12)) * 0x297A2D39 % m

    white = b" \t\n\x0b\x0c\r"
    data = b" " + bytes(32 if c in white else c for c in data) + b" "
    words = [poly(w) for w in data.split()]
    shift = 32 - q.BITS
    pairs = [mixed((b - a) * 0x9E3779B1 % m) >> shift for a, b in zip(words, words[1:])]
    runs = [mixed((poly(data[i : i + k]) + k) % m) >> shift for k in q.RUNS for i in range(len(data) - k + 1) if 32 not in data[i + 1 : i + k - 1]]
    return [mixed(w) >> shift for w in words], [p + (1 << q.BITS) for p in pairs], [r + (2 << q.BITS) for r in runs]


def rows_of(text):
    return tuple(np.concatenate(k).tolist() for k in zip(*q.hashed(text)))


TEXTS = (None, "", " ", "a", "ab", "abc", "one one two", "é ü\tß\n x", "word " * 300, "\x0b\x0c a", "a\x1cb\x00 c\xa0d", "  lead and trail \n")


def test_rows_match_the_definition(monkeypatch):
    for text in TEXTS:
        assert rows_of(text) == plain_rows(text), text
    monkeypatch.setattr(q, "BLOCK", 7)  # words of up to 6 bytes stay whole
    for text in ("one one two three", " a b c d e f g h i j", "long\n\n\n\n\n\n\n\n\n\nblank end", *TEXTS[:9]):
        assert sorted(map(sorted, rows_of(text))) == sorted(map(sorted, plain_rows(text))), text


def test_gradient_by_finite_differences():
    rng = np.random.default_rng(4)
    for label in (0, 1):
        shares, vectors, layer, bias = rng.random(5), rng.normal(size=(5, 3)), rng.normal(size=(3, 2)), rng.normal(size=2)
        shares /= shares.sum()
        _, *found = q.gradient(shares, vectors, layer, bias, label)
        for place, (x, g) in enumerate(zip((vectors, layer, bias), found)):
            for at in np.ndindex(x.shape):
                sides = []
                for step in (1e-6, -1e-6):
                    moved = [vectors.copy(), layer.copy(), bias.copy()]
                    moved[place][at] += step
                    sides.append(q.gradient(shares, *moved, label)[0])
                assert g[at] == pytest.approx((sides[0] - sides[1]) / 2e-6, abs=1e-6)


def test_training_lowers_the_loss_of_unfolded_vectors():
    texts, labels = ["good text here", "bad bad bad bad", "fine words too", "no no no"] * 5, [1, 0, 1, 0] * 5
    weights, bias = q.fit(texts, labels, steps=400)
    for text, y in zip(texts, labels):
        rows = plain_rows(text)
        z = bias + float(np.mean([np.mean([float(weights[r]) for r in k]) for k in rows if k]))
        assert (1 / (1 + np.exp(-z)) > 0.5) == y and q.probability(text, weights, bias) == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


def test_folding_equals_the_average_of_vectors():
    rng = np.random.default_rng(3)
    weights = rng.normal(size=3 << q.BITS).astype(np.float32)
    for text in ("one two two three", "x", "", "long text here " * 50):
        rows, shares = q.averaged(text)
        assert np.isclose(shares.sum(), 1 if len(rows) else 0)
        assert q.probability(text, weights, 0.3) == pytest.approx(1 / (1 + np.exp(-(0.3 + float(weights[rows].astype(float) @ shares)))), abs=1e-6)


def test_learns_from_labels():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]

    def text(good):
        w = [rng.choice(words) for _ in range(rng.randint(10, 200))]
        if good:
            return " ".join(w) + "."
        return rng.choice([" | ".join(w), " ".join(x for x in w[:10] for _ in range(9)), " ".join(w).upper()])

    labels = [int(rng.random() < 0.7) for _ in range(500)]
    texts = [text(y) for y in labels]
    model = q.fit(texts[:400], labels[:400])
    right = [(q.probability(t, *model) >= 0.5) == y for t, y in zip(texts[400:], labels[400:])]
    assert np.mean(right) > 0.95
    again = q.fit(texts[:400], labels[:400])
    assert (model[0] == again[0]).all() and model[1] == again[1]


def test_odd_tables(spark):
    model = q.fit(["a", "b"], [1, 0])
    assert q.score(spark.createDataFrame([], SCHEMA), model).count() == 0
    rows = [(None, None, None, None, None), (1, "", "x", "y", 1), (1, "", "x", "y", 1), (2, "w " * 200000, "x", "y", 1)]
    found = q.score(spark.createDataFrame(rows, SCHEMA), model).collect()
    assert len(found) == 4 and all(0 <= r._score <= 1 for r in found)
    assert q.fit([], [])[1] == 0 and q.probability("x", *q.fit([], [])) == 0.5
    assert q.probability("x", *q.fit(["a"] * 3, [1] * 3)) > 0.5


def test_memory_of_long_texts_is_bounded():
    import tracemalloc

    weights = np.zeros(3 << q.BITS, np.float32)
    text = "some words " * 2_000_000  # 22 MB
    tracemalloc.start()
    q.probability(text, weights, 0.0)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 100 << 20


def test_sample_does_not_depend_on_the_order_of_rows(spark):
    from strandmill.llm.common import training_sample

    docs = [(i % 20, f"text {i}") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    found = [training_sample(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), labels, "quality", 100, 1000) for rows, n in ((docs, 1), (docs[::-1], 3))]
    assert found[0] == found[1] and len(found[0]) == len({r[0] for r in found[0]})


@pytest.mark.parametrize("kind", ["int", "string"])
def test_other_types_of_id(spark, kind):
    docs = spark.createDataFrame([(i, "one two three" if i % 2 else "bad bad bad") for i in range(40)], "doc_id long, text string").selectExpr(f"cast(doc_id as {kind}) as doc_id", "text")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int").selectExpr(f"cast(doc_id as {kind}) as doc_id", "quality")
    kept = q.keep_good(docs, labels, 0.5)
    assert kept.schema == docs.schema and {int(r.doc_id) % 2 for r in kept.collect()} == {1}


def test_query(spark):
    import duckdb

    rows = q.op3_quality(spark, "/root/testdata/sf0.01").toPandas()
    labels = duckdb.sql("select doc_id, quality from '/root/testdata/sf0.01/labels.parquet'").df()
    assert len(rows) == 1000
    assert (rows.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in rows.doc_id]).all()
    held = rows.merge(labels, on="doc_id")
    held = held[held.held_out]
    assert (held.predicted == held.quality).mean() > 0.9
    assert held.predicted[held.quality == 1].mean() > 0.95 and held.predicted[held.quality == 0].mean() < 0.35  # both classes, not the common one alone
    weights, bias = q.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    texts = dict(duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet' where length(text) < 1500 order by doc_id limit 60").fetchall())
    for d, score in zip(rows.doc_id, rows.score):
        if d in texts:
            z = bias + float(np.mean([np.mean(weights[k].astype(float)) for k in plain_rows(texts[d]) if k] or [0]))
            assert score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)
