import math
import random

import numpy as np
import pytest

from strandmill.llm.toxicity import ENDS, Model, features, fit, gradient, op1_toxicity, score

SCHEMA = "doc_id long, text string, lang string, score string, predicted int"


def corpus(n, seed):
    rng = random.Random(seed)
    plain = [a + b for a in "bcdfg" for b in ("ana", "olo", "iri", "umu", "ete")]
    bad = ["grumpf", "grumpfed", "zorking", "zorker"]
    texts, labels = [], []
    for _ in range(n):
        toxic = rng.random() < 0.3
        sents = [" ".join(rng.choice(plain) for _ in range(rng.randint(2, 9))) + "." for _ in range(rng.randint(1, 30))]
        if toxic:
            for _ in range(2):
                sents.insert(rng.randrange(len(sents) + 1), f"{rng.choice(plain)} {rng.choice(bad)} {rng.choice(plain)}!")
        texts.append(" ".join(sents))
        labels.append(int(toxic))
    return texts, labels


def plain_score(model, text):
    """Every sentence on its own, without shortcuts."""
    import re

    missed, found, at = 1.0, [], 0
    text = text or ""
    for end in [m.end() for m in ENDS.finditer(text)] + [len(text)]:
        part = text[at:end]
        if end == len(text) and not part.strip():
            break
        z = model.bias + sum(model.weights.get(f, 0) for w in re.findall(r"[^\W_]+", part.lower()) for f in features(w))
        p = 1 / (1 + math.exp(-z))
        missed *= 1 - min(p, 1 - 1e-12)
        if abs(z - model.bias) > 0:
            found.append((at, end))
        at = end
    return 1 - missed, found


def test_labels_of_documents_find_the_sentences(spark):
    texts, labels = corpus(500, 1)
    model = fit(texts[:350], labels[:350])
    held = [(i, t, "x", None, None) for i, t in enumerate(texts) if i >= 350]
    rows = score(spark.createDataFrame(held, SCHEMA), model).collect()
    assert sum((r.score >= 0.5) == labels[r.doc_id] for r in rows) / len(rows) > 0.97
    for r in rows:
        if labels[r.doc_id] and r.score >= 0.5:
            assert r.spans and all("grumpf" in texts[r.doc_id][s.start : s.end] or "zork" in texts[r.doc_id][s.start : s.end] for s in r.spans if s.score > 0.5)


def test_score_is_the_noisy_or():
    model = Model(-3.0, {"bad": 2.0, "wors*": 1.5, "İx": 1.0})
    for text in ("", None, " \n", "bad", "bad. bad! fine", "x\n\ny. bad worse worst.", "Bad?! BAD... no 3.5 worse", "İbad bad. ok", "." * 9, "a\n" * 50 + "worsen"):
        p, n, found = model.score(text)
        wanted, spans = plain_score(model, text)
        assert p == pytest.approx(wanted, abs=1e-12), text
        assert [f[:2] for f in found] == spans, text
    assert model.score("")[0] == 0


def test_one_class_and_no_rows(spark):
    assert fit([], []).score("anything.")[0] < 0.01
    assert fit(["a b"] * 5, [0] * 5).score("a")[0] < 0.01
    assert fit(["a b"] * 5, [1] * 5).score("a")[0] > 0.9
    model = Model(-3.0, {})
    assert score(spark.createDataFrame([], SCHEMA), model).count() == 0
    rows = score(spark.createDataFrame([(None, None, None, None, None), (1, "", "x", "y", 1), (1, "", "x", "y", 1), (2, "w " * 200000, "x", "y", 1)], SCHEMA), model).collect()
    assert [r.score for r in rows][:3] == [0.0] * 3 and len(rows) == 4


def test_every_offending_sentence_is_located(spark):
    text = "Fine one here. So bad here! " * 60
    (r,) = score(spark.createDataFrame([(1, text, "en", None, None)], SCHEMA), Model(-3.0, {"bad": 4.0})).collect()
    assert (r.sentences, r.offending, len(r.spans)) == (120, 60, 60)
    assert all(text[s.start : s.end].strip() == "So bad here!" for s in r.spans) and len({s.start for s in r.spans}) == 60


def test_query(spark):
    rows = op1_toxicity(spark, "/root/testdata/sf0.01").toPandas()
    import zlib

    import duckdb

    labels = duckdb.sql("select doc_id, toxic from '/root/testdata/sf0.01/labels.parquet'").df()
    assert len(rows) == 1000
    assert (rows.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in rows.doc_id]).all()
    both = rows.merge(labels, on="doc_id")
    held = both[both.held_out]
    assert (held.predicted == held.toxic).mean() > 0.9
    assert held.predicted[held.toxic == 1].mean() > 0.8 and held.predicted[held.toxic == 0].mean() < 0.05  # both classes, not the common one alone


def test_gradient_by_finite_differences():
    rng = np.random.default_rng(2)
    document = np.array([0, 0, 1, 2, 2, 2, 3])
    sentence, word = np.repeat(np.arange(7), 3), rng.integers(0, 6, 21)
    y = np.array([1.0, 0.0, 1.0, 0.0])
    w, bias = rng.normal(size=6), -1.0
    loss = lambda w, b: gradient(w, b, word, sentence, document, y)[0]
    _, gw, gb = gradient(w, bias, word, sentence, document, y)
    for i in range(6):
        step = np.eye(6)[i] * 1e-6
        assert abs(gw[i] - (loss(w + step, bias) - loss(w - step, bias)) / 2e-6) < 1e-6
    assert abs(gb - (loss(w, bias + 1e-6) - loss(w, bias - 1e-6)) / 2e-6) < 1e-6


def test_loss_is_that_of_a_plain_noisy_or():
    w, bias, word, sentence, document, y = np.array([2.0, -1.0]), -0.5, np.array([0, 1, 0]), np.array([0, 0, 2]), np.array([0, 0, 1]), np.array([1.0, 0.0])
    p = [1 / (1 + np.exp(-z)) for z in (0.5, -0.5, 1.5)]
    want = (-np.log(1 - (1 - p[0]) * (1 - p[1])) - np.log(1 - p[2])) / 2
    assert abs(gradient(w, bias, word, sentence, document, y)[0] - want) < 1e-12


def test_empty_scores_are_plain_zero():
    for text in (None, "", " "):
        value = Model(-3.0, {"x": 1.0}).score(text)[0]
        assert value == 0 and not np.signbit(value)
