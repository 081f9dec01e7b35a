"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or.

Only documents carry labels. A document is a bag of sentences; sentence j scores
p_j = sigmoid(bias + weights of its words) and the document 1 - prod(1 - p_j). The weights
are learned from document labels by gradient steps on the likelihood of that noisy-or,
with an L1 penalty, so that few words keep a weight. The same sentence scores then
locate what is offensive.

Only words with a weight matter in scoring, so sentences without one share one score.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, held_out, training_sample

WORDS = re.compile(r"[^\W_]+")
#: A sentence ends after . ! or ? before white space, and at a line feed; blank ones don't count.
ENDS = re.compile(r"[.!?]+(?=\s)|(?<=[^\s.!?])[^\S\n]*\n")


def features(word: str) -> list[str]:
    """A lower-case word, and its beginnings (marked by *), which its inflected forms share."""
    return [word, *(word[:n] + "*" for n in (4, 6) if len(word) > n)]


class _Known(dict):
    """Weight of each word seen, 0 where it has none; forgotten as a whole when it grows too large."""

    def __init__(self, weights: dict[str, float], size: int = 200_000):
        super().__init__()
        self.weights, self.size = weights, size

    def __missing__(self, word):
        if len(self) >= self.size:
            self.clear()
        self[word] = w = sum(self.weights.get(f, 0.0) for f in features(word))
        return w


class Model:
    """``bias`` and the ``weights`` of words and word beginnings."""

    def __init__(self, bias: float, weights: dict[str, float]):
        self.bias, self.weights, self.known = bias, weights, _Known(weights)

    def __reduce__(self):
        return Model, (self.bias, self.weights)

    def sentences(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of sentences, and (start, end, score) of those that hold a word with a weight, in order."""
        text = text or ""
        ends = [m.end() for m in ENDS.finditer(text)]
        if text[ends[-1] if ends else 0 :].strip():
            ends.append(len(text))
        lowered = text.lower()
        known = self.known.__getitem__
        active = {w for w in set(WORDS.findall(lowered)) if known(w)}
        logits: dict[int, float] = {}
        if active:
            at = 0
            if len(lowered) == len(text):
                hits = ((m.start(), m[0]) for m in WORDS.finditer(lowered))
            else:  # lower case moves positions
                hits = ((b, w) for b, e in zip([0, *ends], ends) for w in WORDS.findall(text[b:e].lower()))
            for start, w in hits:
                if w in active:
                    while at < len(ends) - 1 and ends[at] <= start:
                        at += 1
                    logits[at] = logits.get(at, self.bias) + known(w)
        found = [(ends[j - 1] if j else 0, ends[j], float(1 / (1 + np.exp(-z)))) for j, z in sorted(logits.items())]
        return len(ends), found

    def score(self, text: str | None) -> tuple[float, int, list[tuple[int, int, float]]]:
        """Noisy-or over the text's sentences; an empty text has none and scores 0."""
        n, found = self.sentences(text)
        plain = float(np.log1p(-1 / (1 + np.exp(-self.bias))))
        missed = (n - len(found)) * plain + sum(np.log1p(-min(p, 1 - 1e-12)) for *_, p in found)
        return float(-np.expm1(missed)) + 0.0, n, found  # never -0.0


def gradient(w: np.ndarray, bias: float, word: np.ndarray, sentence: np.ndarray, document: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, float]:
    """(mean loss, its gradient by weights, by bias): the negative log likelihood of labels ``y`` under noisy-or.

    ``word`` and ``sentence`` pair each feature with its sentence, ``document`` gives each sentence's document.
    """
    z = bias + np.bincount(sentence, w[word], len(document))
    soft, p = np.logaddexp(0, z), 1 / (1 + np.exp(-z))
    s = np.maximum(np.bincount(document, soft, len(y)), 1e-9)  # -log of no sentence being offensive
    loss = np.where(y == 1, -np.log(-np.expm1(-s)), s).mean()
    outer = np.where(y == 1, -1 / np.expm1(s), 1.0) / len(y)
    g = outer[document] * p
    return float(loss), np.bincount(word, g[sentence], len(w)), float(g.sum())


def fit(texts: list[str], labels: list[int], least_documents: int = 4, common: float = 0.1, l1: float = 3e-5, rounds: int = 200, rate: float = 0.3) -> Model:
    """Weights and bias from documents and 0/1 labels; one class only gives a constant model.

    Features of fewer than ``least_documents`` documents take no part, nor do those in over a
    part ``common`` of the documents (or over the part of positives, if that is more): they
    tell languages apart, not labels. Full-batch Adam with a proximal L1 step; the same input
    gives the same model.
    """
    positive = sum(labels)
    if not labels or positive in (0, len(labels)):
        return Model(-20.0 if not positive else 5.0, {})
    ids: dict[str, int] = {}
    word, sizes, document = array("i"), array("i"), array("i")
    for d, text in enumerate(texts):
        for s in re.split(r"(?<=[.!?])\s|\n", text.lower()):
            bag = {ids.setdefault(f, len(ids)) for w in set(WORDS.findall(s)) for f in features(w)}
            if bag:
                word.extend(sorted(bag))
                sizes.append(len(bag))
                document.append(d)
        if not document or document[-1] != d:  # a wordless text is one sentence without features
            sizes.append(0)
            document.append(d)
    word, document = np.array(word, np.int32), np.array(document, np.int32)
    sentence = np.repeat(np.arange(len(document), dtype=np.int32), sizes)
    pairs = np.unique(word.astype(np.int64) * len(texts) + document[sentence])
    seen = np.bincount(pairs // len(texts), minlength=len(ids))
    del pairs
    useful = (seen >= least_documents) & (seen <= max(common, positive / len(labels)) * len(labels))
    known = {f: i for i, f in enumerate(sorted(f for f, j in ids.items() if useful[j]))}
    place = np.full(len(ids), -1, np.int32)
    for f, i in known.items():
        place[ids[f]] = i
    del ids
    word = place[word]
    sentence, word = sentence[word >= 0], word[word >= 0]
    y = np.array(labels, float)
    w, bias = np.zeros(len(known)), -6.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, rounds + 1):
        _, gw, gb = gradient(w, bias, word, sentence, document, y)
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        lr = rate * min(1.0, 2 - 2 * step / rounds)
        scale = lr / (np.sqrt(v / (1 - 0.99**step)) + 1e-5)
        w = w - scale * m / (1 - 0.9**step)
        w = np.sign(w) * np.maximum(np.abs(w) - scale * l1, 0)
        bias = min(-2.0, bias - lr * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-8))
    return Model(float(bias), {k: float(w[i]) for k, i in known.items() if abs(w[i]) > 0.05})


def score(docs: DataFrame, model: Model, offensive: float = 0.25) -> DataFrame:
    """(doc_id, score, sentences, offending, spans) for every row.

    ``offending`` counts the sentences that score at least ``offensive``; ``spans`` are the
    character ranges and scores of all of them, in order of position.
    Null and empty texts score 0; rows that repeat or share a doc_id are scored each by its own text.
    No other column is read, so extra ones may have any names.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand words

    def run(batches):
        model = shared.value
        for batch in arrow_batches(batches, 512, "text", 4 << 20):
            scores, counts, bad, spans = [], [], [], []
            for text in batch.column("text").to_pylist():
                p, n, found = model.score(text)
                found = [f for f in found if f[2] >= offensive]
                scores.append(p)
                counts.append(n)
                bad.append(len(found))
                spans.append([dict(zip(("start", "end", "score"), f)) for f in found])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array(counts, pa.int64()), pa.array(bad, pa.int64()), pa.array(spans, pa.list_(span))], names=["doc_id", "score", "sentences", "offending", "spans"])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, score double, sentences long, offending long, spans array<struct<start: long, end: long, score: double>>")


def train(docs: DataFrame, labels: DataFrame, limit: int = 4000, longest: int = 50_000) -> Model:
    """A model from at most ``limit`` labelled documents of at most ``longest`` characters, none held out."""
    rows = training_sample(docs, labels, "toxic", limit, longest)
    return fit([r[1] for r in rows], [r[2] for r in rows])


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = score(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "sentences", "offending", "spans")
