"""Quality classifier with supervised subword embeddings.

Words, pairs of neighbouring words, and character n-grams are hashed to rows of an embedding
table. A pair is hashed by the difference of its words' hashes, so pairs of equal words share a row, and
what repetition says of a text is learned like the rest. The n-grams are runs of 3 and 5 bytes of a word with a space on both sides, so they mark its beginning and
end and never cross words. A document is the average of its vectors (the mean of each kind, then over
kinds), a softmax layer scores it, and table and layer are learned together by
stochastic gradient descent in numpy: one document a step, the gradient of its cross entropy,
and Adagrad's step sizes, one for each row of the table.

Averages and softmax are linear before the last exponential, so scoring folds the
layer into the table: one number for each row instead of a vector. Long texts are hashed in
blocks, so memory doesn't grow with them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, enclosed, held_out, training_sample

BITS = 16
RUNS = (3, 5)
#: Bytes that are hashed at a time; a longer word counts as several.
BLOCK = 1 << 18
WHITE = b" \t\n\x0b\x0c\r"
_P = 0x01000193
_INVERSE = pow(_P, -1, 1 << 32)
_SPACE = np.zeros(256, bool)
_SPACE[list(WHITE)] = True
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        steps = np.full(max(n, 1 << 14), base, np.uint32)
        steps[0] = 1
        _POWERS[base] = np.cumprod(steps, dtype=np.uint32)
    return _POWERS[base][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (h ^ (h >> np.uint32(12))) * np.uint32(0x297A2D39)


def _blocks(data: bytes):
    """Parts of at most ``BLOCK`` bytes, cut before white space where there is any."""
    at = 0
    while len(data) - at > BLOCK:
        cut = max(data.rfind(c.to_bytes(), at + 1, at + BLOCK) for c in WHITE)
        end = cut if cut > at else at + BLOCK
        yield data[at:end]
        at = end
    yield data[at:]


def hashed(text: str | None):
    """For each block of a whole text: rows of words, of pairs, and of character n-grams; each kind in its own range of 2**BITS rows."""
    shift = np.uint32(32 - BITS)
    before = np.zeros(0, np.uint32)  # hash of the word before the block
    for block in _blocks((text or "").encode()):
        data = np.frombuffer(b" " + block + b" ", np.uint8)
        n = len(data)
        space = _SPACE[data]
        data = np.where(space, np.uint8(32), data)
        down = _powers(_INVERSE, n)
        total = np.zeros(n + 1, np.uint32)
        np.cumsum((data + np.uint32(1)) * _powers(_P, n), dtype=np.uint32, out=total[1:])
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        first, last = edge[::2], edge[1::2]
        word = (total[last] - total[first]) * down[first]
        words = (_mixed(word) >> shift).astype(np.int64)
        chain = np.concatenate([before, word])
        before = chain[-1:]
        pairs = (_mixed((chain[1:] - chain[:-1]) * np.uint32(0x9E3779B1)) >> shift).astype(np.int64)
        spaces = np.concatenate([[0], np.cumsum(space)])
        runs = []
        for k in RUNS:
            at = np.flatnonzero(spaces[k - 1 : n] == spaces[1 : n - k + 2]) if n >= k else np.zeros(0, np.int64)  # no space inside
            runs.append(_mixed((total[at + k] - total[at]) * down[at] + np.uint32(k)) >> shift)
        yield words, pairs + (1 << BITS), np.concatenate(runs).astype(np.int64) + (2 << BITS)


def averaged(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, shares): the distinct rows of a text and their shares in its average; nothing for an empty text."""
    kinds = [k for k in map(np.concatenate, zip(*hashed(text))) if len(k)]
    rows, shares = [], []
    for k in kinds:
        r, c = np.unique(k, return_counts=True)
        rows.append(r)
        shares.append(c / (len(k) * len(kinds)))
    if not kinds:
        return np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(rows), np.concatenate(shares)


def gradient(shares: np.ndarray, vectors: np.ndarray, layer: np.ndarray, bias: np.ndarray, label: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(loss, its gradients by vectors, layer and bias): cross entropy of one document with these rows of the table."""
    h = shares @ vectors
    z = h @ layer + bias
    z = z - z.max()
    p = np.exp(z)
    p /= p.sum()
    loss = -float(np.log(max(p[label], 1e-30)))
    p[label] -= 1
    return loss, np.outer(shares, layer @ p), np.outer(h, p), p


def fit(texts: list[str], labels: list[int], dims: int = 8, steps: int = 12_000, rate: float = 0.2, seed: int = 1) -> tuple[np.ndarray, float]:
    """(weights, bias): the folded model after about ``steps`` steps (whole epochs, one at least), whose sizes fall to 0.

    The same input gives the same model; without labels it says 0.5.
    """
    if not labels:
        return np.zeros(3 << BITS, np.float32), 0.0
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.05, (3 << BITS, dims)).astype(np.float32)
    layer = rng.normal(0, 0.5, (dims, 2)).astype(np.float32)
    share = np.clip(np.mean(labels), 0.01, 0.99)
    bias = np.array([0.0, np.log(share / (1 - share))], np.float32)
    squares, layer_squares, bias_squares = np.full(3 << BITS, 1e-8, np.float32), 1e-2, 1e-2
    docs = [(r.astype(np.int32), c.astype(np.float32)) for r, c in map(averaged, texts)]
    epochs = max(1, round(steps / len(docs)))
    done = 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            rows, shares = docs[i]
            lr = np.float32(rate * (1 - done / (epochs * len(docs))))
            done += 1
            vectors = table[rows]
            _, by_vectors, by_layer, by_bias = gradient(shares, vectors, layer, bias, labels[i])
            sums = squares[rows] + np.einsum("ij,ij->i", by_vectors, by_vectors)
            squares[rows] = sums
            table[rows] = vectors - (lr / np.sqrt(sums))[:, None] * by_vectors
            layer_squares += float((by_layer**2).sum())
            bias_squares += float((by_bias**2).sum())
            layer -= lr / np.sqrt(layer_squares) * by_layer
            bias -= lr / np.sqrt(bias_squares) * by_bias
    return (table @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def probability(text: str | None, weights: np.ndarray, bias: float) -> float:
    sums, counts = np.zeros(3), np.zeros(3, np.int64)
    for block in hashed(text):
        for i, rows in enumerate(block):
            sums[i] += weights[rows].sum(dtype=np.float64)
            counts[i] += len(rows)
    some = counts > 0
    z = bias + (float((sums[some] / counts[some]).mean()) if some.any() else 0.0)
    return float(1 / (1 + np.exp(-z)))


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """(row of ``docs``, score): every input column and the probability of label 1 as ``_score``.

    Null and empty texts get the bias alone; rows that repeat or share a doc_id are scored each by its own text.
    ``keep_good`` takes extra columns of any names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 3 * 2**BITS numbers
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("_score", T.DoubleType())])

    def run(batches):
        weights, bias = shared.value
        for batch in arrow_batches(batches, 512, "text", 4 << 20):
            scores = [probability(t, weights, bias) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*names, "_score"])

    return docs.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, limit: int = 4000, longest: int = 20_000) -> tuple[np.ndarray, float]:
    """A model from at most ``limit`` labelled documents of at most ``longest`` characters, none held out."""
    rows = training_sample(docs, labels, "quality", limit, longest)
    return fit([r[1] for r in rows], [r[2] for r in rows])


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """``docs`` without the rows that score below ``least``."""
    inner, back = enclosed(docs, "doc_id", "text")
    return back(score(inner, train(docs, labels)).where(F.col("_score") >= least))


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = score(docs.select("doc_id", F.col("text").cast("string").alias("text")), model)
    return found.select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.3).cast("int").alias("predicted"))
