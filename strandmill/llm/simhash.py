"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint's 32 two-bit segments are mapped to their bit counts (0, 1 or 2).
The Manhattan distance of two such vectors never exceeds the Hamming distance of
the fingerprints, so it is a lower bound. The vector is kept in one long with
each count in unary (0 -> 00, 1 -> 01, 2 -> 11); Manhattan distance is then the
number of differing bits of two such longs.

Grid: the 32 coordinates are cut into ``radius + 3`` blocks. Vectors within
``radius`` agree on at least three whole blocks, so each fingerprint enters one
unit cell for every choice of three blocks (20 cells at radius 3) and an equi-join
on cells meets every pair within reach. The join keeps a pair only in the first
choice on which it agrees, checks the lower bound and then the exact distance,
so its output is exactly the links. Identical fingerprints are joined
before this step, so a group of copies enters as one row; and distinct
fingerprints have a bounded number of neighbours within a fixed radius.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, enclosed, extra_key, materialize
from .components import components

LOW = 0x5555555555555555


#: Bytes whose words are held at a time.
BLOCK = 1 << 18
_WHITE = [bytes([c]) for c in b" \t\n\x0b\x0c\r"]


def _words(data: bytes):
    """Words of a text, some at a time. Only a block that is one word is longer than ``BLOCK`` bytes."""
    at = 0
    while len(data) - at > BLOCK:
        end = at + BLOCK
        cut = max(data.rfind(c, at, end) for c in _WHITE)
        if cut < 0:
            cut = min((k for c in _WHITE if (k := data.find(c, end)) >= 0), default=len(data))
        yield data[at:cut].split()
        at = cut + 1
    yield data[at:].split()


def fingerprint(text: str | None, shingle: int = 3, lower: bool = True) -> int:
    """64-bit SimHash over word shingles, repeats counted; 0 where there are no words. Long texts are hashed in blocks."""
    data = (text or "").encode()
    if lower:
        data = data.lower()  # bytes: only A-Z, and only ASCII white space below
    total, count = np.zeros(64, np.int64), 0
    digest = xxhash.xxh64_intdigest
    kept: list[bytes] = []  # the last words before a block: shingles run over its edge
    for words in _words(data):
        words = kept + words
        n = len(words)
        kept = words[-(shingle - 1) :] if shingle > 1 else []
        if n < shingle:
            continue
        flat = memoryview(b" ".join(words))
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate([[0], ends[: n - shingle] + 1]).tolist()
        part = np.array([digest(flat[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist())], "<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        count += len(part)
    if not count:
        return digest(b" ".join(kept), 42) if kept else 0
    return int(np.packbits(total * 2 > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, lower: bool = True) -> DataFrame:
    """(doc_id, text_key, fp): the signed 64-bit fingerprint of every whole text; null and wordless texts get 0.

    ``text_key`` is a hash of the text that tells rows of one doc_id apart.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "text_key", "fp"]

    def run(batches):
        for batch in arrow_batches(batches, 512, "text", 4 << 20):
            texts = batch.column("text").to_pylist()
            fps = np.array([fingerprint(t, shingle, lower) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(fps)], names=names)

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_key"))
    return texts.mapInArrow(run, f"doc_id {kind}, text_key long, fp long")


def _blocks(n: int) -> list[int]:
    """Bit masks of ``n`` blocks over the 32 two-bit coordinates, as unsigned 64-bit integers."""
    edges = [32 * i // n for i in range(n + 1)]
    return [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b) with a < b for all pairs in column ``fp`` (distinct values) at ``radius`` or fewer differing bits."""
    masks = _blocks(radius + 3)
    cells = []
    for code, chosen in enumerate(combinations(range(len(masks)), 3)):
        mask = _signed(sum(masks[i] for i in chosen))
        skipped = [_signed(masks[i]) for i in range(chosen[-1]) if i not in chosen]
        skipped += [0] * (radius - len(skipped))
        cells.append((code, mask, skipped))
    fp = F.col("fp")
    half = F.shiftrightunsigned(fp, 1)
    unary = (fp.bitwiseOR(half)).bitwiseAND(F.lit(LOW)).bitwiseOR(F.shiftleft(fp.bitwiseAND(half).bitwiseAND(F.lit(LOW)), 1))
    grid = (
        distinct.select("fp", unary.alias("u"))
        .select("fp", "u", F.explode(F.array(*(F.struct(F.lit(c).alias("choice"), F.col("u").bitwiseAND(F.lit(m)).alias("cell")) for c, m, _ in cells))).alias("g"))
        .select("fp", "u", "g.choice", "g.cell")
    )
    # Blocks before the last chosen one that are not chosen must all differ, else an earlier choice has the pair.
    table = F.array(*(F.array(*map(F.lit, s)) for _, _, s in cells))
    x, y = grid.alias("x"), grid.alias("y")
    apart = F.col("x.u").bitwiseXOR(F.col("y.u"))
    first = F.lit(True)
    for j in range(radius):
        skip = F.element_at(F.element_at(table, F.col("x.choice") + 1), j + 1)
        first &= (skip == 0) | (apart.bitwiseAND(skip) != 0)
    close = (F.bit_count(apart) <= radius) & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= radius)
    met = (F.col("x.choice") == F.col("y.choice")) & (F.col("x.cell") == F.col("y.cell"))
    return x.join(y, met & (F.col("x.fp") < F.col("y.fp")) & close & first).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3) -> DataFrame:
    """(doc_id, text_key, fp, component_id, label, links): component_id is the smallest doc_id reachable over links.

    ``label`` names the component by its smallest fingerprint; ``links`` counts the links between the document's fingerprint and other
    fingerprints. Null texts count as wordless (fingerprint 0); documents with a
    null id take part, and a component of nothing but such documents has a null id.
    Repeated rows each get a row. Extra columns of ``docs`` are ignored.
    """
    prints = materialize(fingerprints(docs, shingle), "fingerprints")
    return grouped(prints, radius)


def grouped(prints: DataFrame, radius: int = 3) -> DataFrame:
    """``near_duplicates`` from stored (doc_id, text_key, fp) rows."""
    if "text_key" not in prints.columns:
        prints = prints.withColumn("text_key", F.lit(None).cast("long"))
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    edges = materialize(links(distinct, radius), "links")
    labels = components(edges, "a", "b")  # (node, label) of linked fingerprints only
    both = edges.select(F.col("a").alias("node")).unionAll(edges.select(F.col("b").alias("node")))
    degree = both.groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    named = labels.join(distinct, labels["node"] == distinct["fp"])
    least = named.groupBy("label").agg(F.min("first").alias("least"))
    joined = materialize(named.join(least, "label").join(degree, "node").select(F.col("node").alias("linked"), "label", "least", "links"), "classes")
    classes = distinct.join(joined, distinct["fp"] == joined["linked"], "left").select(F.col("fp").alias("of"), F.coalesce("label", "fp").alias("label"), F.when(F.col("linked").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    return prints.join(classes, prints["fp"] == classes["of"]).select("doc_id", "text_key", "fp", "component_id", "label", "links")


def keep_one(docs: DataFrame, radius: int = 3, shingle: int = 3) -> DataFrame:
    """``docs`` with one document of each component: the one whose id names it.

    Where several rows of a component carry that id, the one with the smallest text
    hash stays; of rows equal in both, the one whose other columns have the smallest hash. A component without any id keeps one row.
    """
    inner, back = enclosed(docs, "doc_id", "text")
    found = near_duplicates(inner, radius, shingle).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    best = found.groupBy("label").agg(F.min(F.struct("doc_id", "text_key")).alias("k"), F.count(F.lit(1)).alias("n"))
    keep = best.groupBy(F.col("k.doc_id").alias("_id"), F.col("k.text_key").alias("_key")).agg(F.max("n").alias("_n"))
    joined = inner.join(keep, inner["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(inner["text"]) == F.col("_key")))
    single = joined.where("_n = 1")
    known = [c for c in inner.columns if c != "_extra"]
    least = F.min_by(F.struct(*known, "_extra"), extra_key(inner)).alias("r")  # combines before the shuffle
    several = joined.where("_n > 1").groupBy("_id", "_key").agg(least).select("r.*")
    return back(single.select(several.columns).unionByName(several))


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "links")
