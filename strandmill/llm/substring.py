"""Substring dedup over sliding runs of sentences.

A text is cut into sentences, long sentences into pieces at places that their words choose, and
each run of ``run`` consecutive pieces, or as many more as reach ``least`` words, is hashed to
128 bits. Runs are joined over all documents. The document with the smallest doc_id that
holds a run keeps it; in every other document, and at later places of the same
document, the pieces that the run covers are removed.

A sentence ends behind a word that ends in a sentence mark, and at a line feed. Inside a sentence a cut
stands behind each word whose hash is smaller than those of the ``REACH`` words on both sides, all
in the sentence. So equal words get equal cuts but for the outermost few, wherever the passage
stands in its sentence. Stretches without such a word, as where one word repeats, are
cut every ``LONGEST`` words, which bounds every piece. A word is a run of anything but ASCII white space; a letter of a script
without spaces is a word of its own, and that script's marks end sentences.

Each document sends a run once. Hashes are counted with map-side aggregation, so a
run that a third of all documents share is one row a task; the join back to
documents has one row a hash on the other side, and Spark can split its large
partitions.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, drop_table, enclosed, materialize

REACH, LONGEST = 4, 12
#: Base of the hash of a word over its code points, and of a run over its words; odd, so that they have inverses.
BASE, RUN_BASE = 0x1E3779B97F4A7C15, 0x9E3779B97F4A7C15
MIXERS = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
#: Letters of Thai, Lao, Burmese, Khmer, Japanese and Chinese, which put no spaces between words: first and last code points.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))
#: A sentence ends behind a word that ends in a mark, or in a wide mark and a closing quote or bracket.
MARKS, WIDE_MARKS, CLOSERS = ".!?。！？｡", "。！？｡", "」』”’）"
#: Characters that are hashed at a time.
BLOCK = 1 << 19

_SPACE, _LETTER, _MARK, _WIDE, _CLOSER = 1, 2, 4, 8, 16
_KINDS = np.zeros(0x20001, np.uint8)  # of each code point up to 0x20000, which stands for all above
_KINDS[9:14] = _KINDS[32] = _SPACE
for _a, _b in UNSPACED:
    _KINDS[_a : _b + 1] |= _LETTER
for _chars, _kind in ((MARKS, _MARK), (WIDE_MARKS, _WIDE), (CLOSERS, _CLOSER)):
    for _c in _chars:
        _KINDS[ord(_c)] |= _kind

_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0, ... modulo 2 ** 64, at least ``n`` of them."""
    found = _POWERS.get(base)
    if found is None or len(found) < n:
        steps = np.full(max(n, 1 << 14), base, np.uint64)
        steps[0] = 1
        found = np.cumprod(steps)
        if n <= 2 * BLOCK:  # longer ones aren't kept
            _POWERS[base] = found
    return found


_DOWN, _RUN_DOWN = pow(BASE, -1, 1 << 64), pow(RUN_BASE, -1, 1 << 64)


class Words(NamedTuple):
    """Of each word of some texts: hash, first character, whether a sentence ends behind it, and which text it is of."""

    hashes: np.ndarray
    first: np.ndarray
    ends: np.ndarray
    text: np.ndarray


def _words(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first characters, ends) of the words in code points that start and end at edges of words."""
    n = len(points)
    kinds = _KINDS[np.minimum(points, 0x20000)]
    solid = (kinds & _SPACE) == 0
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    letters = (kinds & _LETTER) != 0
    if letters.any():
        begins |= letters
    stops = solid.copy()
    stops[:-1] &= ~solid[1:] | begins[1:]
    first, last = np.flatnonzero(begins), np.flatnonzero(stops)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(points * _powers(_DOWN, n + 1)[:n], out=total[1:])
    hashes = (total[last + 1] - total[first]) * _powers(BASE, n + 1)[last]
    final = kinds[last]
    ends = (final & _MARK) != 0
    closed = np.flatnonzero(((final & _CLOSER) != 0) & (last > first))
    ends[closed] = (kinds[last[closed] - 1] & _WIDE) != 0
    feeds = np.flatnonzero(points == 10)
    if len(feeds) and len(first):
        before = np.searchsorted(feeds, first)
        ends[:-1] |= before[1:] > before[:-1]
        ends[-1] |= before[-1] < len(feeds)
    return hashes, first, ends


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _blocks(text: str):
    """``_words`` of a long text, a block at a time."""
    at, open_end = 0, None
    while at < len(text):
        end = at + BLOCK
        while end < len(text):
            tail = _KINDS[np.minimum(_points(text[end - 4096 : end]), 0x20000)] & (_SPACE | _LETTER)
            edges = np.flatnonzero(tail)
            if len(edges):
                end += int(edges[-1]) - 4096
                break
            end += BLOCK
        hashes, first, ends = _words(_points(text[at:end]))
        lead = at + int(first[0]) if len(first) else min(end, len(text))
        if open_end is not None and "\n" in text[at:lead]:  # it ends the sentence of the word before the block
            open_end[-1] = True
        if len(first):
            open_end = ends
            yield hashes, first + at, ends
        at = end


def words(texts: list[str | None]) -> Words:
    """The words of whole texts. Short texts are hashed together, long ones in blocks; of a word three numbers are kept."""
    parts, group, size = [], [], 0

    def together():
        lengths = np.array([len(texts[i]) + 1 for i in group])
        starts = np.cumsum(lengths) - lengths
        hashes, first, ends = _words(_points("\n".join(texts[i] for i in group)))
        of = np.searchsorted(starts, first, side="right") - 1
        ends[np.flatnonzero(np.diff(of))] = True
        if len(ends):
            ends[-1] = True
        parts.append(Words(hashes, first - starts[of], ends, np.array(group)[of]))

    for i, text in enumerate(texts):
        if not text:
            continue
        if len(text) > BLOCK:
            long = list(_blocks(text))
            for hashes, first, ends in long:
                parts.append(Words(hashes, first, ends, np.full(len(first), i)))
            if long:
                parts[-1].ends[-1] = True
            continue
        if size + len(text) > BLOCK and group:
            together()
            group, size = [], 0
        group.append(i)
        size += len(text)
    if group:
        together()
    if not parts:
        return Words(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
    found = Words(*(np.concatenate(x) for x in zip(*parts)))
    if (np.diff(found.text) < 0).any():  # long texts come before the short ones around them
        found = Words(*(x[np.argsort(found.text, kind="stable")] for x in found))
    return found


def pieces(found: Words, reach: int = REACH, longest: int = LONGEST) -> np.ndarray:
    """First words of the pieces of all texts, and the number of words at the end."""
    n = len(found.hashes)
    if not n:
        return np.zeros(1, np.int64)
    cut = found.ends.copy()
    stops = np.flatnonzero(cut)
    sizes = np.diff(stops, prepend=-1)
    if sizes.max() > 2 * reach:
        place = np.arange(n) - np.repeat(stops - sizes + 1, sizes)  # of the word in its sentence
        h, m = found.hashes, n - 2 * reach
        inner = h[reach : reach + m]
        least = place[2 * reach :] >= 2 * reach  # the sentence goes on for ``reach`` words on both sides
        for k in range(1, reach + 1):
            least &= (inner < h[reach - k : reach - k + m]) & (inner < h[reach + k : reach + k + m])
        cut[reach : reach + m] |= least
        stops = np.flatnonzero(cut)
        sizes = np.diff(stops, prepend=-1)
    if sizes.max() > longest:
        parts = (sizes + longest - 1) // longest
        first = np.repeat(stops - sizes, parts)
        number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        stops = np.minimum(first + (number + 1) * longest, np.repeat(stops, parts))
    return np.concatenate([[0], stops + 1])


def runs(found: Words, starts: np.ndarray, run: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first pieces, the pieces behind the last, hashes) of all runs: ``run`` pieces of a text, or as many as hold ``least`` words."""
    count, n = len(starts) - 1, len(found.hashes)
    if not count:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.uint64)
    of = found.text[starts[:-1]]
    behind = np.searchsorted(of, of, side="right")  # the piece behind the text's last
    low = np.arange(count)
    high = np.maximum(low + run, np.searchsorted(starts, starts[:-1] + least))
    fits = high <= behind
    low, high = low[fits], high[fits]
    up, down = _powers(RUN_BASE, n + 1), _powers(_RUN_DOWN, n + 1)
    h = np.empty((len(low), 2), np.uint64)
    total = np.zeros(n + 1, np.uint64)
    for lane, mixer in enumerate(MIXERS):
        w = (found.hashes ^ found.hashes >> np.uint64(31 + lane)) * mixer
        w ^= w >> np.uint64(29)
        np.cumsum(w * up[:n], out=total[1:])
        x = (total[starts[high]] - total[starts[low]]) * down[starts[low]]
        x = (x ^ x >> np.uint64(32)) * MIXERS[0]
        h[:, lane] = x ^ x >> np.uint64(29)
    return low, high, h


def distinct(of: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each run is the first with its hash in its text. Runs come text by text."""
    order = np.lexsort((h[:, 1], h[:, 0], of))
    same = np.zeros(len(of), bool)
    a, b = order[1:], order[:-1]
    same[a] = (of[a] == of[b]) & (h[a, 0] == h[b, 0]) & (h[a, 1] == h[b, 1])
    return ~same


def _spans(docs: DataFrame, run: int, least: int) -> DataFrame:
    """(doc_id, text_key, h1, h2): the distinct runs of each row; text_key tells rows of one doc_id apart."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make(batches):
        for batch in arrow_batches(batches, 256, "text", 2 << 20):
            found = words(batch.column("text").to_pylist())
            starts = pieces(found)
            low, _, h = runs(found, starts, run, least)
            of = found.text[starts[low]] if len(low) else low
            one = distinct(of, h)
            row, h = pa.array(of[one]), h[one].view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(row), batch.column("text_key").take(row), pa.array(h[:, 0]), pa.array(h[:, 1])], names=["doc_id", "text_key", "h1", "h2"])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_key"))
    return texts.mapInArrow(make, f"doc_id {kind}, text_key long, h1 long, h2 long")


def cleaned(texts: list[str | None], later: list, run: int, least: int) -> tuple[list[str | None], np.ndarray, np.ndarray, list[list[tuple[int, int]]]]:
    """(texts without the pieces of repeated runs, pieces, removed ones, their character ranges).

    ``later`` has, for each text, the first hash halves of runs to remove, or none.
    """
    found = words(texts)
    starts = pieces(found)
    low, high, h = runs(found, starts, run, least)
    of = found.text[starts[:-1]] if len(starts) > 1 else starts[:0]
    counts = np.bincount(of, minlength=len(texts))
    out, lost, ranges = list(texts), np.zeros(len(texts), np.int64), [[] for _ in texts]
    if not len(low):
        return out, counts, lost, ranges
    bad = ~distinct(of[low], h)
    edges = np.searchsorted(of[low], np.arange(len(texts) + 1))
    for i, some in enumerate(later):
        a, b = edges[i], edges[i + 1]
        if some is not None and len(some) and a < b:
            bad[a:b] |= np.isin(h[a:b, 0].view(np.int64), some)
    gone = np.cumsum(np.bincount(low[bad], minlength=len(starts)) - np.bincount(high[bad], minlength=len(starts)))[:-1] > 0
    places = np.flatnonzero(gone)
    if not len(places):
        return out, counts, lost, ranges
    opens = places[np.concatenate([[True], (np.diff(places) > 1) | (np.diff(of[places]) > 0)])]
    closes = places[np.concatenate([(np.diff(places) > 1) | (np.diff(of[places]) > 0), [True]])]
    lost = np.bincount(of[places], minlength=len(texts))
    begin = np.searchsorted(of, of[opens])  # the text's first piece
    for p, q, first in zip(opens.tolist(), closes.tolist(), begin.tolist()):
        i = int(of[p])
        a = 0 if p == first else int(found.first[starts[p]])
        b = len(texts[i]) if q + 1 == len(of) or of[q + 1] != i else int(found.first[starts[q + 1]])
        ranges[i].append((a, b))
    for i in np.flatnonzero(lost).tolist():
        t = texts[i]
        out[i] = "".join(t[a:b] for a, b in zip([0, *(b for _, b in ranges[i])], [*(a for a, _ in ranges[i]), len(t)]))
    return out, counts, lost, ranges


def dedup(docs: DataFrame, run: int = 3, least: int = 25) -> DataFrame:
    """Every row of ``docs`` with its cleaned text, and _sentences, _n_removed of them, _removed (character ranges of the old text).

    Rows with one doc_id count as one document and keep what they share. Rows without an id
    are the last document. Null texts stay null, texts without words stay as they are, and texts that are
    repeats from start to end become empty. Extra columns pass through; ``clean_documents`` takes
    them with any names.
    """
    spans = materialize(_spans(docs, run, least), "runs")
    last = F.col("doc_id").isNull()
    first = spans.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("top"), F.max(last).alias("none"))
    first = first.where("first is not null and (top > first or none)").select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "first")
    later = spans.join(first, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))).where(last | (F.col("doc_id") > F.col("first")))
    lists = materialize(later.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.collect_set("h1").alias("_later")), "repeats")  # a text's own runs
    drop_table(spans)
    joined = docs.join(lists, docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_key")), "left").drop("_id", "_key")
    names = [f.name for f in docs.schema.fields]
    place = names.index("text")
    ranges = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def make(batches):
        for batch in arrow_batches(batches, 256, "text", 2 << 20):
            lists = [x.values.to_numpy() if x.is_valid else None for x in batch.column("_later")]
            texts, counts, lost, gone = cleaned(batch.column("text").to_pylist(), lists, run, least)
            columns = list(batch.columns[: len(names)])
            columns[place] = pa.array(texts, pa.string())
            spans = pa.array([[{"start": a, "end": b} for a, b in x] for x in gone], ranges)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(lost, pa.int64()), spans], names=[*names, "_sentences", "_n_removed", "_removed"])

    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    more = [T.StructField("_sentences", T.LongType()), T.StructField("_n_removed", T.LongType()), T.StructField("_removed", T.ArrayType(span))]
    return joined.select(*(F.col(f"`{n}`") for n in names), "_later").mapInArrow(make, T.StructType([*docs.schema.fields, *more]))


def clean_documents(docs: DataFrame, run: int = 3, least: int = 25) -> DataFrame:
    """``docs`` with cleaned texts and their n_chars; a document of which nothing is left goes."""
    inner, back = enclosed(docs, "doc_id", "text", "n_chars")
    found = dedup(inner, run, least)
    found = found.where((F.size("_removed") == 0) | (F.length(F.trim("text")) > 0))
    if "n_chars" in docs.columns:
        changed = F.when(F.size("_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
        found = found.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return back(found)


def op6_substring(spark, sf_dir: str) -> DataFrame:
    found = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "text", F.col("_sentences").alias("n_sentences"), F.col("_n_removed").alias("n_removed"), F.size("_removed").cast("long").alias("n_removed_ranges"))
