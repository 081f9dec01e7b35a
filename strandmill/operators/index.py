"""Suffix arrays and the counts of an FM index over a reference text.

The text is ACGT followed by ``$``, which sorts before every base. Where a function takes ``ref``, that is one row (ref), or blocks
(block, bases) of ``SIZE`` bases as ``blocked`` has them. A row is cut into blocks once, and all windows of letters are cut from blocks, so time goes with the
text's length. ``suffix_array`` doubles prefixes with joins and sorts, so no task needs the whole text; ``FmIndex`` holds the
same index in numpy arrays for lookups inside a task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import shared
from ..functions import bases as fn

BUCKET = 288
#: Bases of a block. Blocks are joined with the letters behind them, so this also is the longest window.
SIZE = 1024


def normalise(lines: DataFrame, compat: bool = False) -> DataFrame:
    """(ref): FASTA lines (line_no, line) as one text: headers dropped, letters upper-cased,
    runs of over ten N deleted (also over line ends), other N and ambiguity letters turned to G.

    ``compat`` upper-cases by bits as older builders do, which turns other printable characters into letters (a dot to N).
    """
    marks = [chr(c) for c in range(33, 127)]
    upper = F.translate("line", "".join(marks), "".join(chr(ord(c) & 31 | 64) for c in marks)) if compat else F.upper("line")
    kept = lines.where(~F.col("line").startswith(">")).orderBy("line_no")
    whole = kept.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", upper.alias("s")))), lambda x: x["s"]), "").alias("t"))
    return whole.select(F.regexp_replace(F.regexp_replace("t", "N{11,}", ""), "[^ACGT]", "G").alias("ref"))


def joined(blocks: DataFrame) -> DataFrame:
    """(ref): the text of (block, bases) in one value, for references that are small enough to be sent to tasks."""
    return blocks.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "bases"))), lambda x: x["bases"]), "").alias("ref"))


def behind(blocks: DataFrame, column: str, k: int, join: str = "left") -> DataFrame:
    """Each block with ``more``: the first ``k`` entries of ``column`` in the next block."""
    first = F.slice(column, 1, k) if blocks.schema[column].dataType.typeName() == "array" else F.substr(column, F.lit(1), F.lit(k))
    after = blocks.select((F.col("block") - 1).alias("_b"), first.alias("more"))
    return blocks.join(after, F.col("block") == F.col("_b"), join).drop("_b")


def _ended(ref: DataFrame) -> DataFrame:
    """(block, bases) of the text with its ``$``, dealt to four tasks a core: a text's few bytes come as one task, but each letter of it becomes a row."""
    tasks = 4 * ref.sparkSession.sparkContext.defaultParallelism
    if "bases" not in ref.columns:
        pieces = F.regexp_extract_all(F.concat(ref.columns[0], F.lit("$")), F.lit(f"(?s).{{1,{SIZE}}}"), F.lit(0))
        return ref.select(F.posexplode(pieces).alias("block", "bases")).select(F.col("block").cast("long").alias("block"), "bases").repartition(tasks, "block")
    last = ref.agg(F.max("block").alias("last"))
    ended = ref.join(F.broadcast(last)).select("block", F.when(F.col("block") == F.col("last"), F.concat("bases", F.lit("$"))).otherwise(F.col("bases")).alias("bases"))  # one row
    return ended.repartition(tasks, "block")


def _grams(blocks: DataFrame, k: int) -> DataFrame:
    """(pos, gram): the ``k`` letters from every place on, fewer at the end of the text."""
    wide = behind(blocks, "bases", k - 1).select("block", F.length("bases").alias("n"), F.concat("bases", F.coalesce("more", F.lit(""))).alias("s"))
    each = wide.select("block", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.substr("s", i, F.lit(k)))).alias("i", "gram"))
    return each.select((F.col("block") * SIZE + F.col("i")).cast("long").alias("pos"), "gram")


def _ordered(rows: DataFrame, keys: list[str], into: str, part: Column) -> DataFrame:
    """Dense ranks of ``keys`` from 0. ``part`` rises with the keys: its groups are ranked apart, then shifted by the groups
    before. It is a function of the row alone, so a repeated task ranks alike.
    """
    dealt = rows.withColumn("_p", part)
    local = dealt.withColumn("_r", F.dense_rank().over(Window.partitionBy("_p").orderBy(*keys)))
    groups = local.groupBy("_p").agg(F.max("_r").alias("_n"))
    before = groups.select(F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))  # a row a part
    return local.join(before, F.col("_p") == F.col("_q")).withColumn(into, (F.col("_b") + F.col("_r") - 1).cast("long")).drop("_p", "_r", "_q", "_b")


def suffix_array(ref: DataFrame, start: int = 16) -> DataFrame:
    """(row, pos): suffixes in order. Ranks by ``start`` letters, doubled until they all differ."""
    shared.checkpoints(ref.sparkSession)
    ranks = _ordered(_grams(_ended(ref), start), ["gram"], "rank", F.substr("gram", F.lit(1), F.lit(5))).select("pos", "rank")
    k = start
    while True:
        ranks = ranks.checkpoint()
        n, top = ranks.agg(F.count(F.lit(1)), F.max("rank")).first()
        if n == 0 or top == n - 1:
            return ranks.select(F.col("rank").alias("row"), "pos")
        ahead = ranks.select((F.col("pos") - k).alias("at"), F.col("rank").alias("then"))
        pairs = ranks.join(ahead, F.col("pos") == F.col("at"), "left").select("pos", "rank", F.coalesce("then", F.lit(-1)).alias("then"))
        ranks = _ordered(pairs, ["rank", "then"], "next", F.floor(F.col("rank") / 4096)).select("pos", F.col("next").alias("rank"))
        k *= 2


def bwt(ref: DataFrame, sa: DataFrame) -> DataFrame:
    """(row, b1, b2, b3, code): the letters 1, 2 and 3 places before each suffix, round the end; code 64 where one is ``$``."""
    blocks = _ended(ref)
    last = blocks.agg(F.max("block").alias("last"))
    ends = blocks.join(F.broadcast(last)).where("block >= last - 1")  # two blocks, as the last may be short
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "bases"))), lambda x: x["bases"]), "")
    tail = ends.agg(F.right(F.repeat(text, F.lit(3)), F.lit(3)).alias("tail"))
    ahead = blocks.select((F.col("block") + 1).alias("_b"), F.right("bases", F.lit(3)).alias("ahead"))
    wide = blocks.join(ahead, F.col("block") == F.col("_b"), "left").join(F.broadcast(tail))  # one row
    wide = wide.select("block", F.length("bases").alias("n"), F.concat(F.coalesce("ahead", "tail"), "bases").alias("s"))
    each = wide.select("block", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.substr("s", i, F.lit(3)))).alias("i", "t"))
    here = sa.join(each.select((F.col("block") * SIZE + F.col("i")).alias("p"), "t"), F.col("pos") == F.col("p"))
    letters = (F.substr("t", F.lit(4 - k), F.lit(1)).alias(f"b{k}") for k in (1, 2, 3))
    return here.select("row", *letters, F.coalesce(fn.triple_code(F.col("t")), F.lit(64)).alias("code"))


def gram_counts(ref: DataFrame, k: int) -> DataFrame:
    """(gram, n, before): circular k-grams without ``$``, and how many grams, ``$`` ones included, sort before each."""
    blocks = _ended(ref)
    head = blocks.where("block = 0").select(F.substr("bases", F.lit(1), F.lit(k - 1)).alias("head"))
    wide = behind(blocks, "bases", k - 1).join(F.broadcast(head))  # one row
    ring = wide.select(F.length("bases").alias("n"), F.concat("bases", F.substr(F.concat(F.coalesce("more", F.lit("")), "head"), F.lit(1), F.lit(k - 1))).alias("s"))
    grams = ring.select(F.explode(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.substr("s", i, F.lit(k)))).alias("gram"))
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("gram").rowsBetween(Window.unboundedPreceding, -1))  # at most 5**k rows
    return counts.select("gram", "n", F.coalesce(before, F.lit(0)).cast("long").alias("before")).where(~F.contains("gram", F.lit("$")))


def intervals(ref: DataFrame, sa: DataFrame, k: int) -> DataFrame:
    """(gram, low, high): the rows of suffixes that start with each k-gram of bases."""
    grams = _grams(_ended(ref), k).where((F.length("gram") == k) & ~F.contains("gram", F.lit("$")))
    rows = sa.join(grams.withColumnRenamed("pos", "p"), F.col("pos") == F.col("p"))
    return rows.groupBy("gram").agg(F.min("row").alias("low"), F.max("row").alias("high"))


def checkpoints(codes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(bucket, code, before): how often each code occurs in the rows before each bucket. Buckets count first, then add up."""
    counted = codes.groupBy(F.floor(F.col("row") / bucket).cast("long").alias("b"), "code").agg(F.count(F.lit(1)).alias("n"))
    counted = shared.materialize(counted, "counts")
    per = counted.where("code < 64")
    last = counted.agg(F.max("b").alias("last"))
    seen = per.select("code").distinct()
    grid = seen.join(F.broadcast(last)).select("code", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("bucket"))
    full = grid.join(per.withColumnRenamed("code", "c"), (F.col("bucket") == F.col("b")) & (F.col("code") == F.col("c")), "left")
    before = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("code").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    return full.select("bucket", "code", F.coalesce(before, F.lit(0)).cast("long").alias("before"))


def occurrences(codes: DataFrame, asked: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(row, code, occ) for asked (row, code): how often the code occurs in the rows before; a checkpoint plus a part of one bucket."""
    marks = checkpoints(codes, bucket).withColumnRenamed("code", "mc").withColumnRenamed("bucket", "mb")
    q = asked.withColumn("b", F.floor(F.col("row") / bucket).cast("long"))
    base = q.join(marks, (F.col("b") == F.col("mb")) & (F.col("code") == F.col("mc")), "left")
    inside = codes.select(F.floor(F.col("row") / bucket).cast("long").alias("ib"), F.col("row").alias("ir"), F.col("code").alias("ic"))
    joined = base.join(inside, (F.col("b") == F.col("ib")) & (F.col("code") == F.col("ic")) & (F.col("ir") < F.col("row")), "left")
    return joined.groupBy("row", "code").agg((F.coalesce(F.max("before"), F.lit(0)) + F.count("ir")).cast("long").alias("occ"))


def _suffixes(t: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes, by prefix doubling."""
    n, rank, k = len(t), t, 1
    while True:
        second = np.zeros(n, np.int64)
        second[:-k] = rank[k:] + 1
        key = rank * (n + 2) + second
        sa = np.argsort(key, kind="stable")
        new = np.zeros(n, np.int64)
        new[sa] = np.cumsum(np.concatenate([[0], np.diff(key[sa]) != 0]))
        rank, k = new, 2 * k
        if rank.max() == n - 1:
            return sa


class FmIndex:
    """A reference of bounded length as numpy arrays: suffix array, base counts and bit vectors for ranks.

    With ``sa``, positions in the order of their suffixes, no suffix is sorted here.
    """

    def __init__(self, text: str, sa: np.ndarray | None = None):
        self.text = text
        codes = np.frombuffer(text.encode() + b"$", np.uint8)
        order = np.zeros(256, np.int8)
        for i, b in enumerate(b"$ACGT"):
            order[b] = i
        t = order[codes].astype(np.int64)
        n = len(t)
        sa = _suffixes(t) if sa is None else sa.astype(np.int64)
        if len(sa) != n or not np.array_equal(np.bincount(sa, minlength=n), np.ones(n)):
            raise ValueError("the suffix array isn't one of this reference")
        self.n, self.sa = n, sa.astype(np.uint32)
        last = t[sa - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=5))])[:5]
        words = -(-(n + 1) // 64)
        self.bits, self.before = [], []
        for c in range(1, 5):
            flags = np.zeros(words * 64, np.uint8)
            flags[:n] = last == c
            packed = np.packbits(flags, bitorder="little").view(np.uint64)
            self.bits.append(packed)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int64))]))

    def rank(self, base: int, row: np.ndarray) -> np.ndarray:
        """How often ``base`` (0 to 3) stands before the suffixes of the first ``row`` rows."""
        word, bit = row >> 6, (row & 63).astype(np.uint64)
        inside = self.bits[base][word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[base][word] + np.bitwise_count(inside).astype(np.int64)

    def step(self, base: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) narrowed to the suffixes with ``base`` before them, for many ranges at once."""
        lo, hi = np.empty_like(low), np.empty_like(high)
        for b in range(4):
            m = base == b
            if m.any():
                lo[m] = self.first[b + 1] + self.rank(b, low[m])
                hi[m] = self.first[b + 1] + self.rank(b, high[m])
        return lo, hi

