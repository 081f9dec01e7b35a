"""Hard negatives by branch and bound over ball trees, one or more a partition.

Vectors become integers, so scores are exact. Tasks pack their rows into ball trees: nodes with a centre, a radius, the
labels and the smallest id below. For a query q and a node with centre c and radius r, all scores lie in
q*c -+ |q| r. Nodes outside a query's window, nodes strictly beneath its k-th best so far, and nodes whose labels can't count
aren't entered. Queries come in blocks, and every block meets every tree by an equi-join on numbered slots; a
task holds one tree and one block.

A first round meets about the square root of all trees; the k-th best it finds for each query bounds the second round, which
so returns little more than what is better. Results of both are ranked together, so they are exact.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, materialize, table

#: Rows of a leaf, of the smallest and largest trees, and queries of a block. They set the layout only.
LEAF, FEW, MANY, QUERIES = 64, 2048, 32768, 256
LOW, HIGH = -(1 << 63), (1 << 63) - 1
NO_ID = HIGH  # a null id, which sorts last
TREE = "slot int, n int, width int, kind string, vectors binary, ids binary, labels binary, nodes binary, centres binary, radii binary, bounds binary"


def quantised(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256, changed: Column | None = None) -> DataFrame:
    """(vec_id, label, vector, copies): rows that take part, each set of equal ones once.

    Rows with a null label, a null vector or any null or non-finite component take no part. Components become floor(scale * x).
    ``changed`` replaces the label. Null ids are kept: they are no anchors, and sort last among equal scores.
    """
    number = F.col(vector).cast("array<double>")
    fine = F.col(label).isNotNull() & F.col(vector).isNotNull() & F.coalesce(F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    whole = F.transform(number, lambda x: F.floor(x * scale).cast("long"))
    kept = rows.where(fine).select(F.col(vec_id).cast("long").alias("vec_id"), (F.col(label) if changed is None else changed).cast("long").alias("label"), whole.alias("vector"))
    return kept.groupBy("vec_id", "label", "vector").agg(F.count(F.lit(1)).alias("copies"))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer matrices, exact."""
    most = a.shape[1] * int(max(a.max(initial=0), -int(a.min(initial=0)))) * int(max(b.max(initial=0), -int(b.min(initial=0))))
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most >= 1 << 63:
        raise ValueError("inner products don't fit 64 bits")
    return a @ b.T


class Tree:
    """A ball tree over rows (ids, labels, vectors), its leaves contiguous."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(ids))
        self.ids, self.labels, self.vectors, self.leaf = ids, labels, vectors, leaf
        self.nodes, self.centres, self.radii, self.bounds = [], [], [], []
        self._node(0, len(ids))
        self.ids, self.labels, self.vectors = ids[self.order], labels[self.order], vectors[self.order]
        self.nodes, self.centres = np.array(self.nodes, np.int32), np.array(self.centres, np.int64)
        self.radii, self.bounds = np.array(self.radii), np.array(self.bounds, np.int64)

    def _node(self, start: int, stop: int) -> int:
        """The node of rows start to stop: (start, stop, left, right), and (smallest label, largest label, smallest id)."""
        rows = self.order[start:stop]
        points = self.vectors[rows].astype(np.float64)
        centre = np.rint(points.mean(axis=0))
        away = ((points - centre) ** 2).sum(axis=1)
        at = len(self.nodes)
        self.nodes.append([start, stop, -1, -1])
        self.centres.append(centre.astype(np.int64))
        self.radii.append(math.sqrt(away.max()) * (1 + 1e-12))
        self.bounds.append([self.labels[rows].min(), self.labels[rows].max(), self.ids[rows].min()])
        if stop - start > self.leaf and away.max() > 0:
            far = points[away.argmax()]
            other = points[((points - far) ** 2).sum(axis=1).argmax()]
            half = (stop - start) // 2
            self.order[start:stop] = rows[np.argpartition(points @ (other - far), half)]
            self.nodes[at][2] = self._node(start, start + half)
            self.nodes[at][3] = self._node(start + half, stop)
        return at

    def row(self, slot: int) -> dict:
        kind = "i2" if max(self.vectors.max(initial=0), -self.vectors.min(initial=0), self.centres.max(initial=0), -self.centres.min(initial=0)) < 1 << 15 else "i8"
        pack = lambda a, k: np.ascontiguousarray(a).astype(f"<{k}").tobytes()
        return {
            "slot": slot, "n": len(self.ids), "width": self.vectors.shape[1], "kind": kind, "vectors": pack(self.vectors, kind), "ids": pack(self.ids, "i8"), "labels": pack(self.labels, "i8"),
            "nodes": pack(self.nodes, "i4"), "centres": pack(self.centres, kind), "radii": pack(self.radii, "f8"), "bounds": pack(self.bounds, "i8"),
        }

    @classmethod
    def read(cls, row: dict) -> Tree:
        self, kind = cls.__new__(cls), f"<{row['kind']}"
        take = lambda name, k, *shape: np.frombuffer(row[name], k).reshape(*shape)
        self.ids, self.labels = take("ids", "<i8", -1), take("labels", "<i8", -1)
        self.nodes, self.radii, self.bounds = take("nodes", "<i4", -1, 4), take("radii", "<f8", -1), take("bounds", "<i8", -1, 3)
        self.vectors = take("vectors", kind, row["n"], row["width"]).astype(np.int64)
        self.centres = take("centres", kind, len(self.nodes), row["width"]).astype(np.int64)
        return self


class Search:
    """The ``k`` best rows of each query among those with the query's label (``same``) or with any other one.

    ``anchor`` gives each query's row of ``vectors``; ``low`` and ``high`` its window; (``score``, ``id``) a k-th best known
    before, which rows must reach. Higher scores come first, then smaller ids.
    """

    def __init__(self, vectors, labels, anchor, low, high, score, ident, k: int, same: bool):
        self.vectors, self.labels, self.anchor, self.low, self.high, self.k, self.same = vectors, labels, anchor, low, high, k, same
        n = len(anchor)
        self.scores, self.ids = np.full((n, k), LOW, np.int64), np.full((n, k), HIGH, np.int64)
        self.least, self.least_id = score.copy(), ident.copy()
        self.norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        self.leaves = 0

    def run(self, tree: Tree) -> None:
        width = max(self.vectors.shape[1], tree.vectors.shape[1])
        wide = lambda a: np.pad(a, ((0, 0), (0, width - a.shape[1])))  # noqa: E731  missing components are 0
        mine, rows = wide(self.vectors), wide(tree.vectors)
        middle = products(mine, wide(tree.centres))
        reach = np.multiply.outer(self.norms, tree.radii)
        reach += (np.abs(middle) + reach) * 1e-12 + 1e-6
        above, below = np.floor(middle + reach), np.ceil(middle - reach)
        waiting = [(0, np.arange(len(self.anchor)))]
        while waiting:
            node, at = waiting.pop()
            a = self.anchor[at]
            most, (least_label, most_label, least_id) = above[a, node], tree.bounds[node].tolist()
            label = self.labels[a]
            open_ = (least_label <= label) & (label <= most_label) if self.same else (least_label != most_label) | (label != least_label)
            open_ &= (most >= self.low[at]) & (below[a, node] <= self.high[at])
            open_ &= (most > self.least[at]) | ((most == self.least[at]) & (least_id <= self.least_id[at]))
            at = at[open_]
            if not len(at):
                continue
            start, stop, left, right = tree.nodes[node].tolist()
            if left < 0:
                self._leaf(tree, rows, start, stop, at, mine)
            else:  # the child with higher bounds is entered first, so the k-th best rises early
                a = self.anchor[at]
                first = above[a, left].sum() >= above[a, right].sum()
                waiting += [(right, at), (left, at)] if first else [(left, at), (right, at)]

    def _leaf(self, tree: Tree, rows: np.ndarray, start: int, stop: int, at: np.ndarray, mine: np.ndarray) -> None:
        self.leaves += 1
        for low in range(start, stop, 4 * LEAF):  # a leaf of equal vectors may be long
            part = slice(low, min(stop, low + 4 * LEAF))
            asked, back = np.unique(self.anchor[at], return_inverse=True)
            score = products(mine[asked], rows[part])[back]
            ids = tree.ids[part]
            label = tree.labels[part][None, :] == self.labels[self.anchor[at]][:, None]
            good = (label if self.same else ~label) & (score >= self.low[at][:, None]) & (score <= self.high[at][:, None])
            good &= (score > self.least[at][:, None]) | ((score == self.least[at][:, None]) & (ids[None, :] <= self.least_id[at][:, None]))
            some = np.flatnonzero(good.any(axis=1))
            if not len(some):
                continue
            q = at[some]
            score = np.concatenate([self.scores[q], np.where(good[some], score[some], LOW)], axis=1)
            ids = np.concatenate([self.ids[q], np.where(good[some], ids[None, :], HIGH)], axis=1)
            order = np.lexsort((ids, ~score), axis=1)[:, : self.k]  # ~score falls as score rises
            self.scores[q], self.ids[q] = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)
            last, last_id = self.scores[q, -1], self.ids[q, -1]
            better = (last > self.least[q]) | ((last == self.least[q]) & (last_id < self.least_id[q]))
            self.least[q[better]], self.least_id[q[better]] = last[better], last_id[better]


def grown(rows: DataFrame, slots: int, tree_rows: int, copies: int, leaf: int = LEAF) -> DataFrame:
    """Trees over ``quantised`` rows, of at most ``tree_rows`` rows of one partition each, dealt into ``slots``. Of equal rows as many as can be found enter."""

    def run(batches):
        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def tree():
            nonlocal made, held, size
            taken = pa.Table.from_batches(held)
            ids = taken.column("vec_id").fill_null(NO_ID).to_numpy().astype(np.int64)
            lists = taken.column("vector").to_pylist()
            width = max(map(len, lists))
            vectors = np.array([v + [0] * (width - len(v)) for v in lists], np.int64).reshape(len(lists), width)
            times = np.minimum(taken.column("copies").to_numpy(), copies)
            found = Tree(np.repeat(ids, times), np.repeat(taken.column("label").to_numpy().astype(np.int64), times), np.repeat(vectors, times, axis=0), leaf)
            row = found.row((part * 7919 + made * 104729) % slots)
            made, held, size = made + 1, [], 0
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                n = min(batch.num_rows - at, tree_rows - size)
                held.append(batch.slice(at, n))
                at, size = at + n, size + n
                if size == tree_rows:
                    yield tree()
        if size:
            yield tree()

    schema = pa.schema([(f.split()[0], {"int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[f.split()[1]]) for f in TREE.split(", ")])
    return rows.select("vec_id", "label", "vector", "copies").mapInArrow(run, TREE)


def met(trees: DataFrame, anchors: DataFrame, windows: DataFrame, k: int, same: bool, slots: int, part: Column, block_rows: int) -> DataFrame:
    """(aid, high, score, id): up to ``k`` rows of each tree in the slots where ``part`` holds for each window (aid, low, high, score, id).

    Anchors with their windows are dealt into blocks by a hash, and each block goes once to every slot.
    """
    count = anchors.count()
    if not count:
        return anchors.sparkSession.createDataFrame([], "aid long, high long, score long, id long")
    blocks = math.ceil(count / block_rows)
    asked = windows.groupBy("aid").agg(F.collect_list(F.struct("low", "high", "score", "id")).alias("windows"))
    each = anchors.select("aid", "label", "vector").join(asked, "aid")
    packed = each.groupBy(F.pmod(F.xxhash64("aid"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("aid", "label", "vector", "windows")).alias("asked"))
    wanted = F.filter(F.sequence(F.lit(0), F.lit(slots - 1)), part)
    tasks = min(slots, 10_000)
    sent = packed.select(F.explode(wanted).alias("to"), "asked").repartition(tasks, "to")
    pairs = trees.where(part(F.col("slot"))).repartition(tasks, "slot").join(sent, F.col("slot") == F.col("to"))
    names = [f.split()[0] for f in TREE.split(", ")]
    out = ["aid", "high", "score", "id"]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in names}
                asked = batch.column("asked")[i].as_py()
                width = max(len(q["vector"]) for q in asked)
                vectors = np.array([q["vector"] + [0] * (width - len(q["vector"])) for q in asked], np.int64).reshape(len(asked), width)
                flat = [(j, w) for j, q in enumerate(asked) for w in q["windows"]]
                columns = {c: np.array([w[c] for _, w in flat], np.int64) for c in ("low", "high", "score", "id")}
                anchor = np.array([j for j, _ in flat], np.int64)
                search = Search(vectors, np.array([q["label"] for q in asked], np.int64), anchor, columns["low"], columns["high"], columns["score"], columns["id"], k, same)
                search.run(Tree.read(row))
                q, at = np.nonzero(search.scores > LOW)
                aid = np.array([x["aid"] for x in asked], np.int64)[anchor[q]]
                yield pa.RecordBatch.from_arrays([pa.array(aid), pa.array(columns["high"][q]), pa.array(search.scores[q, at]), pa.array(search.ids[q, at])], names=out)

    return pairs.select(*names, "asked").mapInArrow(run, "aid long, high long, score long, id long")


def best(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each (aid, high), with their ``place`` from 1."""
    order = Window.partitionBy("aid", "high").orderBy(F.col("score").desc(), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def nearest(trees: DataFrame, anchors: DataFrame, windows: DataFrame, k: int, same: bool, slots: int, block_rows: int = QUERIES) -> DataFrame:
    """(aid, high, score, id, place): the ``k`` best rows of each window (aid, low, high) over all trees, in two rounds."""
    step = max(1, math.isqrt(slots))
    open_ = windows.withColumns({"score": F.lit(LOW), "id": F.lit(HIGH)})
    early = materialize(best(met(trees, anchors, open_, k, same, slots, lambda s: s % step == 0, block_rows), k), "early")
    if step == 1:
        return early
    known = early.where(F.col("place") == k).select(F.col("aid").alias("_a"), F.col("high").alias("_h"), F.col("score").alias("_s"), F.col("id").alias("_i"))
    bound = windows.join(known, (F.col("aid") == F.col("_a")) & (F.col("high") == F.col("_h")), "left")
    bound = bound.select("aid", "low", "high", F.coalesce("_s", F.lit(LOW)).alias("score"), F.coalesce("_i", F.lit(HIGH)).alias("id"))
    late = met(trees, anchors, bound, k, same, slots, lambda s: s % step != 0, block_rows)
    found = materialize(best(early.drop("place").unionByName(late), k), "nearest")
    drop_table(early)
    return found


def mined(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, tree_rows: int | None = None, block_rows: int = QUERIES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for ``quantised`` rows.

    Anchors are rows where ``anchor`` holds. An anchor's positives are its first other rows of its label; each gets the first rows of other
    labels with low * positive_score <= 100 * negative_score <= 100 * positive_score, ranked from 1. Anchors that repeat give
    their rows as often; rows equal to an anchor are positives of it like others. A positive of negative score has no
    negatives. Vectors of other lengths are filled with 0; scores over 64 bits are an error. An empty table gives no rows.
    """
    if not 0 <= low <= 100:
        raise ValueError("low is a percentage")
    data = materialize(rows, "vectors")
    count = data.count()
    if tree_rows is None:  # a layout: trees enough for all cores, and large ones where rows are many
        tree_rows = min(MANY, max(FEW, math.ceil(count / (4 * rows.sparkSession.sparkContext.defaultParallelism))))
    slots = max(1, math.ceil(count / tree_rows))
    trees = materialize(grown(data, slots, tree_rows, positives + 1 + negatives), "trees")
    anchors = materialize(data.where(F.coalesce(anchor, F.lit(False))).withColumn("aid", F.monotonically_increasing_id()), "anchors")
    everything = anchors.select("aid", F.lit(LOW).alias("low"), F.lit(HIGH).alias("high"))
    own = nearest(trees, anchors, everything, positives + 1, True, slots, block_rows)
    square = F.aggregate("vector", F.lit(0).cast("long"), lambda t, x: t + x * x)
    of = anchors.select(F.col("aid").alias("_aid"), F.col("vec_id").alias("anchor_id"), "copies", square.alias("_own"))
    listed = own.join(of, F.col("aid") == F.col("_aid"))
    mine = F.min(F.when((F.col("id") == F.col("anchor_id")) & (F.col("score") == F.col("_own")), F.col("place"))).over(Window.partitionBy("aid"))
    others = listed.withColumn("_mine", F.coalesce(mine, F.lit(positives + 1))).where((F.col("place") != F.col("_mine")) & (F.col("place") - (F.col("place") > F.col("_mine")).cast("int") <= positives))
    pairs = materialize(others.select("aid", "anchor_id", "copies", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    least = F.expr(f"{low} * (positive_score div 100) + ({low} * (positive_score % 100) + 99) div 100")  # rounded up, without overflow
    windows = pairs.where("positive_score >= 0").select("aid", least.cast("long").alias("low"), F.col("positive_score").alias("high")).distinct()
    found = nearest(trees, anchors, materialize(windows, "windows"), negatives, False, slots, block_rows)
    told = found.select(F.col("aid").alias("_aid"), "high", F.col("score").alias("negative_score"), F.col("id").alias("_negative"), "place")
    joined = pairs.join(told, (F.col("aid") == F.col("_aid")) & (F.col("positive_score") == F.col("high"))).withColumn("_copy", F.explode(F.expr("sequence(1L, copies)")))
    named = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return joined.select("anchor_id", named("positive_id").alias("positive_id"), F.col("place").cast("int").alias("rank"), named("_negative").alias("negative_id"), "positive_score", "negative_score")


def op12_negatives(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(quantised(table(spark, sf_dir, "embeddings"), changed=label), F.col("vec_id") % 100 == 0)
