"""A Merkle manifest of documents: trees of degree 16 by source, and one over the sources.

Leaves are hashed by Spark's own functions, numbered in the order of a range sort, and packed into aligned
blocks of 4096, one row each. Inside a block ``Traversal`` goes from leaf to leaf: stacks (``Treehash``) of at most 15
digests a level build each level's next run of siblings while the present one is in use, one leaf a step, so authentication paths
take memory that grows with the number of levels only. The roots of blocks are the leaves of the next round; after a few rounds
(one more for each factor of 4096) every tree has its root. A block's path to that root is shared by all its leaves and put
behind each one's own.

A path is a list of (left, right): the hexadecimal digests of the siblings before and after, a level each. A run
of one node is hashed too, with empty siblings; a tree of one leaf has an empty path.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, materialize, table

#: Nodes a run, and levels of a block: 4096 leaves.
DEGREE, LEVELS = 16, 3
PATH = "array<struct<left: string, right: string>>"
_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def joined_hash(digests: Sequence[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def height(n: int, degree: int = DEGREE) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // degree), levels + 1
    return levels


class Treehash:
    """Builds one node of ``level`` from its leaves, given in order; holds fewer than ``degree`` digests a level."""

    def __init__(self, level: int, degree: int = DEGREE):
        self.degree, self.open = degree, [[] for _ in range(level)]
        self.node: str | None = None

    def push(self, digest: str) -> None:
        for nodes in self.open:
            nodes.append(digest)
            if len(nodes) < self.degree:
                return
            digest = joined_hash(nodes)
            nodes.clear()
        self.node = digest

    def finish(self) -> str:
        """The node, also where leaves are missing at its end."""
        if self.node is None:
            digest = None
            for nodes in self.open:
                if digest is not None:
                    nodes.append(digest)
                digest = joined_hash(nodes) if nodes else None
            self.node = digest
        return self.node


class Traversal:
    """Authentication paths of the leaves of one tree of ``levels`` levels, in order.

    Each level keeps the digests of its present run of siblings and those of the next run that are ready. While the leaves below a run
    are passed, one leaf of the next run enters a stack at each step, so the run is whole when it is needed.
    """

    def __init__(self, leaves: Sequence[str], levels: int, degree: int = DEGREE):
        self.leaves, self.levels, self.degree = leaves, levels, degree
        self.now: list[list[str]] = [[] for _ in range(levels)]
        self.next: list[list[str]] = [[] for _ in range(levels)]
        self.stacks = [Treehash(k, degree) for k in range(levels)]
        self.fed = [degree ** (k + 1) for k in range(levels)]  # leaves of each level's runs that have been hashed
        root = Treehash(levels, degree)
        first = [Treehash(k, degree) for k in range(levels)]
        for i, leaf in enumerate(leaves):
            root.push(leaf)
            for k in range(levels):
                if i < degree ** (k + 1):
                    self._feed(k, first, self.now, leaf, i)
        for k in range(levels):
            self._close(k, first, self.now)
        self.root = root.finish() if levels else leaves[0]

    def _feed(self, k: int, stacks: list[Treehash], into: list[list[str]], leaf: str, i: int) -> None:
        stacks[k].push(leaf)
        if (i + 1) % self.degree**k == 0:
            into[k].append(stacks[k].finish())
            stacks[k] = Treehash(k, self.degree)

    def _close(self, k: int, stacks: list[Treehash], into: list[list[str]]) -> None:
        last = stacks[k].finish() if k else None
        if last is not None:
            into[k].append(last)
        stacks[k] = Treehash(k, self.degree)

    def held(self) -> int:
        """Digests held."""
        return sum(len(x) for x in self.now + self.next) + sum(len(x) for s in self.stacks for x in s.open)

    def paths(self) -> Iterator[list[tuple[str, str]]]:
        n = len(self.leaves)
        for i in range(n):
            for k in range(self.levels):
                run = self.degree ** (k + 1)
                if i and i % run == 0:  # past the present run
                    if self.fed[k] >= n:
                        self._close(k, self.stacks, self.next)
                    self.now[k], self.next[k] = self.next[k], []
            path = []
            for k, nodes in enumerate(self.now):
                at = i // self.degree**k % self.degree
                path.append(("".join(nodes[:at]), "".join(nodes[at + 1 :])))
            yield path
            for k in range(self.levels):
                j = self.fed[k]
                if j < n:
                    self._feed(k, self.stacks, self.next, self.leaves[j], j)
                    self.fed[k] = j + 1


def folded(leaf: str, path: Sequence[tuple[str, str]]) -> str:
    """The root that ``leaf`` and its siblings give."""
    for left, right in path:
        leaf = sha256(f"{left}{leaf}{right}".encode()).hexdigest()
    return leaf


def field(c: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value, as bytes."""
    b = c.cast("string").cast("binary")
    return F.coalesce(F.concat(F.octet_length(b).cast("string").cast("binary"), F.lit(b":"), b), F.lit(b"-"))


def leaf_hash(text: Column) -> Column:
    """The digest of a document's fields with ``text`` as its text."""
    return F.sha2(F.concat(*(field(text if name == "text" else F.col(name)) for name in FIELDS)), 256)


def lowered(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, tampered): digests of the rows as they are and as they are checked.

    Where 5 divides the CRC-32 of the decimal doc_id, the text checked has its A-Z in lower case; null ids and null texts stay.
    Only the five fields are read, so extra columns may have any names.
    """
    rows = docs.select(*FIELDS)
    text = F.col("text").cast("string")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    leaf = leaf_hash(text)
    changed = leaf_hash(F.when(hit, lowered(text)).otherwise(text))
    return rows.select("doc_id", F.col("source").cast("string").alias("source"), leaf.alias("leaf"), F.when(hit, changed).otherwise(leaf).alias("tampered"))


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with ``position``, from 0 in each ``tree`` (null is one of its own) by ``order``, nulls first; and ``size``, the tree's rows.

    A range sort deals rows of one tree over tasks; places in a task's part and counts of (part, tree) give
    positions. Rows that agree in all of these columns are exchangeable, so any order of them gives equal results.
    """
    keys = [F.col(c).asc_nulls_first() for c in (tree, *order, "_row")]
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)  # _row splits any number of equal rows
    at = F.monotonically_increasing_id()
    stored = materialize(dealt.select(*rows.columns, F.shiftright(at, 33).cast("int").alias("part"), at.bitwiseAND((1 << 33) - 1).alias("place")), "leaves")
    counts = stored.groupBy("part", F.col(tree).alias("_tree")).agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("low"))
    of = Window.partitionBy("_tree")  # a row a part and tree
    before = F.coalesce(F.sum("n").over(of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select(F.col("part").alias("_part"), "_tree", (before - F.col("low")).alias("_base"), F.sum("n").over(of).alias("size"))
    same = (F.col("part") == F.col("_part")) & F.col(tree).eqNullSafe(F.col("_tree"))
    return stored.join(bases, same).withColumn("position", (F.col("place") + F.col("_base")).cast("long")).drop("part", "place", "_part", "_tree", "_base")


def packed(rows: DataFrame, tree: str, kept: list[str], levels: int) -> DataFrame:
    """(tree, block, size, leaves): one row for each aligned block, ``leaves`` its (position, ``kept`` columns) in order."""
    block = F.floor(F.col("position") / DEGREE**levels).cast("long")
    return rows.groupBy(tree, block.alias("block")).agg(F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct("position", *kept))).alias("leaves"))


def _own_levels(size: int, levels: int) -> int:
    """Levels of a block's tree: of the whole tree if that is one block."""
    return height(size) if size <= DEGREE**levels else levels


def block_roots(blocks: DataFrame, tree: str, levels: int) -> DataFrame:
    """(tree, position, size, leaf): the roots of blocks as the leaves of the next round."""
    kind = blocks.schema[tree].dataType.simpleString()

    def run(batches):
        for batch in batches:
            roots = []
            for size, rows in zip(batch.column("size").to_pylist(), batch.column("leaf")):
                stack = Treehash(_own_levels(size, levels))
                for digest in rows.values.to_pylist():
                    stack.push(digest)
                roots.append(stack.finish())
            yield pa.RecordBatch.from_arrays([batch.column(tree), batch.column("block"), pa.array(roots, pa.string())], names=[tree, "position", "leaf"])

    found = blocks.select(tree, "block", "size", F.col("leaves.leaf").alias("leaf")).mapInArrow(run, f"`{tree}` {kind}, position long, leaf string")
    sizes = blocks.select(F.col(tree).alias("_tree"), F.col("block").alias("_block"), F.ceil(F.col("size") / DEGREE**levels).cast("long").alias("size"))
    return found.join(sizes, F.col(tree).eqNullSafe(F.col("_tree")) & (F.col("position") == F.col("_block"))).select(tree, "position", "size", "leaf")


def block_paths(blocks: DataFrame, tree: str, levels: int) -> DataFrame:
    """(tree, position, path): the path of each leaf to its block's root."""
    kind = blocks.schema[tree].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                part = batch.slice(row, 1)
                digests = part.column("leaf")[0].values.to_pylist()
                paths = [[{"left": a, "right": b} for a, b in p] for p in Traversal(digests, _own_levels(part.column("size")[0].as_py(), levels)).paths()]
                start = part.column("block")[0].as_py() * DEGREE**levels
                n = len(digests)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(tree)[0].as_py()] * n, part.column(tree).type), pa.array(range(start, start + n), pa.int64()), pa.array(paths, _PATH)], names=[tree, "position", "path"])

    return blocks.select(tree, "block", "size", F.col("leaves.leaf").alias("leaf")).mapInArrow(run, f"`{tree}` {kind}, position long, path {PATH}")


def upper(blocks: DataFrame, tree: str, levels: int) -> tuple[DataFrame, DataFrame]:
    """Two tables: (tree, root), and (tree, block, above), each block's path to its tree's root.

    Roots of blocks form blocks in turn, until every tree has one. Each round has 4096 times fewer rows.
    """
    rounds = [materialize(block_roots(blocks, tree, levels), "roots")]
    while (rounds[-1].agg(F.max("size")).first()[0] or 0) > 1:
        now = materialize(packed(rounds[-1], tree, ["leaf"], levels), "blocks")
        rounds[-1] = rounds[-1], now
        rounds.append(materialize(block_roots(now, tree, levels), "roots"))
    roots = rounds.pop().select(tree, F.col("leaf").alias("root"))
    above = roots.select(F.col(tree).alias("_tree"), F.lit(0).cast("long").alias("block"), F.array().cast(PATH).alias("above"))
    for level in reversed(rounds):
        paths = block_paths(level[1], tree, levels)
        up = above.withColumnRenamed("block", "_block")
        same = F.col(tree).eqNullSafe(F.col("_tree")) & (F.floor(F.col("position") / DEGREE**levels) == F.col("_block"))
        above = paths.join(up, same).select(F.col(tree).alias("_tree"), F.col("position").alias("block"), F.concat("path", "above").alias("above"))
        above = materialize(above, "above")
    return roots, above


def proofs(blocks: DataFrame, above: DataFrame, tree: str, levels: int) -> DataFrame:
    """(doc_id, tree, leaf, subroot, root, proof_sha256, folded_root): each leaf's path hashed, and folded from its tampered digest.

    ``above`` is (_tree, block, subroot, root, above). Blocks go through ``Traversal`` leaf by leaf, and the block's shared path is put behind each path.
    """
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema["leaves"].dataType.elementType.fields} | {tree: blocks.schema[tree].dataType.simpleString()}
    names = ["doc_id", tree, "leaf", "subroot", "root", "proof_sha256", "folded_root"]

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                part = batch.slice(row, 1)
                rows, shared = part.column("leaves")[0].values, [(x["left"], x["right"]) for x in part.column("above")[0].as_py()]
                digests, checked = rows.field("leaf").to_pylist(), rows.field("tampered").to_pylist()
                behind = "".join(a + b for a, b in shared).encode()
                hashed, roots = [], []
                for path, leaf in zip(Traversal(digests, _own_levels(part.column("size")[0].as_py(), levels)).paths(), checked):
                    hashed.append(sha256("".join(a + b for a, b in path).encode() + behind).hexdigest())
                    roots.append(folded(folded(leaf, path), shared))
                n = len(digests)
                same = [pa.array([part.column(c)[0].as_py()] * n, part.column(c).type) for c in (tree, "subroot", "root")]
                yield pa.RecordBatch.from_arrays([rows.field("doc_id"), same[0], rows.field("leaf"), *same[1:], pa.array(hashed), pa.array(roots)], names=names)

    same = F.col(tree).eqNullSafe(F.col("_tree")) & (F.col("b") == F.col("block"))
    with_path = blocks.withColumnRenamed("block", "b").join(above, same).select(tree, F.col("b").alias("block"), "size", "leaves", "subroot", "root", "above")
    return with_path.mapInArrow(run, f"doc_id {kinds['doc_id']}, `{tree}` {kinds[tree]}, leaf string, subroot string, root string, proof_sha256 string, folded_root string")


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified) for every row.

    Leaves of a source ascend by doc_id, null first; rows of one id by their digests. Rows equal in all five fields are leaves each,
    with proofs of their own. A null source is a source of its own, the first. An empty table gives no rows.
    """
    hashed = materialize(leaves(docs), "hashed")  # narrow: the range sort samples it, not the texts
    order = ["doc_id", "leaf", "tampered"]
    blocks = materialize(packed(numbered(hashed, "source", order), "source", ["doc_id", "leaf", "tampered"], levels), "blocks")
    drop_table(hashed)
    subroots, within = upper(blocks, "source", levels)
    tops = subroots.select(F.lit(0).alias("all"), "source", F.col("root").alias("leaf"))
    top = materialize(packed(numbered(tops, "all", ["source"]), "all", ["source", "leaf"], levels), "blocks")
    roots, over = upper(top, "all", levels)
    upto = block_paths(top, "all", levels).join(over.withColumnRenamed("block", "_block"), F.floor(F.col("position") / DEGREE**levels) == F.col("_block"))
    names = top.select("all", F.explode("leaves").alias("x")).select("all", "x.position", F.col("x.source").alias("_source"), F.col("x.leaf").alias("subroot"))
    by_source = names.join(upto.select(F.col("position").alias("_at"), F.concat("path", "above").alias("over")), F.col("position") == F.col("_at"))
    by_source = materialize(by_source.join(F.broadcast(roots), "all").select("_source", "subroot", "root", "over"), "sources")  # one root
    shared = within.join(by_source, F.col("_tree").eqNullSafe(F.col("_source"))).select("_tree", "block", "subroot", "root", F.concat("above", "over").alias("above"))
    found = proofs(blocks, shared, "source", levels)
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents")).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
