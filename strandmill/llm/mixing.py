"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Every document gets a rate: the copies expected of it. Among all rates between 0 and
``most`` whose words add up to each source's target, the ones closest to 1 in
relative entropy are min(most, exp(lambda * size)), one lambda a source: the solution
of a convex dual, found by Newton steps over the table of (source, size, documents),
which is counted once. A bracket around each lambda keeps steps safe where rates hit
the bound. Rates become whole copies by systematic rounding along sizes, so a source's
error stays below one document, and exchanges of single copies, also between pairs of
sizes, go on until none brings a source nearer its target.

Sums run over integers and decimals, so their order doesn't matter and reruns agree.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import PART_ROWS, WORD, drop_table, enclosed, extra_key, materialize, ranked, repeated

EXACT = "decimal(38,6)"


KEYS = ["doc_id", "source", "text_key", "extra_key"]


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, text_key, extra_key, size): words of every whole text, null texts 0. extra_key is a hash of what ``enclosed`` put aside."""
    text = F.col("text").cast("string")
    count = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    extra = extra_key(docs) if "_extra" in docs.columns else F.lit(0).cast("long")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("text_key"), extra.alias("extra_key"), count.alias("size"))


def targets(cells: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from rows (source, size, n).

    Sources in code-point order, null last, take ``weights`` in turn. Each target is its
    weight's part of ``share`` of all words, but at most ``most`` times the source's own
    words; what is cut off goes to the others by weight. That fixed point is read off
    the sources ordered by cap over weight: those below the water level are capped.
    """
    by_source = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    table = by_source.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    below = level.rowsBetween(Window.unboundedPreceding, -1)
    onward = level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    table = table.withColumn("height", (total - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("weight").over(onward))
    table = table.withColumn("free", F.col("height") * F.col("weight") < F.col("cap"))
    # The first source that stays below its cap sets the height for itself and all after it.
    water = F.min(F.when(F.col("free"), F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("height").alias("height")))).over(everything)
    table = table.withColumn("water", water["height"])
    target = F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("water") * F.col("weight")))
    return table.select("source", "source_size", target.alias("target"))


def _rate(lam: Column, size: Column, unit: Column, most: float) -> Column:
    """min(most, exp(lambda * size / unit)), without overflow."""
    return F.least(F.lit(float(most)), F.exp(F.least(lam * size / unit, F.lit(5.0))))


def tilts(cells: DataFrame, wanted: DataFrame, most: float = 2.0, tolerance: float = 1e-7) -> DataFrame:
    """(source, source_size, target, unit, lam, full): the dual's solution for every source, within ``tolerance`` of its target or
    a hundredth of a word.

    Newton's steps stay in a bracket around the solution. Where they would leave it, and at every fourth step, the bracket is
    bisected, so the loop ends; a bracket without a number between its ends is an error.

    ``unit`` is the source's largest size; ``full`` marks sources whose target needs every
    document at ``most`` (lambda would be infinite).
    """
    unit = cells.groupBy(F.col("source").alias("_s")).agg(F.greatest(F.max("size"), F.lit(1)).cast("double").alias("unit"))
    state = wanted.join(unit, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    full = (F.col("target") > 0) & (F.col("target") >= F.col("source_size") * F.lit(float(most)) * (1 - 1e-9))
    state = state.withColumns({"full": full, "lam": F.lit(0.0), "low": F.lit(None).cast("double"), "high": F.lit(None).cast("double"), "gap": F.lit(1.0)})
    state = materialize(state, "dual")
    for step in count():
        part = cells.select(F.col("source").alias("_s"), "size", "n").join(state.where("not full"), F.col("_s").eqNullSafe(F.col("source")))
        rate = _rate(F.col("lam"), F.col("size"), F.col("unit"), most)
        words = F.col("n") * F.col("size")
        bent = F.when(rate < most, words * rate * F.col("size") / F.col("unit")).otherwise(F.lit(0.0))
        sums = part.groupBy("_s").agg(F.sum((words * rate).cast(EXACT)).alias("f"), F.sum(bent.cast(EXACT)).alias("h"))
        f, h = F.col("f").cast("double"), F.col("h").cast("double")
        joined = state.join(sums, F.col("source").eqNullSafe(F.col("_s")), "left")
        low = F.when(f < F.col("target"), F.col("lam")).otherwise(F.col("low"))
        high = F.when(f >= F.col("target"), F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") + (F.log(F.col("target")) - F.log(f)) * f / h  # Newton's step for the logarithm of the words
        inside = F.lit(step % 4 != 3) & (h > 0) & (F.col("low2").isNull() | (newton > F.col("low2"))) & (F.col("high2").isNull() | (newton < F.col("high2")))
        wide = F.when(F.col("low2").isNull(), F.least(F.col("high2") * 2, F.col("high2") - 1)).when(F.col("high2").isNull(), F.greatest(F.col("low2") * 2, F.col("low2") + 1)).otherwise((F.col("low2") + F.col("high2")) / 2)
        stay = F.col("full") | F.col("f").isNull() | (F.col("target") <= 0)
        moved = joined.withColumns({"low2": low, "high2": high}).withColumn("gap", F.when(stay, F.lit(0.0)).otherwise(F.greatest(F.abs(f - F.col("target")) - 0.01, F.lit(0.0)) / F.col("target")))
        moved = moved.withColumn("lam2", F.when(stay | (F.col("gap") <= tolerance), F.col("lam")).when(inside, newton).otherwise(wide))
        after = materialize(moved.select("source", "source_size", "target", "unit", "full", F.col("lam2").alias("lam"), F.col("low2").alias("low"), F.col("high2").alias("high"), "gap"), "dual")
        drop_table(state)
        state = after
        gap, stuck = state.agg(F.max("gap"), F.max((F.col("gap") > tolerance) & ((F.col("lam") == F.col("low")) | (F.col("lam") == F.col("high"))))).first()
        if (gap or 0) <= tolerance:
            break
        if stuck:
            raise ValueError(f"no rates bring every source within {tolerance} of its target")
    return state.drop("low", "high", "gap")


def copies(cells: DataFrame, dual: DataFrame, most: float = 2.0) -> DataFrame:
    """(source, size, n, total): whole copies for all documents of each source and size.

    Along rising sizes, each cell takes the difference of the rounded running sums of
    rates (in millionths). Sources that miss (or have too many) words for their longest document move copies
    at the largest size they can, and at last ``exchanged`` moves single copies.
    """
    part = cells.join(dual.select(F.col("source").alias("_s"), "target", "unit", "lam", "full"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rate = F.when(F.col("full"), F.lit(float(most))).otherwise(_rate(F.col("lam"), F.col("size"), F.col("unit"), most))
    part = part.withColumn("micro", F.col("n") * F.round(rate * 1_000_000).cast("long"))
    order = Window.partitionBy("source").orderBy("size")
    after = F.sum("micro").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rounded = lambda c: F.floor((c + 500_000) / 1_000_000)
    room = (F.col("n") * F.lit(int(most))).cast("long")
    total = F.greatest(F.lit(0), F.least(room, rounded(after) - rounded(after - F.col("micro")))).cast("long")
    now = materialize(part.select("source", "size", "n", "target", total.alias("total")), "copies")
    while True:
        taken = now.groupBy("source").agg(F.sum(F.col("total") * F.col("size")).alias("taken"), F.max("target").alias("t"), F.max("size").alias("most"))
        short = taken.select(F.col("source").alias("_s"), (F.col("t") - F.col("taken")).cast("long").alias("short"), "most").where(F.abs("short") >= F.col("most"))
        able = now.where("size > 0").join(short, F.col("source").eqNullSafe(F.col("_s")))
        able = able.where(F.when(F.col("short") > 0, F.col("total") < room).otherwise(F.col("total") > 0) & (F.col("size") <= F.abs("short")))
        best = able.groupBy("_s").agg(F.max("size").alias("at"), F.max("short").alias("short"))
        joined = now.join(best, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("at")), "left")
        step = F.floor(F.abs("short") / F.col("size"))
        change = F.when(F.col("at").isNull(), F.lit(0)).when(F.col("short") > 0, F.least(step, room - F.col("total"))).otherwise(-F.least(step, F.col("total")))
        after = materialize(joined.select("source", "size", "n", "target", (F.col("total") + change).cast("long").alias("total"), change.alias("change")), "copies")
        drop_table(now)
        now = after
        if not now.agg(F.max(F.col("change") != 0)).first()[0]:
            return exchanged(now.drop("change"), most)


_MOVE = "struct<words: bigint, add: bigint, take: bigint>"


def _moves(deep: bool, room: Column, sizes: int) -> tuple[Column, Column]:
    """The moves a row offers, and those it asks a partner for: (change in words, size to add, size to take away, 0 for none).

    Each size offers a copy more and asks with a copy less. ``deep``: the first row of a source offers and asks with all pairs
    of ``sizes`` of its sizes. The first row also brings the move that changes nothing.
    """
    move = lambda add, take: F.struct((add - take).cast("long").alias("words"), add.cast("long").alias("add"), take.cast("long").alias("take"))
    zero, none = F.lit(0), F.array().cast(f"array<{_MOVE}>")
    first = F.col("_first") == 1
    idle = F.when(first, F.array(move(zero, zero))).otherwise(none)
    able, full = (F.col("size") > 0) & (F.col("total") < room), (F.col("size") > 0) & (F.col("total") > 0)
    if not deep:
        return F.concat(idle, F.when(able, F.array(move(F.col("size"), zero))).otherwise(none)), F.concat(idle, F.when(full, F.array(move(zero, F.col("size")))).otherwise(none))
    whole = Window.partitionBy("source")
    some = F.col("_first") <= sizes
    adds, takes = (F.concat(F.array(zero.cast("long")), F.collect_list(F.when(some & ok, F.col("size"))).over(whole)) for ok in (able, full))
    pairs = F.when(first, F.flatten(F.transform(adds, lambda x: F.transform(takes, lambda y: move(x, y))))).otherwise(none)
    return pairs, pairs


def exchanged(now: DataFrame, most: float = 2.0, sizes: int = 40) -> DataFrame:
    """(source, size, n, total) from (source, size, n, target, total): each source adds a copy at one size and takes one away at another
    (either may be none) until no such pair of sizes brings it nearer its target.

    Then a source still half a word off tries two pairs at once, among ``sizes`` of its sizes (by their hashes), as
    sources of few documents need that, until none moves.

    A round deals the sizes by source once. In one order of words, an offered move stands at its words and an asking one at what it leaves of
    the source's gap, so the best partner is a neighbour and no pairs of moves are made.
    """
    whole = Window.partitionBy("source")
    line = whole.orderBy("_v", "_kind", "_move")
    columns, deep = ["source", "size", "n", "target", "total"], False
    room = F.col("n") * F.lit(int(most))
    while True:
        rows = now.withColumns({"_gap": F.max("target").over(whole) - F.sum(F.col("total") * F.col("size")).over(whole), "_first": F.row_number().over(whole.orderBy(F.xxhash64("size"), "size"))})
        offered, asked = _moves(deep, room, sizes)
        rows = rows.withColumns({"_offered": offered, "_asked": asked})
        open_ = F.abs("_gap") > 0.5
        kinds = F.concat(  # the row itself, what it offers, and what it asks with
            F.array(F.struct(F.lit(0).alias("kind"), F.lit(None).cast("double").alias("v"), F.lit(None).cast(_MOVE).alias("move"))),
            F.transform(F.when(open_, F.col("_offered")).otherwise(F.array().cast(f"array<{_MOVE}>")), lambda m: F.struct(F.lit(1).alias("kind"), m["words"].cast("double").alias("v"), m.alias("move"))),
            F.transform(F.when(open_, F.col("_asked")).otherwise(F.array().cast(f"array<{_MOVE}>")), lambda m: F.struct(F.lit(2).alias("kind"), (F.col("_gap") - m["words"]).alias("v"), m.alias("move"))),
        )
        each = rows.select(*columns, "_gap", F.explode(kinds).alias("_x")).select(*columns, "_gap", F.col("_x.kind").alias("_kind"), F.col("_x.v").alias("_v"), F.col("_x.move").alias("_move"))
        option = F.when(F.col("_kind") == 1, F.col("_move"))
        near = each.withColumns({"_below": F.last(option, True).over(line.rowsBetween(Window.unboundedPreceding, 0)), "_above": F.first(option, True).over(line.rowsBetween(0, Window.unboundedFollowing))})

        def with_(other: str) -> Column:
            apart = [(F.col(f"_move.{k}") == 0) | (F.col(f"_move.{k}") != F.col(f"{other}.{k}")) for k in ("add", "take")]
            left = F.abs(F.col("_gap") - F.col("_move.words") - F.col(f"{other}.words"))
            return F.when((F.col("_kind") == 2) & F.col(other).isNotNull() & apart[0] & apart[1], F.struct(left.alias("left"), F.col("_move").alias("one"), F.col(other).alias("two")))

        best = F.min(F.least(with_("_below"), with_("_above"))).over(whole)
        done = near.withColumn("_best", best).where("_kind = 0")
        better = F.coalesce(F.col("_best.left") + 0.001 < F.abs("_gap"), F.lit(False))
        change = sum(((F.col("size") == F.col(f"_best.{m}.{k}")).cast("long") * way for m in ("one", "two") for k, way in (("add", 1), ("take", -1))), F.lit(0))
        change = F.when(better & (F.col("size") > 0), change).otherwise(F.lit(0)).cast("long")
        left = F.when(better, F.col("_best.left")).otherwise(F.abs("_gap"))
        after = materialize(done.select("source", "size", "n", "target", (F.col("total") + change).alias("total"), change.alias("change"), left.alias("left")), "copies")
        drop_table(now)
        moved, left = after.agg(F.max(F.col("change") != 0), F.max("left")).first()
        now = after.select(*columns)
        if (left or 0) <= 0.5 or (not moved and deep):
            return now.select("source", "size", "n", "total")
        deep = deep or not moved


def shares(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """(KEYS, size, rows, source_size, target, each, more): one row for all rows that agree in ``KEYS``.

    All of them get ``each`` copies and ``more`` of them one more. So rows that repeat any number of times are one row here.
    """
    alike = materialize(sizes(docs).groupBy(*KEYS, "size").agg(F.count(F.lit(1)).alias("rows")), "sizes")
    cells = materialize(alike.groupBy("source", "size").agg(F.sum("rows").cast("long").alias("n")), "cells")
    dual = tilts(cells, targets(cells, weights, share, most), most)
    whole = copies(cells, dual, most)
    per_source = dual.select(F.col("source").alias("_s"), "source_size", "target")
    table = materialize(whole.join(per_source, F.col("source").eqNullSafe(F.col("_s"))).select(F.col("source").alias("_source"), F.col("size").alias("_size"), "n", "total", "source_size", "target"), "mix")
    joined = alike.join(table, F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")))
    parts = F.ceil(F.col("n") / PART_ROWS)
    joined = ranked(joined, ["source", "size"], [F.xxhash64("doc_id", "text_key", "extra_key"), F.col("doc_id"), F.col("text_key"), F.col("extra_key")], parts, "rows")
    more = F.greatest(F.lit(0), F.least(F.col("rows"), F.expr("total % n") - F.col("rank")))
    done = materialize(joined.select(*KEYS, "size", "rows", "source_size", "target", F.expr("total div n").alias("each"), more.cast("long").alias("more")), "shares")
    for scratch in (alike, cells, dual, whole, table):
        drop_table(scratch)
    return done


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """(doc_id, source, text_key, size, source_size, target, copies) for every row of ``docs``.

    Null texts have size 0; null sources form one source, the last. Within a source and size
    copies differ by one at most, and go first to the rows with the smallest hash of all columns.
    Rows equal in all of them are counted as one and dealt out again in chunks.
    A source without words has target 0, and each of its documents goes in once. Extra columns may have any names.
    """
    found = shares(enclosed(docs, "doc_id", "text", "source")[0], weights, share, most)
    copies = (F.col("each") + F.when(F.col("_i") < F.col("more"), 1).otherwise(0)).cast("long").alias("copies")
    columns = ["doc_id", "source", "text_key", "size", "source_size", "target", copies]
    single = found.where("rows = 1").withColumn("_i", F.lit(0)).select(*columns)
    return single.unionByName(repeated(found.where("rows > 1"), "rows", "_i", KEYS).select(*columns))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it. Rows that agree in all columns share their copies."""
    inner, back = enclosed(docs, "doc_id", "text", "source")
    plan = shares(inner, weights, share, most)
    taken = plan.select(*(F.col(k).alias(f"_{k}") for k in KEYS), "rows", (F.col("rows") * F.col("each") + F.col("more")).alias("_n")).where("_n > 0")
    same = inner["doc_id"].eqNullSafe(F.col("_doc_id")) & inner["source"].cast("string").eqNullSafe(F.col("_source")) & (F.xxhash64(inner["text"]) == F.col("_text_key")) & (extra_key(inner) == F.col("_extra_key"))
    keyed = [f"_{k}" for k in KEYS]
    one = inner.join(taken.where("rows = 1"), same).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select(*inner.columns)
    if taken.where("rows > 1").limit(1).count():  # a table of few narrow columns
        alike = inner.join(taken.where("rows > 1"), same).groupBy(*keyed).agg(F.any_value(F.struct(*inner.columns)).alias("r"), F.max("_n").alias("_n"))
        one = one.unionByName(repeated(alike, "_n", "_copy", keyed).select("r.*"))
    return back(one)


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    found = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")
