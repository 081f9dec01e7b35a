"""Sequencing tables derived from the star-schema tables, so that every engine can build the same rows.

``reference``: one row, the bases of ``supplier`` keys in order. ``customer_reads``: slices of the
reference, some with a changed base, a run of N, or on the other strand. ``order_reads``:
whole FASTQ records. ``order_quals``: quality strings with long runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocked

HEX, ACGT = "0123456789abcdef", "ACGTACGTACGTACGT"
QUAL = "HHHHHHGGGGFFE#I<"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref): a reference is bounded by 2**32 bases, so it is one value."""
    return spark.sql(f"select listagg(translate(md5(cast(s_suppkey as string)), '{HEX}', '{ACGT}'), '') within group (order by s_suppkey) as ref from {{t}}", t=table(spark, sf_dir, "supplier"))


def reference_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_no, line): the same bases as FASTA lines, one a supplier."""
    return table(spark, sf_dir, "supplier").selectExpr("cast(s_suppkey as bigint) as line_no", f"translate(md5(cast(s_suppkey as string)), '{HEX}', '{ACGT}') as line")


#: What a customer's slice ``b`` of the reference becomes.
_CHANGED = """
c as (select k, l, case when k % 5 = 0 then concat(substr(s, 1, cast(k % l as int)), translate(substr(s, cast(1 + k % l as int), 1), 'ACGT', 'CGTA'), substr(s, cast(2 + k % l as int))) else s end as s from b),
d as (select k, l, case when k % 7 = 0 then concat(substr(s, 1, 14), repeat('N', cast(1 + k % 3 as int)), substr(s, cast(16 + k % 3 as int))) else s end as s from c)
select k as read_id, case when k % 3 = 0 then reverse(translate(s, 'ACGT', 'TGCA')) else s end as seq from d"""

_CUSTOMER = """
with a as (select c_custkey as k, 30 + c_custkey % 31 as l, {ref} as ref from {customer}),
b as (select k, l, substr(ref, cast(1 + (k * 37) % (length(ref) - 61) as int), cast(l as int)) as s from a),""" + _CHANGED

_META = "concat('@ERR.', cast(k + 1 as {string}), ' ', st, ':', cast(cust as {string}), '#1') as meta"
_MARKS = """
case when k % 4 = 0 then '-' else '+' end as strand,
substr(concat(case when k % 11 = 0 then '@' else 'H' end, repeat('H', cast(k % 25 as int)), translate(md5(cast(k as {string})), '{HEX}', '{QUAL}'), repeat('G', 64)), 1, cast(30 + k % 31 as int)) as qual
from """
_ORDERS = """
with a as (select o_orderkey as k, {ref} as ref, o_orderstatus as st, o_custkey as cust from {orders})
select k as read_id,
""" + _META + """,
substr(ref, cast(1 + (k * 37) % (length(ref) - 61) as int), cast(30 + k % 31 as int)) as seq,""" + _MARKS + "a"

_QUALS = "select o_orderkey as read_id, concat(repeat(chr(cast(33 + o_orderkey % 40 as int)), cast(o_orderkey % 131 as int)), translate(md5(cast(o_orderkey as {string})), '{HEX}', '{QUAL}'), repeat('H', cast(o_orderkey % 64 as int))) as qual from {orders}"

#: FASTA lines: a header for every tenth supplier, lower case, short and long runs of N, an ambiguity letter.
_FASTA = """
select s_suppkey * 2 + 1 as line_no, concat(case when s_suppkey % 2 = 0 then lower({bases}) else {bases} end,
case when s_suppkey % 3 = 0 then repeat('N', 6) when s_suppkey % 5 = 0 then repeat('n', 14) when s_suppkey % 7 = 0 then 'RYK' else '' end,
case when s_suppkey % 6 = 5 then repeat('N', 6) else '' end) as line from {supplier}
union all select s_suppkey * 2 as line_no, concat('>contig', cast(s_suppkey as {string}), ' NNN acgt') as line from {supplier} where s_suppkey % 10 = 0"""


def reference_blocks(spark: SparkSession, sf_dir: str, size: int = blocked.SIZE) -> DataFrame:
    """(block, bases): ``reference`` in blocks of ``size`` bases, which no cell holds whole."""
    lines = reference_lines(spark, sf_dir).where("line is not null")
    return blocked.in_blocks(lines.select("line_no", F.lit(0).alias("piece"), F.col("line").alias("s")), size)


#: Letters of the longest slice, and of the blocks that slices are cut from.
_LONGEST, _SLICED = 60, 256


def _sliced(spark: SparkSession, sf_dir: str, keys: DataFrame) -> DataFrame:
    """``keys`` (k, l, others) with ``s``: the l letters of the reference from 1 + k * 37 % (its length - 61), as the SQL's ``substr`` gives them.

    Each row meets the block that its slice starts in, which holds the first letters of the next one too: time goes with the rows, not with the
    rows times the reference's length.
    """
    blocks = reference_blocks(spark, sf_dir, _SLICED)
    held = blocked.behind(blocks, "bases", _LONGEST).select("block", F.concat("bases", F.coalesce("more", F.lit(""))).alias("bases"))
    n = "(select sum(length(line)) from {lines})"
    placed = spark.sql(f"select *, 1 + (k * 37) % ({n} - 61) as p, {n} as n from {{keys}}", keys=keys, lines=reference_lines(spark, sf_dir))
    at = F.expr("case when p > 0 then p - 1 when p < 0 then n + p else 0 end")  # places below 0 count from the end
    placed = placed.withColumn("at", at).withColumn("in", F.expr(f"at div {_SLICED}"))
    joined = placed.join(held, F.col("in") == F.col("block"), "left")
    return joined.select(*keys.columns, F.expr(f"substr(bases, cast(at % {_SLICED} + 1 as int), cast(l as int))").alias("s"))


def customer_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "customer").selectExpr("c_custkey as k", "30 + c_custkey % 31 as l").repartition(4 * spark.sparkContext.defaultParallelism, "k")  # a small file whose rows are far more work than the reading
    return spark.sql("with b as (select * from {b})," + _CHANGED, b=_sliced(spark, sf_dir, keys))


def order_reads(spark: SparkSession, sf_dir: str, seq: bool = True) -> DataFrame:
    """FASTQ records; without ``seq`` their other columns, for which nothing is joined."""
    keys = table(spark, sf_dir, "orders").selectExpr("o_orderkey as k", "30 + o_orderkey % 31 as l", "o_orderstatus as st", "o_custkey as cust")
    text = "select k as read_id, " + _META + "," + (" s as seq," if seq else "") + _MARKS + "{{b}}"
    return spark.sql(text.format(string="string", HEX=HEX, QUAL=QUAL), b=_sliced(spark, sf_dir, keys) if seq else keys)


def order_quals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_QUALS.format(orders="{t}", string="string", HEX=HEX, QUAL=QUAL), t=table(spark, sf_dir, "orders"))


def fasta_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    bases = f"translate(md5(cast(s_suppkey as string)), '{HEX}', '{ACGT}')"
    return spark.sql(_FASTA.format(bases=bases, supplier="{t}", string="string"), t=table(spark, sf_dir, "supplier"))


#: The same tables as named subqueries for a SQL engine that has the star-schema tables as views.
SQL = {
    "ref": f"select string_agg(translate(md5(cast(s_suppkey as varchar)), '{HEX}', '{ACGT}'), '' order by s_suppkey) as ref from supplier",
    "creads": _CUSTOMER.format(ref="(select ref from ref)", customer="customer"),
    "oreads": _ORDERS.format(ref="(select ref from ref)", orders="orders", string="varchar", HEX=HEX, QUAL=QUAL),
    "quals": _QUALS.format(orders="orders", string="varchar", HEX=HEX, QUAL=QUAL),
    "fasta": _FASTA.format(bases=f"translate(md5(cast(s_suppkey as varchar)), '{HEX}', '{ACGT}')", supplier="supplier", string="varchar"),
}


def with_tables(names: str, body: str, recursive: bool = False) -> str:
    """``body`` behind the named subqueries it needs; reads need ``ref`` first."""
    parts = ", ".join(f"{n} as ({SQL[n]})" for n in names.split())
    return f"with {'recursive ' if recursive else ''}{parts}{', ' if body.startswith('+') else ' '}{body.removeprefix('+')}"
