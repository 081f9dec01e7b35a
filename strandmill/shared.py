"""The folder that driver and executors share, for checkpoints and for tables that are read back."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. A session in one process without one takes a local folder; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="strandmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def checkpoints(spark: SparkSession) -> None:
    """Let checkpoints go to the shared folder."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder(spark))


def path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{folder(spark)}/strandmill-{name}-{uuid.uuid4().hex}"


def before(counts: DataFrame, key: str, n: str, into: str, group: str | None = None, span: int = 4096) -> DataFrame:
    """``counts`` with the sum of ``n`` over all smaller (group, key). ``key`` is an integer, once in each group.

    Keys are added up inside spans of ``span`` first, so the one window over everything has a row a
    span and not a row a key.
    """
    outer = [group] if group else []
    cut = counts.withColumn("_span", F.expr(f"cast(`{key}` as bigint) div {span}"))
    ahead = Window.partitionBy(*outer, "_span").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    spans = cut.groupBy(*(F.col(g).alias("_g") for g in outer), F.col("_span").alias("_s")).agg(F.sum(n).alias("_n"))
    whole = Window.orderBy(*(["_g"] if group else []), "_s").rowsBetween(Window.unboundedPreceding, -1)
    bases = spans.select(*(["_g"] if group else []), "_s", F.coalesce(F.sum("_n").over(whole), F.lit(0)).alias("_base"))
    same = F.col("_span") == F.col("_s")
    if group:
        same &= F.col(group).eqNullSafe(F.col("_g"))
    local = cut.withColumn("_in", F.coalesce(F.sum(n).over(ahead), F.lit(0)))
    return local.join(bases, same).withColumn(into, (F.col("_in") + F.col("_base")).cast("long")).drop("_span", "_in", "_s", "_g", "_base")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of the written table, which is deleted when the driver ends."""
    spark = df.sparkSession
    at = path(spark, name)
    df.write.option("compression", "zstd").parquet(at)
    folder_ = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    folder_.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder_)
    return spark.read.schema(df.schema).parquet(at)


def ordered(rows: DataFrame, keys: list[str], into: str, flag: str | None = None, flagged: str | None = None) -> DataFrame:
    """``rows`` with ``into``: the number of rows before each in the order of ``keys``, which differ in all rows; and with ``flagged``, the
    sum of ``flag`` (0 or 1) over these.

    A range sort deals the rows, each task counts its own in order, and a window over one row a task adds up the tasks.
    """
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    names = rows.columns

    def run(batches):
        part, at, ones = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            n = b.num_rows
            set_ = b.column(flag).to_numpy().astype(np.int64) if flag else np.zeros(n, np.int64)
            upto = ones + np.cumsum(set_)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(at + np.arange(n)), pa.array(upto - set_)], names=[*names, "_part", "_at", "_ones"])
            at += n
            ones = int(upto[-1]) if n else ones

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    stored = materialize(dealt.mapInArrow(run, f"{kinds}, _part int, _at long, _ones long"), "ordered")
    totals = stored.groupBy(F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"), (F.sum(flag) if flag else F.lit(0)).alias("_m"))
    ahead = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    bases = totals.select("_p", *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).cast("long").alias(f"{c}_base") for c in ("_n", "_m")))
    joined = stored.join(bases, F.col("_part") == F.col("_p"))
    more = [(F.col("_ones") + F.col("_m_base")).alias(flagged)] if flagged else []
    return joined.select(*names, (F.col("_at") + F.col("_n_base")).alias(into), *more)
