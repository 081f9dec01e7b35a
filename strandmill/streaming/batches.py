"""Micro-batches: totals over an event stream, and read batches with state carried between them.

State is the header schema and dictionary of a batch and 189 symbol frequencies. Both are
replaced when a batch no longer fits them, and are kept in a shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from ..operators import metadata, quality


def totals_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_type, n, first_event, last_event, chars) over the whole stream, by an incremental aggregate."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    glob = "events.parquet"
    stream = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(sf_dir) if not _is_dir(spark, f"{sf_dir}/{glob}") else spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/{glob}")
    totals = stream.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), F.sum(F.length("props")).cast("long").alias("chars"))
    name = f"totals_{uuid.uuid4().hex}"
    run = totals.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", shared.path(spark, "stream")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


LOG = "batch long, reads long, total_reads long, kept boolean, same boolean, cost long, schema_batch long, model array<long>"


class ReadBatches:
    """Encodes batches of reads (read_id, meta, qual) in order, for ``foreachBatch`` or a loop.

    After each batch ``log`` gains a row: batch, reads, total_reads, whether the schema was
    kept, whether the quality model was kept, and the cost under the model in tenths of bits
    a score. A batch with a header that the schema can't encode brings a new schema; one whose
    cost is above ``threshold`` brings a new model.

    With ``path``, a folder that driver and executors share, state outlives the driver: schema and dictionary are tables of the batch
    that brought them (a dictionary never comes to the driver), and the log's row, with the model's 190 counts, is
    written last and commits the batch. A new object on the same path goes on behind the last committed batch; a batch that was
    cut off is done again from its start.
    """

    def __init__(self, threshold: int = 40, path: str | None = None, spark: SparkSession | None = None):
        self.threshold, self.total, self.log = threshold, 0, []
        self.kinds: DataFrame | None = None
        self.words: DataFrame | None = None
        self.model: list[int] | None = None
        self._last, self._schema_batch, self._path = -1, -1, path
        spark = spark or SparkSession.getActiveSession()
        if path and spark is not None:
            self._resume(spark)

    def _resume(self, spark: SparkSession) -> None:
        """Take up what the last committed batch left."""
        if not _exists(spark, f"{self._path}/log"):
            return
        rows = spark.read.schema(LOG).parquet(f"{self._path}/log").orderBy("batch").collect()  # a row a batch
        self.log = [tuple(r)[:6] for r in rows]
        if rows:
            self._last, self.total, self._schema_batch, self.model = rows[-1].batch, rows[-1].total_reads, rows[-1].schema_batch, rows[-1].model
            self._read_schema(spark)

    def _read_schema(self, spark: SparkSession) -> None:
        if self._schema_batch >= 0:
            self.kinds = metadata.frozen(spark.read.parquet(f"{self._path}/kinds/{self._schema_batch}"))  # a row a field
            self.words = spark.read.parquet(f"{self._path}/words/{self._schema_batch}")

    def _learn_schema(self, reads: DataFrame, batch: int) -> None:
        spark = reads.sparkSession
        self._path = self._path or shared.path(spark, "batches")
        kinds = metadata.frozen(metadata.schema(reads))
        kinds.write.mode("overwrite").parquet(f"{self._path}/kinds/{batch}")
        metadata.dictionary(reads, kinds, used=True).write.mode("overwrite").parquet(f"{self._path}/words/{batch}")
        self._schema_batch = batch
        self._read_schema(spark)

    def cost(self, quals: DataFrame) -> int:
        """Ten times the bits a score that the model spends on ``quals``."""
        import math

        counts = quality.symbols(quals).groupBy("symbol").count().collect()  # 189 rows at most
        scores = quals.agg(F.sum(F.length("qual"))).first()[0] or 1
        bits = sum(r[1] * math.log2(self.model[-1] / (self.model[r[0] + 1] - self.model[r[0]])) for r in counts)
        return int(bits * 10 / scores)

    def __call__(self, reads: DataFrame, batch: int) -> None:
        if batch <= self._last:  # a repeated batch after a restart changes nothing
            return
        reads = reads.persist()
        try:
            n = reads.count()
            kept = self.kinds is not None and metadata.violations(reads, self.kinds, self.words).limit(1).count() == 0
            if not kept and n:
                self._learn_schema(reads, batch)
            same = self.model is not None and self.cost(reads) <= self.threshold
            if not same and n:
                self.model = quality.smoothed(quality.cumulative(quality.symbols(reads)))
            row = (batch, n, self.total + n, kept, same, self.cost(reads) if n else 0)
            if self._path:
                reads.sparkSession.createDataFrame([(*row, self._schema_batch, self.model)], LOG).coalesce(1).write.mode("append").parquet(f"{self._path}/log")
            self.total += n
            self.log.append(row)
            self._last = batch
        finally:
            reads.unpersist()
