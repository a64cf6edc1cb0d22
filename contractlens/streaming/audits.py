"""The audit as a stream: findings and summary of a batch are committed together, once.

A batch writes its findings and its summary as partitions of its own and then a mark; only marked
batches are read.  A batch that is run again, after a failure or a lost driver, writes the same
partitions and the same mark.  Documents that come a second time within the watermark's delay are
left out by state, so a finding is reported once.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from contractlens.plans.audit import audit

ENOUGH = "enough documents with findings"


class Enough(Exception):
    """Raised in a sink before a batch is read, so that the batch stays open for a later run."""


def once(docs: DataFrame, ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """A stream of documents (doc_id, ts), each doc_id once within the delay."""
    return docs.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["doc_id"])


def _write(df: DataFrame, path: str, number: int) -> None:
    df.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def committed(spark: SparkSession, path: str, name: str) -> DataFrame:
    """``findings`` or ``summary`` of the batches that are marked, with their number."""
    marks = spark.read.schema("marked long, documents long, batch long").parquet(f"{path}/marks").select(F.col("batch").alias("marked"))  # a row for each batch
    rows = spark.read.option("mergeSchema", "true").parquet(f"{path}/{name}")
    return rows.join(F.broadcast(marks), F.col("batch") == F.col("marked"), "left_semi")


def found(spark: SparkSession, path: str) -> int:
    """How many documents with findings the marked batches hold."""
    try:
        return spark.read.schema("marked long, documents long, batch long").parquet(f"{path}/marks").agg(F.sum("documents")).first()[0] or 0
    except Exception as e:  # nothing is marked yet
        if "PATH_NOT_FOUND" in str(e):
            return 0
        raise


def audit_stream(
    docs: DataFrame,
    acts: DataFrame | None,
    path: str,
    checkpoint: str,
    most: int | None = None,
    work: Callable[[DataFrame, DataFrame | None], tuple[DataFrame, DataFrame]] = audit,
) -> StreamingQuery:
    """Audits a stream of documents (doc_id, doc_type, text) below path, batch by batch.

    With most the stream ends before the first batch that comes once so many documents have
    findings: that batch is neither read nor marked, and :func:`finished` tells it from an error.
    """
    spark, lock = docs.sparkSession, threading.Lock()

    def sink(batch: DataFrame, number: int) -> None:
        with lock:
            if most is not None and found(spark, path) >= most:
                raise Enough(ENOUGH)
            findings, summary = work(batch.select("doc_id", "doc_type", "text"), acts)
            _write(findings, f"{path}/findings", number)
            _write(summary, f"{path}/summary", number)
            documents = spark.read.parquet(f"{path}/summary").where((F.col("batch") == number) & (F.col("flagged") > 0)).count()
            _write(spark.createDataFrame([(number, documents)], "marked long, documents long"), f"{path}/marks", number)

    return docs.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finished(query: StreamingQuery, seconds: float | None = None) -> bool:
    """Waits for a stream; true if all was read, false if it ended early as it had enough."""
    try:
        query.awaitTermination(seconds) if seconds else query.awaitTermination()
    except StreamingQueryException as e:
        if ENOUGH not in str(e):
            raise
        return False
    return True
