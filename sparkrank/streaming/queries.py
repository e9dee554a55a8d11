"""Structured Streaming: progressive top-k, log tails and event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sparkrank.operators.lexical import ranking


def tail_log(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """Records of a log folder as they come; a checkpoint resumes after the last one handled."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def progressive_top_k(scored: DataFrame, k: int, checkpoint: str, state: str, emit: Callable[[DataFrame, int], None], doc_id: str = "doc_id") -> StreamingQuery:
    """Full snapshots of the best k rows so far, with a revision that grows by batch; ends when the source is read.

    scored: a streaming (doc_id, score). The k rows between two batches are a table of their own
    in `state`, a folder per revision, so a batch that is run again finds what it found before.
    """
    spark = scored.sparkSession

    def step(batch: DataFrame, revision: int) -> None:
        rows = batch.select(doc_id, "score")
        if revision > 0:
            rows = rows.unionByName(spark.read.parquet(f"{state}/revision={revision - 1}").select(doc_id, "score"))
        best = rows.orderBy(*ranking("score", doc_id)).limit(k)
        best.write.mode("overwrite").parquet(f"{state}/revision={revision}")
        emit(spark.read.parquet(f"{state}/revision={revision}").withColumn("revision", F.lit(revision).cast("long")), revision)

    return scored.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours", by: str = "event_type") -> DataFrame:
    """Counts and sums per window of event time; works on a stream, where state older than the watermark goes, and on a table."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if own.isStreaming:
        own = own.withWatermark("ts", late)
    counted = own.groupBy(F.window("ts", width).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), by, "n", "total")
