"""Incremental runs: new files are chunked once, under Structured Streaming, and late rows don't repeat work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.operators.retrieval import chunk


def incremental(spark: SparkSession, source: str, schema: str, step: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, key: str) -> None:
    """Runs step over the Parquet files of `source` that no earlier run has seen and appends the result to `target`.

    The stream's checkpoint remembers files; rows whose key is in target already are left out (left_anti), so a batch
    that is replayed after a failure adds nothing twice.
    """

    def one(batch: DataFrame, number: int) -> None:
        out = step(batch.dropDuplicates([key]))
        try:
            done = spark.read.parquet(target).select(key).distinct()
            out = out.join(done, key, "left_anti")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
        out.write.mode("append").parquet(target)

    q = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def chunk_new(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, id: str, body: str) -> None:
    incremental(spark, source, schema, lambda df: chunk(df, id, body), target, checkpoint, id)


def late_counts(events: DataFrame, time: str, arrived: str, watermark: str = "7 days", window: str = "1 day") -> DataFrame:
    """Rows per event-time window, and how many of them arrived on a later day; works on streams and tables."""
    df = events.withWatermark(time, watermark) if events.isStreaming else events
    w = F.window(time, window)
    return df.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.datediff(arrived, time) > 0).cast("bigint")).alias("late")).select("w.start", "w.end", "n", "late")
