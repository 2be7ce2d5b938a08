"""Resumable ingestion and event-time aggregates (SR1, SR6; windows are an addition, not parity)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from millrace.operators.audit import filter_audit
from millrace.sources.sinks import new_rows


def accept_into(path: str, rejected: str, key: str, schema: str, *rules: tuple[str, Column]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: valid new keys are appended once, the others go to the rejected table with their reason.

    A replayed batch appends nothing, because its keys are already there.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        audit = filter_audit(batch, "ingest", *rules)
        try:
            existing = spark.read.schema(schema).parquet(path)
            existing.limit(1).collect()
        except Exception as e:  # the table does not exist yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            existing = spark.createDataFrame([], schema)
        new_rows(existing, audit.kept, key).write.mode("append").parquet(path)
        audit.dropped.withColumn("batch", F.lit(number)).write.mode("append").parquet(rejected)

    return sink


def ingest(spark: SparkSession, source: str, schema: str, path: str, rejected: str, key: str, checkpoint: str, *rules: tuple[str, Column]) -> StreamingQuery:
    """Everything now available in ``source``, once; restarting continues where the checkpoint stands (SR1)."""
    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.foreachBatch(accept_into(path, rejected, key, schema, *rules)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """window_start, event_type, n, total per event-time window; works on streams (with a watermark) and tables."""
    d = events.withWatermark("ts", late) if late and events.isStreaming else events
    return d.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """user_id, session_start, n per session of events no further apart than ``gap``."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("session_start"), "n")
