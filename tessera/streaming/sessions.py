"""Sessions over a live event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def live_sessions(events: DataFrame, keys: list[str], ts: str, gap: str, late: str) -> DataFrame:
    """Streaming sessions with a watermark; NTZ times are read as UTC."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count("*").alias("n"))


def run_available(sessions: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Everything available, closed sessions appended as files. Sessions that the watermark has not passed stay in the state."""
    flat = sessions.drop("w")
    return flat.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def open_sessions(spark: SparkSession, checkpoint: str, keys: list[str]) -> DataFrame:
    """Sessions that are still in the state of a stopped query, read from its state store."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select(*(F.col(f"key.{k}").alias(k) for k in keys), F.col("value.min").alias("start_ts"), F.col("value.max").alias("end_ts"), F.col("value.count").alias("n"))


def flush(closed: DataFrame, checkpoint: str, keys: list[str]) -> DataFrame:
    """End of stream: what append mode has given, and the sessions that are open in the state. The input isn't read again."""
    rest = open_sessions(closed.sparkSession, checkpoint, keys)
    return closed.select(*rest.columns).unionByName(rest)
