"""Structured Streaming over events: sessions, windows, rates, audit sink; see state for rules with a state.

Late events are dropped behind the watermark; on a bounded input the closed windows equal the batch result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream(spark, path: str, schema, max_files: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream; event times without zone are read as UTC."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def sessions(events: DataFrame, key: str, gap: str, late: str = "2 hours") -> DataFrame:
    """(key, start, end, n) of sessions that end after `gap` without an event; batch and stream alike."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def windows(events: DataFrame, keys: list[str], size: str, slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """(keys, start, end, n, total) of sliding or tumbling windows."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(*keys, F.window("ts", size, slide).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def append_audit(events: DataFrame, path: str, checkpoint: str):
    """Append events to day folders; exactly once by the file sink's log."""
    return events.withColumn("day", F.date_format("ts", "yyyyMMdd")).writeStream.format("parquet").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def run_to_memory(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is there now and return its rows."""
    writer = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
