"""Counts of a log as it grows, by event-time windows with a watermark (an extension)."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(log: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(window_start, key, n) of a stream or a table; a stream forgets windows that are ``late``."""
    rows = log.select(F.col(time).cast("timestamp").alias("__t"), F.col(key).alias(key))
    if rows.isStreaming:
        rows = rows.withWatermark("__t", late)
    counted = rows.groupBy(F.window("__t", window, slide) if slide else F.window("__t", window), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), key, "n")


def read_stream(spark: SparkSession, path: str, schema, kind: str = "parquet", pattern: str | None = None, per_trigger: int | None = None) -> DataFrame:
    """Files of a folder as they arrive; ``pattern`` picks them by name."""
    reader = spark.readStream.format(kind).schema(schema)
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).load(path)


def run_once(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Processes what is there and stops; results are files, and a rerun goes on from the checkpoint."""
    q = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
