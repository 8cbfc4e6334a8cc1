"""Access log as a stream: daily counts, sessions and first occurrences under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """Stream over a parquet table, be it a folder of files or one file; `files` a trigger."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder)


def daily_counts(events: DataFrame, late: str = "7 days") -> DataFrame:
    """Tumbling days per event type; rows later than `late` are dropped by the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "7 days") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def first_occurrences(events: DataFrame, late: str = "7 days") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def run_once(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process all available input and stop; the checkpoint lets a restart go on."""
    df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
