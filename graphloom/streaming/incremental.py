"""Structured Streaming: windowed counters with late data, and an index that follows new files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.model import last_wins
from graphloom.operators.snapshots import replace_files
from graphloom.session import scratch


def event_stream(spark: SparkSession, folder: str, schema: str = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string") -> DataFrame:
    """Events as their files arrive in the folder, with ts as an event time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counters(events: DataFrame, width: str = "1 hour", late: str = "2 days") -> DataFrame:
    """(window_start, event_type, n_events, total): counts per window; rows later than the watermark are dropped by Spark, none before."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n_events", "total")


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Drains what is there, and reads the last result of each window back from the shared folder."""
    spark = stream.sparkSession
    out, marks = scratch(spark, name), scratch(spark, f"{name}-marks")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(out)

    stream.writeStream.outputMode("update").option("checkpointLocation", marks).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out)
    return last_wins(rows, ["window_start", "event_type"], ["epoch"]).drop("epoch")


def follow_files(files: DataFrame, target: str, parse) -> None:
    """An index that follows a stream of files (repo_id, path, text, indexed_at): each batch replaces the rows of its files in a new version of the target.

    parse: DataFrame of files -> DataFrame of rows with repo_id and path. Versions are folders; the batch number names them, so a repeated batch
    overwrites its own version only. The stream's progress is kept in the target's folder ``marks``: called again, it goes on where it stopped.
    """
    spark = files.sparkSession
    marks = f"{target.rstrip('/')}/marks"

    def batch(new: DataFrame, epoch: int) -> None:
        new = last_wins(new, ["repo_id", "path"], ["indexed_at"])
        fresh = parse(new)
        if epoch:
            fresh = replace_files(spark.read.parquet(f"{target}/v{epoch - 1}"), fresh, new, ["repo_id", "path"])
        fresh.write.mode("overwrite").parquet(f"{target}/v{epoch}")

    files.writeStream.option("checkpointLocation", marks).foreachBatch(batch).trigger(availableNow=True).start().awaitTermination()
