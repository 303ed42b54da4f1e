"""Structured Streaming over the event files: watermarked windows, first-seen rows, last review.

The streams run with availableNow, so they end when the files are read; checkpoints and
results lie in the shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brujula.session import shared_dir, table


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events file as a stream (a file stream reads a folder, filtered by name)."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("t", F.col("ts").cast("timestamp"))


def run(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream to its end and returns what it wrote."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/brujula/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def run_complete(stream: DataFrame) -> DataFrame:
    """Runs an aggregation to its end in update mode and keeps each group's last state.

    With a watermark the newest windows would stay open at the end of the files; update
    mode writes every group whenever it changes, numbered by batch.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/brujula/stream-{uuid.uuid4().hex}"

    def write(df: DataFrame, batch: int) -> None:
        df.withColumn("_batch", F.lit(batch)).write.mode("append").parquet(f"{base}/out")

    stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")


def hourly(spark: SparkSession, sf_dir: str, late: str = "2 hours") -> DataFrame:
    """hora, event_type, n, total of tumbling hours; rows later than the watermark are left out."""
    e = read_events(spark, sf_dir).withWatermark("t", late)
    agg = e.groupBy(F.window("t", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    out = run_complete(agg)
    last = out.groupBy("w", "event_type").agg(F.max(F.struct("_batch", "n", "total")).alias("x"))
    return last.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hora"), "event_type", F.col("x.n").alias("n"), F.round("x.total", 4).alias("total"))


def first_seen(spark: SparkSession, sf_dir: str, late: str = "1 day") -> DataFrame:
    """Rows per user and type after dropping events sent again within the watermark."""
    e = read_events(spark, sf_dir).withWatermark("t", late).dropDuplicatesWithinWatermark(["event_id"]).select("user_id", "event_type")
    return run(e).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
