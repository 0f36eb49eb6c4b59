"""Streaming counterparts of the hourly buckets."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandcube.session import ensure_checkpoint_dir


def read_stream(spark: SparkSession, path: str, ts: str, pattern: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream, under the schema of the files that are there."""
    batch = spark.read.option("pathGlobFilter", pattern).parquet(path)
    reader = spark.readStream.schema(batch.schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).withColumn(ts, F.col(ts).cast("timestamp"))


def hourly_counts(stream: DataFrame, ts: str, key: str, by: str, late: str = "2 hours") -> DataFrame:
    """Records per hour and ``by``; records sent again within the watermark count once."""
    once = stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
    counts = once.groupBy(F.window(ts, "1 hour"), by).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("hour_start"), by, "n")


def sessions(stream: DataFrame, ts: str, by: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Spans of records at most ``gap`` apart."""
    s = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), by).agg(F.count(F.lit(1)).alias("n"))
    return s.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")


def run_available(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Process all that is there and return the result, which lies as Parquet in the shared checkpoint folder."""
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    base = os.path.join(spark.sparkContext._jsc.sc().getCheckpointDir().get(), f"stream-{uuid.uuid4().hex}")
    out = f"{base}/out"

    def sink(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    q = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
