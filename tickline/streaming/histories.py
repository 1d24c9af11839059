"""Bucket histories on a stream: the batch operator's columns under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ohlc_stream(ticks: DataFrame, width: str, lateness: str, *keys: str) -> DataFrame:
    """Open, high, low, close and samples of each key and bucket, emitted once the watermark passes the bucket's end."""
    own = ticks.withWatermark("observed_at", lateness).groupBy(*keys, F.window("observed_at", width).alias("w"))
    out = own.agg(F.min_by("odds", F.struct("observed_at", "odds")).alias("open"), F.max("odds").alias("high"), F.min("odds").alias("low"), F.max_by("odds", F.struct("observed_at", "odds")).alias("close"), F.count("*").alias("samples"))
    return out.select(*keys, F.col("w.start").alias("bucket"), "open", "high", "low", "close", "samples")


def files(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a file stream with the schema that its files have."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def drain(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there, append to Parquet, and read that."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
