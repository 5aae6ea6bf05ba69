"""Event-time windows and sessions over a stream of events, an addition beyond batch work."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from helixframe.session import shared_folder


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table as a stream, with the schema of the table."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    s = spark.readStream.schema(schema)
    return s.parquet(path) if not name.endswith(".parquet") or spark.read.format("binaryFile").load(path).select("path").limit(2).count() > 1 else s.option("pathGlobFilter", name).parquet(folder)


def tumbling(events: DataFrame, at: str, key: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and sums per window and key; events later than the watermark are dropped in append mode."""
    g = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, width).alias("w"), key)
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), key, "n", F.round("total", 6).alias("total"))


def sessions(events: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    g = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key)
    return g.agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("stop"), "n")


def drain(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there; each batch replaces the table of the result in the shared folder, so that no
    row passes through the driver."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    q = df.writeStream.outputMode(mode).queryName(name).trigger(availableNow=True).option("checkpointLocation", f"{path}-state")
    q.foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(f"{path}-rows")).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}-rows")
