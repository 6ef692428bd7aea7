"""The incremental passes as Structured Streaming jobs that drain what is there and stop."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalith.sources.tables import SCHEMAS, shared_folder


def _scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the events file alone, not of its folder's other tables."""
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(SCHEMAS["events"])
    plain = reader.option("pathGlobFilter", name).parquet(folder)
    return plain.withColumn("at", F.col("ts").cast("timestamp"))


def drained(df: DataFrame, name: str) -> DataFrame:
    """Run a stream over all that is available, append to Parquet in the shared folder, and
    read the result; a restart goes on from the stream's own checkpoint."""
    spark = df.sparkSession
    out, state = _scratch(spark, name), _scratch(spark, f"{name}-state")
    query = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def windowed_counts(spark: SparkSession, path: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Tumbling windows of events by type, final once the watermark has passed them."""
    windows = _events(spark, path).withWatermark("at", late).groupBy(F.window("at", width), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("value"))
    return drained(windows.select(F.unix_millis(F.col("window.start")).alias("start_ms"), "event_type", "events", "value"), "windows")


def fixed_sessions(spark: SparkSession, path: str, gap: str = "24 hours", late: str = "2 days") -> DataFrame:
    """Sessions of each user by a fixed gap, final once the watermark has passed them."""
    s = _events(spark, path).withWatermark("at", late).groupBy(F.session_window("at", gap), "user_id").agg(F.count(F.lit(1)).alias("events"))
    return drained(s.select("user_id", F.unix_millis(F.col("session_window.start")).alias("start_ms"), "events"), "sessions")


def deduplicated(spark: SparkSession, path: str, late: str = "2 days") -> DataFrame:
    """Events once each, repeats within the watermark dropped."""
    return drained(_events(spark, path).withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id"), "once")
