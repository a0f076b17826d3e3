"""Incremental corpus maintenance with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.functions.text import count_exact, normalised


def documents_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 16) -> DataFrame:
    """New Parquet files of documents as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def arrivals_per_window(stream: DataFrame, time: str, length: str = "30 days", late: str = "10 days") -> DataFrame:
    """Documents and characters per window of arrival; the watermark bounds the state."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length).alias("w")).agg(F.count("*").alias("documents"), F.sum(F.length(normalised(F.col("text")))).alias("characters"))


def first_bodies(stream: DataFrame, time: str, late: str = "10 days") -> DataFrame:
    """Each exact body once within the watermark."""
    return stream.withColumn("body_fingerprint", F.sha2(F.coalesce("text", F.lit("")), 256)).withWatermark(time, late).dropDuplicatesWithinWatermark(["body_fingerprint"])


def alerts(stream: DataFrame, term: str) -> DataFrame:
    """Arriving documents that hold a term, with its occurrences: a standing search, stateless."""
    return stream.withColumn("occurrences", count_exact(normalised(F.col("text")), term)).where("occurrences > 0").select("doc_id", "occurrences")


def run_once(stream: DataFrame, output: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what has arrived, then stop; restarting goes on after the last checkpointed batch."""
    query = stream.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
