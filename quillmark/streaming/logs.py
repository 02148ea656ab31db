"""Structured Streaming over the logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.streaming.state import BUCKETS, KeyedState


def read_log(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None, format: str = "json") -> DataFrame:
    reader = spark.readStream.schema(schema).format(format)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def distinct_attempts(stream: DataFrame, id_col: str, at: str, late: str = "1 hour") -> DataFrame:
    """Each attempt once; an id is remembered for as long as it may come late."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([id_col])


def last_state(stream: DataFrame, key: str, state: str, *order: str) -> DataFrame:
    """key, state: the last line of each key so far (update mode); one row of state a key."""
    return stream.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias(state))


def counts_by_window(stream: DataFrame, at: str, by: str, size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Extension: counts in tumbling or sliding event-time windows."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size, slide), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "n")


def sessions(stream: DataFrame, at: str, by: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Extension: sessions of each key, closed by a gap."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", format: str = "parquet") -> None:
    """Everything there is now, then stop."""
    stream.writeStream.outputMode(mode).format(format).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upsert_once(stream: DataFrame, path: str, checkpoint: str, key: str, at: str, buckets: int = BUCKETS) -> KeyedState:
    """Keeps the last row of each key in a bucketed dataset (see KeyedState): a batch rewrites
    the buckets of its own keys alone. Returns the state, whose `read` gives the rows."""
    state = KeyedState(stream.sparkSession, path, stream.schema, key, at, buckets)
    state.follow(stream, checkpoint)
    return state
