"""Readings and words as streams: deliveries once, late rows within a limit, running totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream(spark: SparkSession, folder: str, like: DataFrame, files_per_batch: int = 4) -> DataFrame:
    """A folder to which Parquet files are added, as a stream of the schema of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def once(readings: DataFrame, late: str = "7 days") -> DataFrame:
    """Each delivery once; a repetition later than ``late`` after the newest row is not recognised any more."""
    return readings.withWatermark("finished_at", late).dropDuplicatesWithinWatermark(["reading_id"])


def engine_windows(readings: DataFrame, window: str = "1 hour", late: str = "7 days") -> DataFrame:
    """Pages, failures and seconds of each engine by hour of finishing; rows later than ``late`` are not counted."""
    bad = F.col("skipped") | F.col("error").isNotNull()
    g = once(readings, late).groupBy(F.window("finished_at", window), "engine_name")
    return g.agg(F.count("*").alias("pages"), F.count_if(bad).alias("failed"), F.sum("elapsed_seconds").alias("seconds")).select(F.col("window.start").alias("from"), "engine_name", "pages", "failed", "seconds")


def append_words(words: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends each delivery of a word once to a Parquet table, parted by engine; runs over what is there, then ends."""
    return words.dropDuplicates(["word_id"]).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).partitionBy("engine_name").trigger(availableNow=True).start()
