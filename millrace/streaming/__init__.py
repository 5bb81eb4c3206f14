"""Extension: the row-local operators under Structured Streaming, and windowed statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import TextConfig, words
from ..operators.text import preprocess


def read(spark: SparkSession, folder: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files as they come to a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def preprocess_stream(stream: DataFrame, config: TextConfig | None = None, text_col: str = "text") -> DataFrame:
    """Cleaned and tokenized texts; no state is kept."""
    return preprocess(stream, text_col, config)


def event_statistics(stream: DataFrame, time_col: str = "ts", by: str = "event_type", window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Rows and sums of `value` by window and type; windows close when the watermark passes them, and later rows are left out."""
    moment = F.col(time_col).cast("timestamp")
    span = F.window(moment, window, slide) if slide else F.window(moment, window)
    timed = stream.withColumn(time_col, moment).withWatermark(time_col, late)
    return timed.groupBy(span.alias("window"), by).agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def token_counts(stream: DataFrame, text_col: str = "text") -> DataFrame:
    """Running counts of words, for complete or update mode."""
    return stream.select(F.explode_outer(words(F.col(text_col))).alias("token")).where(F.col("token").isNotNull()).groupBy("token").count()
