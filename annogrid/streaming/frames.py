"""The frame contracts over Structured Streaming: a numbered stream is sampled without state, windows carry watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
    ]
)


def read_frames(spark: SparkSession, folder: str, schema: T.StructType = EVENTS, files_per_trigger: int = 64) -> DataFrame:
    """Parquet files of a folder as a stream; the checkpoint of the query that reads it makes it resumable."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def every_nth(frames: DataFrame, number: str, n: int) -> DataFrame:
    """Frames whose number, given upstream, is a multiple of n."""
    return frames.where(F.pmod(F.col(number), F.lit(n)) == 0)


def windowed_counts(frames: DataFrame, ts: str, key: str, width: str = "10 minutes", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums of values by window and key; rows later than the watermark are dropped."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    by = frames.withWatermark(ts, late).groupBy(window.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return by.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")


def sessions(frames: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    by = frames.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("s"), key).agg(F.count(F.lit(1)).alias("n"))
    return by.select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), key, "n")


def without_repeats(frames: DataFrame, ts: str, key: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return frames.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def to_parquet(frames: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet, all that is there now; run again with the same checkpoint it goes on where it stopped."""
    return frames.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
