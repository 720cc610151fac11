"""Sampling of ordered frames: a time window, every n-th frame, chunks, and parts of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(frames: DataFrame, video: str, order: list[str]) -> DataFrame:
    """frame_no from 0 within each video."""
    return frames.withColumn("frame_no", F.row_number().over(Window.partitionBy(video).orderBy(*order)) - 1)


def sampled(frames: DataFrame, video: str, ts: str, order: list[str], every: int = 1, offset_seconds: float = 0.0, duration_seconds: float | None = None) -> DataFrame:
    """Every n-th frame of each video's stretch of time, counted from the video's first frame."""
    window = Window.partitionBy(video)
    start = F.min(F.unix_micros(F.col(ts).cast("timestamp"))).over(window)
    f = numbered(frames.withColumn("_since", (F.unix_micros(F.col(ts).cast("timestamp")) - start) / 1e6), video, order)
    inside = F.col("_since") >= offset_seconds
    if duration_seconds is not None:
        inside &= F.col("_since") < offset_seconds + duration_seconds
    return f.where(inside & (F.col("frame_no") % every == 0)).drop("_since")


def check_window(frames: DataFrame, video: str, ts: str, offset_seconds: float, duration_seconds: float) -> DataFrame:
    """Videos that end before the asked stretch of time does."""
    length = (F.unix_micros(F.max(F.col(ts).cast("timestamp"))) - F.unix_micros(F.min(F.col(ts).cast("timestamp")))) / 1e6
    return frames.groupBy(video).agg(length.alias("seconds")).where(F.col("seconds") < offset_seconds + duration_seconds)


def chunked(frames: DataFrame, chunk_size: int) -> DataFrame:
    """chunk of each numbered frame."""
    return frames.withColumn("chunk", F.floor(F.col("frame_no") / chunk_size).cast("int"))


def parts(frames: DataFrame, video: str, size: str, most: float) -> DataFrame:
    """part of each numbered frame by the running size before it; 0 for one store."""
    before = F.coalesce(F.sum(size).over(Window.partitionBy(video).orderBy("frame_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return frames.withColumn("part", F.floor(before / most).cast("int") if most > 0 else F.lit(0))
