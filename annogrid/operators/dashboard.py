"""The data behind dashboard and heatmap figures: bars, histograms, scatter points, colour layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annogrid.operators.density import gaussian_smoothed, histogram_2d


def overview(flat: DataFrame) -> DataFrame:
    """Annotations by category, for the bar figure (most first when it is drawn)."""
    return flat.groupBy("category_name").agg(F.count(F.lit(1)).alias("n"))


def binned(rows: DataFrame, value: str, bins: int, key: str = "category_name") -> DataFrame:
    """Counts in equal bins between each key's smallest and largest value; one value alone makes one bin."""
    v = F.col(value).cast("double")
    ends = rows.where(v.isNotNull()).groupBy(key).agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((v - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    joined = rows.where(v.isNotNull()).join(F.broadcast(ends), key)
    return joined.groupBy(key, at.alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("n"))


def category_traces(flat: DataFrame) -> DataFrame:
    """(trace, category_name, bin, lo, hi, n) of the area, aspect ratio and annotations-per-image histograms."""
    per_image = flat.groupBy("category_name", "image_id").agg(F.count(F.lit(1)).alias("k"))
    parts = [("area", binned(flat, "bbox_area", 30)), ("aspect_ratio", binned(flat, "bbox_aspect_ratio", 30)), ("per_image", binned(per_image, "k", 20))]
    out = None
    for name, df in parts:
        named = df.select(F.lit(name).alias("trace"), "category_name", "bin", "lo", "hi", "n")
        out = named if out is None else out.unionByName(named)
    return out


def scatter(flat: DataFrame) -> DataFrame:
    """Points of area against aspect ratio."""
    return flat.where(F.col("bbox_area").isNotNull() & F.col("bbox_aspect_ratio").isNotNull()).select("category_name", F.col("bbox_aspect_ratio").alias("x"), F.col("bbox_area").alias("y"))


def box_shapes(rects: DataFrame) -> DataFrame:
    """Outlines with the names Box 1, Box 2, ... by index."""
    from annogrid.operators.merge import numbered

    return numbered(rects.select("idx", "x0", "y0", "x1", "y1"), "idx").select("idx", "x0", "y0", "x1", "y1", F.concat(F.lit("Box "), F.col("number").cast("string")).alias("name"))


def heatmap(centres: DataFrame, width: float, height: float, bin_size: float, sigmas: tuple[float, ...] = (0.5, 1.0, 2.0)) -> DataFrame:
    """(sigma, bx, by, value): the plain counts at sigma 0 and each smoothing of them."""
    plain = histogram_2d(centres, width, height, bin_size)
    nx, ny = int(width / bin_size), int(height / bin_size)
    return plain.select(F.lit(0.0).alias("sigma"), "bx", "by", F.col("n").cast("double").alias("value")).unionByName(gaussian_smoothed(plain, nx, ny, list(sigmas)))
