"""Dense two-dimensional histograms of box centres and their Gaussian smoothing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def histogram_2d(centres: DataFrame, width: float, height: float, bin_size: float) -> DataFrame:
    """(bx, by, n) for every bin; points outside are dropped, those on the far edges go to the last bin."""
    nx, ny = int(width / bin_size), int(height / bin_size)
    x, y = F.col("cx"), F.col("cy")
    inside = centres.where((x >= 0) & (x <= width) & (y >= 0) & (y <= height))
    bx = F.least(F.floor(x / width * nx), F.lit(nx - 1)).cast("int").alias("bx")
    by = F.least(F.floor(y / height * ny), F.lit(ny - 1)).cast("int").alias("by")
    counts = inside.groupBy(bx, by).agg(F.count(F.lit(1)).alias("n"))
    spark = centres.sparkSession
    grid = spark.range(nx * ny).select((F.col("id") % nx).cast("int").alias("bx"), F.floor(F.col("id") / nx).cast("int").alias("by"))
    return grid.join(counts, ["bx", "by"], "left").select("bx", "by", F.coalesce("n", F.lit(0)).alias("n"))


def _mirrored(index, n: int):
    """An index beyond an edge, reflected with the edge doubled, as often as needed."""
    k = F.pmod(index, F.lit(2 * n))
    return F.when(k < n, k).otherwise(2 * n - 1 - k)


def gaussian_smoothed(histogram: DataFrame, nx: int, ny: int, sigmas: list[float], truncate: float = 4.0, digits: int = 6) -> DataFrame:
    """(sigma, bx, by, value): each value is spread along x, then along y, by the kernel's weights."""
    spark = histogram.sparkSession
    kernel = []
    for sigma in sigmas:
        radius = int(truncate * sigma + 0.5)
        weights = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-radius, radius + 1)]
        kernel += [(sigma, d, w / sum(weights)) for d, w in zip(range(-radius, radius + 1), weights, strict=True)]
    k = F.broadcast(spark.createDataFrame(kernel, "sigma double, d int, weight double"))  # 2 * truncate * sigma rows each
    grid = spark.range(nx * ny).select((F.col("id") % nx).cast("int").alias("bx"), F.floor(F.col("id") / nx).cast("int").alias("by"))
    taps = grid.crossJoin(k)
    along_x = taps.withColumn("sx", _mirrored(F.col("bx") + F.col("d"), nx)).join(histogram.select(F.col("bx").alias("sx"), "by", "n"), ["sx", "by"])
    along_x = along_x.groupBy("sigma", "bx", "by").agg(F.sum(F.col("weight") * F.col("n")).alias("v"))
    along_y = taps.withColumn("sy", _mirrored(F.col("by") + F.col("d"), ny)).join(along_x.select("sigma", "bx", F.col("by").alias("sy"), "v"), ["sigma", "bx", "sy"])
    return along_y.groupBy("sigma", "bx", "by").agg(F.round(F.sum(F.col("weight") * F.col("v")), digits).alias("value"))
