"""Keypoints of images (image_name, x, y, response): numbering, and the table of normalised and original ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(points: DataFrame, *order: str, image: str = "image_name") -> DataFrame:
    """Adds keypoint_id, from 0 within each image in the order given."""
    return points.withColumn("keypoint_id", F.row_number().over(Window.partitionBy(image).orderBy(*order)) - 1)


def both_sources(normalised: DataFrame, original: DataFrame, detector: str, *order: str, image: str = "image_name") -> DataFrame:
    """Keypoints found in the normalised and in the original image, one below the other, each numbered for itself."""
    parts = [numbered(df, *order, image=image).withColumns({"img_source": F.lit(name), "detector": F.lit(detector)}) for df, name in ((normalised, "Normalized"), (original, "Original"))]
    return parts[0].unionByName(parts[1], allowMissingColumns=True)


def checked(points: DataFrame, images: DataFrame, image: str = "image_name") -> DataFrame:
    """The images' keypoints; fails where an image has none, as no homography can be estimated from it."""
    counted = images.select(image).join(points.groupBy(image).agg(F.count(F.lit(1)).alias("_n")), image, "left")
    told = F.when(F.col("_n").isNull(), F.raise_error(F.concat(F.lit("no keypoints in "), F.col(image).cast("string")))).otherwise(F.col("_n"))
    return points.join(counted.select(image, told.alias("_n")).where(F.col("_n") > 0).select(image), image)
