"""Box, polygon and position features of annotations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annogrid.functions.polygons import polygon_area, polygon_perimeter, polygon_points


def _ratio(top: Column, bottom: Column, otherwise: float = 0.0) -> Column:
    return F.when(bottom > 0, top / F.nullif(bottom, F.lit(0.0))).otherwise(F.lit(otherwise))


def box_features(x: Column, y: Column, w: Column, h: Column) -> dict[str, Column]:
    around, half = 2 * (w + h), (w + h) / 2
    return {
        "bbox_width": w, "bbox_height": h, "bbox_area": w * h, "bbox_aspect_ratio": _ratio(w, h), "bbox_x_center": x + w / 2, "bbox_y_center": y + h / 2,
        "bbox_perimeter": around, "bbox_diagonal": F.sqrt(w * w + h * h), "bbox_compactness": _ratio(4 * math.pi * w * h, around * around),
        "bbox_elongation": _ratio(F.greatest(w, h), F.least(w, h), 1.0), "bbox_rectangularity": _ratio(w * h, half * half),
    }


def segmentation_features(polygon: Column, w: Column, h: Column) -> dict[str, Column]:
    """Of a flat polygon; fewer than three points or an odd length give the empty values."""
    good = polygon.isNotNull() & (F.size(polygon) >= 6) & (F.size(polygon) % 2 == 0)
    points = polygon_points(F.when(good, polygon))
    area, around = polygon_area(points), polygon_perimeter(points)
    values = {
        "segmentation_points": (F.size(points).cast("double"), 0.0), "segmentation_area": (area, 0.0), "bbox_to_seg_ratio": (_ratio(w * h, area, 1.0), 1.0),
        "segmentation_perimeter": (around, 0.0), "seg_circularity": (_ratio(4 * math.pi * area, around * around), 0.0),
    }
    return {k: F.when(good, v).otherwise(F.lit(empty)) for k, (v, empty) in values.items()}


def spatial_features(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> dict[str, Column]:
    """Place and size of a box within its image; an image without a size counts as one pixel."""
    width, height = (F.coalesce(v.cast("double"), F.lit(1.0)) for v in (width, height))
    cx, cy = x + w / 2, y + h / 2
    far = F.sqrt(width * width + height * height)
    length = lambda dx, dy: F.sqrt(dx * dx + dy * dy) / far
    right, below = width - (x + w), height - (y + h)
    return {
        "relative_x": x / width, "relative_y": y / height, "relative_width": w / width, "relative_height": h / height, "relative_area": w * h / (width * height),
        "distance_from_center": length(cx - width / 2, cy - height / 2), "edge_proximity": F.least(x, y, right, below) / F.least(width, height),
        "corner_distance_tl": length(x, y), "corner_distance_br": length(right, below), "horizontal_position": cx / width, "vertical_position": cy / height,
    }


#: Plain quotients, which come out the same on any engine and are often half way between two rounded values.
RATIOS = ("relative_x", "relative_y", "relative_width", "relative_height", "relative_area", "edge_proximity", "horizontal_position", "vertical_position")


def with_features(df: DataFrame, features: dict[str, Column], ids: list[str], digits: int = 6, exact: tuple[str, ...] = ()) -> DataFrame:
    """The features beside the ids, rounded except those that are named exact."""
    return df.select(*ids, *((v if k in exact else F.round(v, digits)).alias(k) for k, v in features.items()))


def standardised(df: DataFrame, columns: list[str], ids: list[str], digits: int = 6) -> DataFrame:
    """(x - mean) / population deviation after nulls become 0; a constant column keeps its scale."""
    filled = df.select(*ids, *(F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in columns))
    stats = filled.agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"_s_{c}") for c in columns))
    scaled = [F.round((F.col(c) - F.col(f"_m_{c}")) / F.coalesce(F.nullif(F.col(f"_s_{c}"), F.lit(0.0)), F.lit(1.0)), digits).alias(c) for c in columns]
    return filled.crossJoin(F.broadcast(stats)).select(*ids, *scaled)


def separation(df: DataFrame, columns: list[str], label: str, digits: int = 9) -> DataFrame:
    """(feature, importance): the share of a feature's variance that lies between the labels, as a part of all features' shares."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns)))
    by = df.select(F.col(label).alias("_label"), pairs.alias("p")).groupBy("p.feature", "_label")
    by = by.agg(F.count("p.x").alias("n"), F.sum("p.x").alias("s"), F.sum(F.col("p.x") * F.col("p.x")).alias("q"))
    n, s = F.sum("n"), F.sum("s")
    parts = by.groupBy("feature").agg((F.sum(F.try_divide(F.col("s") * F.col("s"), F.col("n"))) - s * s / n).alias("between"), (F.sum("q") - s * s / n).alias("whole"))
    share = parts.select("feature", F.coalesce(F.try_divide("between", "whole"), F.lit(0.0)).alias("share"))
    total = share.agg(F.sum("share").alias("_total"))
    return share.crossJoin(F.broadcast(total)).select("feature", F.round(F.coalesce(F.try_divide("share", "_total"), F.lit(0.0)), digits).alias("importance"))
