"""Synthetic data: annotation datasets, star polygons, geometric fixtures, a colour-fringe image. All from seeded hashes."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annogrid.functions.polygons import bounds, polygon_area


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) that depends on the seed and the keys only."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) / float(1 << 52)


def whole(low: int, high: int, seed: int, *keys: Column | str) -> Column:
    """A whole number from low to high, both included."""
    return (low + F.floor(uniform(seed, *keys) * (high - low + 1))).cast("int")


def star_polygon(n: Column, low: Column, high: Column, x: Column, y: Column, variation: float, seed: int, *keys: Column | str) -> Column:
    """Points at even angles with jitter and uniform radii around a centre."""

    def point(k: Column) -> Column:
        step = 2 * math.pi / n
        angle = k * step + (2 * uniform(seed, *keys, k, F.lit("a")) - 1) * variation * step
        radius = low + uniform(seed, *keys, k, F.lit("r")) * (high - low)
        return F.struct((radius * F.cos(angle) + x).alias("x"), (radius * F.sin(angle) + y).alias("y"))

    return F.transform(F.sequence(F.lit(0), n - 1), point)


def categories(spark: SparkSession, number: int, supercategories: int, prefix: str = "category", super_prefix: str = "supercategory") -> DataFrame:
    i = F.col("id")
    return spark.range(number).select(
        (i + 1).alias("id"), F.concat(F.lit(f"{prefix}_"), (i + 1).cast("string")).alias("name"), F.concat(F.lit(f"{super_prefix}_"), (i % supercategories + 1).cast("string")).alias("supercategory")
    )


def dataset(
    spark: SparkSession, images: int, width: int = 640, height: int = 480, jitter: int = 40, polygons: tuple[int, int] = (1, 5), vertices: tuple[int, int] = (4, 9),
    radius: tuple[float, float] = (0.05, 0.2), variation: float = 0.4, number_of_categories: int = 5, supercategories: int = 2, seed: int = 42,
) -> dict[str, DataFrame]:
    """images, categories and annotations of a generated dataset; annotation ids are image * 1000 + number."""
    i = F.col("id")
    size = lambda base, tag: (base + whole(-jitter, jitter, seed, "id", F.lit(tag))).cast("int")
    pictures = spark.range(1, images + 1).select(
        "id", size(width, "w").alias("width"), size(height, "h").alias("height"), F.concat(F.lit("image_"), F.lpad(i.cast("string"), 5, "0"), F.lit(".png")).alias("file_name"), F.lit(1).alias("license")
    )
    each = pictures.withColumn("k", F.explode(F.sequence(F.lit(1), whole(*polygons, seed, "id", F.lit("n")))))
    least = F.least("width", "height")
    margin = least * radius[1] * 1.1
    place = lambda side, tag: margin + uniform(seed, "id", "k", F.lit(tag)) * (F.col(side) - 2 * margin)
    each = each.withColumns({"n": whole(*vertices, seed, "id", "k", F.lit("v")), "cx": place("width", "x"), "cy": place("height", "y")})
    points = star_polygon(F.col("n"), least * radius[0], least * radius[1], F.col("cx"), F.col("cy"), variation, seed, "id", "k")
    each = each.withColumn("points", points)
    box = bounds(F.col("points"))
    annotations = each.select(
        (i * 1000 + F.col("k")).alias("id"), i.alias("image_id"), whole(1, number_of_categories, seed, "id", "k", F.lit("c")).cast("long").alias("category_id"),
        F.array(F.flatten(F.transform("points", lambda p: F.array(p["x"], p["y"])))).alias("segmentation"), polygon_area(F.col("points")).alias("area"),
        F.array(box["x"], box["y"], box["w"], box["h"]).alias("bbox"), F.lit(0).alias("iscrowd"),
    )
    return {"images": pictures, "categories": categories(spark, number_of_categories, supercategories), "annotations": annotations}


def fringe_image(spark: SparkSession, height: int = 256, width: int = 256, sigma: float = 50.0, offsets: tuple[float, float, float] = (3.0, 0.0, -3.0), scale: float = 255.0) -> DataFrame:
    """A radial Gaussian whose channels c0, c1, c2 are shifted along x: (image_id, row, col, rows, cols, c0, c1, c2)."""
    row, col = F.floor(F.col("id") / width).cast("int"), (F.col("id") % width).cast("int")
    channel = lambda o: scale * F.exp(-(F.pow(F.col("col") - (width / 2 + o), F.lit(2)) + F.pow(F.col("row") - height / 2, F.lit(2))) / (2 * sigma**2))
    p = spark.range(height * width).select(F.lit(0).cast("long").alias("image_id"), row.alias("row"), col.alias("col"), F.lit(height).alias("rows"), F.lit(width).alias("cols"))
    return p.select("*", *(channel(o).alias(f"c{k}") for k, o in enumerate(offsets)))


#: fixed values: a pentagram-like polygon that crosses itself
FIGURE_EIGHT = [(0.0, 0.0), (3.0, 0.0), (2.0, 1.0), (0.0, 3.0), (3.0, 2.0)]


def separated_shapes(seed: int = 101) -> list[list[tuple[float, float]]]:
    """A turned rectangle, a right triangle and a hexagon around x = 2, 6 and 10, apart from each other."""
    rng = random.Random(seed)

    def turned(points, x):
        a = rng.uniform(0, 2 * math.pi)
        return [(x + px * math.cos(a) - py * math.sin(a), 2 + px * math.sin(a) + py * math.cos(a)) for px, py in points]

    w, h = rng.uniform(1, 2), rng.uniform(0.5, 1.5)
    hexagon = [(math.cos(k * math.pi / 3), math.sin(k * math.pi / 3)) for k in range(6)]
    return [turned([(-w / 2, -h / 2), (w / 2, -h / 2), (w / 2, h / 2), (-w / 2, h / 2)], 2.0), turned([(-0.5, -0.5), (0.9, -0.5), (-0.5, 0.9)], 6.0), turned(hexagon, 10.0)]


def nested_rectangles(groups: int = 5, depth: int = 3, extent: float = 100.0, least: float = 5.0, margins: tuple[float, float] = (2.0, 10.0), seed: int = 0) -> tuple[list[tuple], list[int], list[list[int]]]:
    """Rectangles, the indices of those inside another, and each group's indices; groups lie in columns apart from each other."""
    rng = random.Random(seed)
    rects, inner, members = [], [], []
    for g in range(groups):
        x0, x1 = extent * g / groups + 0.5, extent * (g + 1) / groups - 0.5
        y0, y1 = rng.uniform(0, extent / 4), rng.uniform(extent * 3 / 4, extent)
        members.append([])
        for level in range(depth):
            members[-1].append(len(rects))
            if level:
                inner.append(len(rects))
            rects.append((x0, y0, x1, y1))
            mx, my = (min(rng.uniform(*margins), side / 4) for side in (x1 - x0, y1 - y0))
            x0, x1, y0, y1 = x0 + mx, x1 - mx, y0 + my, y1 - my
            if min(x1 - x0, y1 - y0) < least / 2:
                break
    return rects, inner, members
