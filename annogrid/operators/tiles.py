"""Overlapping tiles that cover an image of each resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlap_ratios(resolutions: DataFrame, tile_width: int, tile_height: int) -> DataFrame:
    """The remainder of each side by the tile's, as a share of the tile."""
    return resolutions.select(
        "width", "height", (F.pmod("width", F.lit(tile_width)) / float(tile_width)).alias("x_overlap"), (F.pmod("height", F.lit(tile_height)) / float(tile_height)).alias("y_overlap")
    )


def _starts(length: Column, overlap: Column) -> tuple[Column, Column]:
    """Starts of the tiles along one side, and the tile's length."""
    o = F.least(F.greatest(overlap, F.lit(0.0)), F.lit(0.99))
    n = F.greatest(F.lit(2), F.floor(1 / (1 - o)))
    tile = F.least(F.floor(length / (n * (1 - o))), length).cast("int")
    stride = F.greatest(F.lit(1), F.floor(tile * (1 - o))).cast("int")
    steps = F.transform(F.sequence(F.lit(0), F.ceil(length / stride).cast("int") - 1), lambda k: k * stride)
    last = F.get(F.filter(F.slice(steps, 2, F.greatest(F.size(steps), F.lit(1))), lambda s: (s + tile >= length) & (s < length - stride)), 0)
    closed = F.concat(F.filter(steps, lambda s: s < last), F.array(F.greatest(F.lit(0), length - tile)))
    return F.when(last.isNotNull(), closed).otherwise(F.filter(steps, lambda s: s < length)), tile


def tiles(resolutions: DataFrame) -> DataFrame:
    """x0, y0, x1, y1 of all tiles of each (width, height, x_overlap, y_overlap), row by row, without repeats."""
    xs, tile_w = _starts(F.col("width"), F.col("x_overlap"))
    ys, tile_h = _starts(F.col("height"), F.col("y_overlap"))
    # Starts are made distinct within the arrays: a distinct of the rows would let Catalyst drop the caller's distinct
    # of the resolutions, and every image would be tiled. Outer explodes, as from an inner one Catalyst would infer a
    # filter on the array's size and push the whole expression below that distinct.
    rows = resolutions.select("width", "height", F.array_distinct(xs).alias("xs"), F.array_distinct(ys).alias("ys"), tile_w.alias("tw"), tile_h.alias("th"))
    rows = rows.select("width", "height", "xs", "tw", "th", F.explode_outer("ys").alias("y0")).select("width", "height", "tw", "th", "y0", F.explode_outer("xs").alias("x0"))
    rows = rows.where(F.col("x0").isNotNull() & F.col("y0").isNotNull())
    return rows.select("width", "height", "x0", "y0", F.least(F.col("x0") + F.col("tw"), "width").alias("x1"), F.least(F.col("y0") + F.col("th"), "height").alias("y1"))
