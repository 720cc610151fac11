"""Centred Fourier magnitudes of images and what is read from them: radial profile, band energy, directions, centroid.

The transform runs for one image at a time on Arrow data; everything after it is an aggregation of the table
(image_id, row, col, rows, cols, magnitude).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def magnitudes(pixels: DataFrame, value: str = "value", scale: float = 255.0) -> DataFrame:
    """The centred spectrum of each image of (image_id, row, col, value)."""

    def transform(table: pa.Table) -> pa.Table:
        row, col = table.column("row").to_numpy(), table.column("col").to_numpy()
        image = np.zeros((row.max() + 1, col.max() + 1))
        image[row, col] = table.column("value").to_numpy() / scale
        out = np.fft.fftshift(np.fft.fft2(image))
        rows, cols = np.indices(out.shape)
        n, ids = out.size, table.column("image_id")[0].as_py()
        return pa.table(
            {
                "image_id": pa.array([ids] * n, pa.int64()), "row": pa.array(rows.ravel(), pa.int32()), "col": pa.array(cols.ravel(), pa.int32()),
                "rows": pa.array([out.shape[0]] * n, pa.int32()), "cols": pa.array([out.shape[1]] * n, pa.int32()),
                "magnitude": pa.array(np.abs(out).ravel(), pa.float64()), "phase": pa.array(np.angle(out).ravel(), pa.float64()),
            }
        )

    plain = pixels.select(F.col("image_id").cast("long").alias("image_id"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col(value).cast("double").alias("value"))
    return plain.groupBy("image_id").applyInArrow(transform, "image_id long, row int, col int, rows int, cols int, magnitude double, phase double")


def _v() -> Column:
    return F.col("row") - F.floor(F.col("rows") / 2)


def _u() -> Column:
    return F.col("col") - F.floor(F.col("cols") / 2)


def _distance() -> Column:
    return F.sqrt((_u() * _u() + _v() * _v()).cast("double"))


def _max_radius() -> Column:
    half = [F.floor(F.col(c) / 2) for c in ("rows", "cols")]
    return F.floor(F.sqrt((half[0] * half[0] + half[1] * half[1]).cast("double")))


def radial_profile(spectra: DataFrame, digits: int = 4) -> DataFrame:
    """Mean magnitude at each whole radius below the largest; a radius without points has 0."""
    s = spectra.select("image_id", _max_radius().alias("m"), F.floor(_distance()).alias("radius"), "magnitude")
    means = s.where(F.col("radius") < F.col("m")).groupBy("image_id", "radius").agg(F.avg("magnitude").alias("value"))
    every = s.groupBy("image_id").agg(F.max("m").alias("m")).where("m > 0").select("image_id", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("radius"))
    return every.join(means, ["image_id", "radius"], "left").select("image_id", F.col("radius").cast("int").alias("radius"), F.round(F.coalesce("value", F.lit(0.0)), digits).alias("value"))


def band_energy(spectra: DataFrame, low: float = 0.25, high: float = 0.75, digits: int = 6) -> DataFrame:
    """Shares of the energy within low, between, and from high times the largest radius."""
    d, m, e = _distance(), _max_radius(), F.col("magnitude") * F.col("magnitude")
    part = lambda c: F.coalesce(F.sum(F.when(c, e)), F.lit(0.0)) / F.nullif(F.sum(e), F.lit(0.0))
    by = spectra.groupBy("image_id").agg(
        part(d <= m * low).alias("low_freq_energy_ratio"), part((d > m * low) & (d < m * high)).alias("mid_freq_energy_ratio"), part((d >= m * high) & (d > m * low)).alias("high_freq_energy_ratio")
    )
    return by.select("image_id", *(F.round(c, digits).alias(c) for c in by.columns[1:]))


def directional_energy(spectra: DataFrame, edges: int = 36, digits: int = 3) -> DataFrame:
    """Energy in edges - 1 equal sectors from -pi up to (not including) pi; sectors without points have 0."""
    step = 2 * math.pi / (edges - 1)
    bin_ = F.floor((F.atan2(_v().cast("double"), _u().cast("double")) + math.pi) / step)
    s = spectra.select("image_id", bin_.cast("int").alias("bin"), (F.col("magnitude") * F.col("magnitude")).alias("e")).where(F.col("bin") < edges - 1)
    sums = s.groupBy("image_id", "bin").agg(F.sum("e").alias("value"))
    every = spectra.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0), F.lit(edges - 2))).alias("bin"))
    return every.join(sums, ["image_id", "bin"], "left").select("image_id", "bin", F.round(F.coalesce("value", F.lit(0.0)), digits).alias("value"))


def dominant_direction(energy: DataFrame, edges: int = 36, digits: int = 6) -> DataFrame:
    """The left edge, in degrees, of the sector with the most energy (the first of equal ones)."""
    order = Window.partitionBy("image_id").orderBy(F.desc("value"), "bin")
    best = energy.withColumn("k", F.row_number().over(order)).where("k = 1")
    return best.select("image_id", F.round(-180.0 + F.col("bin") * (360.0 / (edges - 1)), digits).alias("dominant_direction"))


def spectral_centroid(spectra: DataFrame, digits: int = 6) -> DataFrame:
    total = F.sum("magnitude")
    return spectra.groupBy("image_id").agg(F.round(F.coalesce(F.sum(F.col("magnitude") * _distance()) / F.nullif(total, F.lit(0.0)), F.lit(0.0)), digits).alias("centroid"))
