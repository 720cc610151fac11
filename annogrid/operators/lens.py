"""Lens correction plans: which camera and lens profile applies to an image's metadata, and the radial remap of its pixels.

Profiles are a table given by the user: make, model, crop_factor, lens, k1, k2, k3 (r' = r (1 + k1 r^2 + k2 r^4 + k3 r^6),
r in half diagonals). No profile database comes with the package.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annogrid.functions.strings import rational


def planned(metadata: DataFrame, profiles: DataFrame) -> DataFrame:
    """Images (image_id, m: map) with status corrected or the reason for skipping, focal length, aperture, distance and profile."""
    get = lambda k: F.try_element_at(F.col("m"), F.lit(k))
    wanted = metadata.select(
        "image_id", F.lower(F.coalesce(get("Image Make"), F.lit(""))).alias("make"), F.lower(F.coalesce(get("Image Model"), F.lit(""))).alias("model"), F.lower(get("EXIF LensModel")).alias("wanted"),
        rational(get("EXIF FocalLength")).alias("focal_length"), rational(get("EXIF ApertureValue")).alias("aperture"),
        F.coalesce(get("RelativeAltitude").try_cast("double"), rational(get("EXIF SubjectDistance")), F.lit(0.0)).alias("distance"),
    )
    known = profiles.select(F.lower("make").alias("make"), F.lower("model").alias("model"), F.lower("lens").alias("_lens"), "lens", "crop_factor", "k1", "k2", "k3")
    order = Window.partitionBy("image_id").orderBy(F.desc(F.coalesce(F.col("fits"), F.lit(False))), "_lens")
    joined = wanted.join(known, ["make", "model"], "left").withColumn("fits", F.col("_lens").isNotNull() & (F.col("wanted").isNull() | (F.col("wanted") == F.col("_lens"))))
    best = joined.withColumn("_k", F.row_number().over(order)).where("_k = 1")
    status = (
        F.when(F.col("_lens").isNull(), "camera not found").when(~F.col("fits"), "lens not found")
        .when(F.col("focal_length").isNull() | F.col("aperture").isNull(), "focal length or aperture missing").otherwise("corrected")
    )
    return best.select("image_id", status.alias("status"), "focal_length", "aperture", "distance", "lens", "crop_factor", "k1", "k2", "k3")


def counts(plan: DataFrame) -> DataFrame:
    """corrected and skipped images."""
    return plan.agg(F.count_if(F.col("status") == "corrected").alias("corrected"), F.count_if(F.col("status") != "corrected").alias("skipped"))


def remapped(pixels: DataFrame, plan: DataFrame, values: list[str]) -> DataFrame:
    """Pixels (image_id, row, col, rows, cols, values) of corrected images, each taken bilinearly from its distorted place; outside is 0."""
    half_r, half_c = (F.col("rows") - 1) / 2, (F.col("cols") - 1) / 2
    y, x = F.col("row") - half_r, F.col("col") - half_c
    r2 = (x * x + y * y) / (half_r * half_r + half_c * half_c)
    factor = 1 + F.col("k1") * r2 + F.col("k2") * r2 * r2 + F.col("k3") * r2 * r2 * r2
    known = plan.where(F.col("status") == "corrected").select("image_id", "k1", "k2", "k3")
    p = pixels.join(known.hint("shuffle_hash"), "image_id").select("image_id", "row", "col", (y * factor + half_r).alias("sy"), (x * factor + half_c).alias("sx"), *values)
    # A pixel stands for itself and for the four places that it is taken from; those of one place meet in a window, so that
    # pixels are not joined with pixels.
    fy, fx = F.col("sy") - F.floor("sy"), F.col("sx") - F.floor("sx")
    entry = lambda own, weight, r, c: F.struct(F.lit(own).alias("own"), weight.cast("double").alias("weight"), r.cast("long").alias("qr"), c.cast("long").alias("qc"))
    taps = [entry(False, (fy if a else 1 - fy) * (fx if b else 1 - fx), F.floor("sy") + a, F.floor("sx") + b) for a in (0, 1) for b in (0, 1)]
    entries = p.withColumn("e", F.explode(F.array(entry(True, F.lit(1.0), F.col("row"), F.col("col")), *taps))).where("e.weight > 0")
    place = Window.partitionBy("image_id", "e.qr", "e.qc")
    hit = entries.select("image_id", "row", "col", "e.own", "e.weight", *(F.sum(F.when(F.col("e.own"), F.col(v))).over(place).alias(v) for v in values)).where("not own")
    return hit.groupBy("image_id", "row", "col").agg(*(F.coalesce(F.sum(F.col("weight") * F.col(v)), F.lit(0.0)).alias(v) for v in values))
