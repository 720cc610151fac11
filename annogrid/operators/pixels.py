"""Pixel tables (image_id, row, col, b, g, r) and what is measured on them: exposure, tones, dynamic range."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ExposureLimits:
    over: int = 240
    under: int = 15
    significant: float = 2.0
    clip_high: int = 250
    clip_low: int = 5
    shadow_bin: int = 85
    highlight_bin: int = 171
    dark: float = 85.0
    bright: float = 170.0
    good_utilisation: float = 70.0


def gray() -> Column:
    """Rounded luma of the three channels; in whole numbers, so that halves are told exactly."""
    return F.floor((299 * F.col("r") + 587 * F.col("g") + 114 * F.col("b") + 500) / 1000).cast("int")


def luminance() -> Column:
    return 0.2126 * F.col("r") + 0.7152 * F.col("g") + 0.0722 * F.col("b")


def lab_lightness() -> Column:
    """CIE L of sRGB values from 0 to 255, scaled to 0..255."""
    linear = lambda c: F.when(F.col(c) / 255.0 <= 0.04045, F.col(c) / 255.0 / 12.92).otherwise(F.pow((F.col(c) / 255.0 + 0.055) / 1.055, F.lit(2.4)))
    y = 0.212671 * linear("r") + 0.715160 * linear("g") + 0.072169 * linear("b")
    return F.when(y > 0.008856, 116 * F.cbrt(y) - 16).otherwise(903.3 * y) * 2.55


def luminance_metrics(pixels: DataFrame, digits: int = 4) -> DataFrame:
    p = pixels.select("image_id", luminance().alias("l"), lab_lightness().alias("lab"), F.greatest("r", "g", "b").cast("double").alias("v"))
    by = p.groupBy("image_id").agg(
        F.avg("l").alias("avg_luminance"), F.median("l").alias("median_luminance"), F.stddev_pop("l").alias("std_luminance"), F.avg("lab").alias("avg_brightness_lab"),
        F.avg("v").alias("avg_brightness_hsv"), F.min("l").alias("min_luminance"), F.max("l").alias("max_luminance"),
    )
    by = by.withColumn("luminance_range", F.col("max_luminance") - F.col("min_luminance"))
    return by.select("image_id", *(F.round(c, digits).alias(c) for c in by.columns[1:]))




def exposure_issues(pixels: DataFrame, limits: ExposureLimits = ExposureLimits(), digits: int = 6) -> DataFrame:
    """Counts and shares of over- and underexposed pixels, and of clipped values of each channel."""
    share = lambda c: F.round(100.0 * F.count_if(c) / F.count(F.lit(1)), digits)
    named = {"blue": "b", "green": "g", "red": "r"}
    clipped = [share(F.col(c) >= limits.clip_high).alias(f"{n}_clipped_high_percent") for n, c in named.items()]
    clipped += [share(F.col(c) <= limits.clip_low).alias(f"{n}_clipped_low_percent") for n, c in named.items()]
    by = pixels.withColumn("y", gray()).groupBy("image_id").agg(
        F.count_if(F.col("y") >= limits.over).alias("overexposed_pixels"), share(F.col("y") >= limits.over).alias("overexposure_percentage"),
        F.count_if(F.col("y") <= limits.under).alias("underexposed_pixels"), share(F.col("y") <= limits.under).alias("underexposure_percentage"), *clipped,
    )
    over, under = F.col("overexposure_percentage") > limits.significant, F.col("underexposure_percentage") > limits.significant
    return by.withColumns({"is_overexposed": over, "is_underexposed": under, "has_exposure_issues": over | under})


def tonal_histogram(pixels: DataFrame, limits: ExposureLimits = ExposureLimits(), digits: int = 6) -> DataFrame:
    """Shares of shadows, midtones and highlights, the histogram's mean bin, entropy in bits and first peak."""
    counts = pixels.groupBy("image_id", gray().alias("y")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("image_id").agg(F.sum("n").alias("total"))
    p = counts.join(total, "image_id").withColumn("p", F.col("n") / F.col("total"))
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("p"))), F.lit(0.0))
    y = F.col("y")
    by = p.groupBy("image_id").agg(
        part(y < limits.shadow_bin).alias("s"), part((y >= limits.shadow_bin) & (y < limits.highlight_bin)).alias("m"), part(y >= limits.highlight_bin).alias("h"),
        F.sum(y * F.col("p")).alias("c"), (-F.sum(F.col("p") * F.log2("p"))).alias("e"), F.max_by(y, F.struct("n", (-y).alias("k"))).alias("histogram_peak"),
    )
    label = F.when(F.col("s") > 0.5, "shadows-heavy").when(F.col("h") > 0.5, "highlights-heavy").otherwise("balanced")
    return by.select(
        "image_id", F.round(100 * F.col("s"), digits).alias("shadows_percentage"), F.round(100 * F.col("m"), digits).alias("midtones_percentage"),
        F.round(100 * F.col("h"), digits).alias("highlights_percentage"), F.round("c", digits).alias("histogram_center"), F.round("e", digits).alias("histogram_entropy"),
        "histogram_peak", label.alias("tonal_distribution"),
    )


def dynamic_range(pixels: DataFrame, limits: ExposureLimits = ExposureLimits(), digits: int = 6) -> DataFrame:
    by = pixels.groupBy("image_id").agg(
        F.percentile(gray(), F.array(*(F.lit(q) for q in (0.01, 0.05, 0.95, 0.99)))).alias("q"), (F.max(gray()) - F.min(gray())).cast("double").alias("dynamic_range_full")
    )
    q = F.col("q")
    wide = (q[3] - q[0]) / 255.0 * 100
    return by.select(
        "image_id", "dynamic_range_full", F.round(q[3] - q[0], digits).alias("dynamic_range_99p"), F.round(q[2] - q[1], digits).alias("dynamic_range_95p"),
        F.round(wide, digits).alias("range_utilization_percent"), F.round(q[0], digits).alias("p1_percentile"), F.round(q[3], digits).alias("p99_percentile"),
        (wide > limits.good_utilisation).alias("has_good_dynamic_range"),
    )


def exposure_grade(pixels: DataFrame, limits: ExposureLimits = ExposureLimits()) -> DataFrame:
    """Compensation in stops, a sentence of advice, an addition to balanced images, and a grade."""
    share = lambda c: 100.0 * F.count_if(c) / F.count(F.lit(1))
    y = F.col("y")
    by = pixels.withColumn("y", gray()).groupBy("image_id").agg(
        share(y >= limits.over).alias("over"), share(y <= limits.under).alias("under"), F.avg("y").alias("mean"), F.count_if(y < 50).alias("low"), F.count_if(y >= 200).alias("high")
    )
    over, under, mean = F.col("over"), F.col("under"), F.col("mean")
    tiers = [(10.0, 2.0), (5.0, 1.0), (limits.significant, 0.5)]
    # fixed values: the sentences
    words = {2.0: "Significantly {}exposed", 1.0: "{}exposed", 0.5: "Slightly {}exposed"}
    verbs = {"over": "reduce", "under": "increase"}
    dark, bright, balanced = "Image appears dark - consider increasing exposure", "Image appears bright - consider reducing exposure", "Exposure appears well-balanced"
    more, less = "Consider slight exposure increase for better shadow detail", "Consider slight exposure decrease to prevent highlight clipping"
    stops, advice = F, F
    for share_, side, sign in ((over, "over", -1), (under, "under", 1)):
        for limit, amount in tiers:
            sentence = words[amount].format(side).capitalize() + f" - {verbs[side]} exposure by {amount} stops"
            stops, advice = stops.when(share_ > limit, sign * amount), advice.when(share_ > limit, sentence)
    stops = stops.when(mean < limits.dark, 0.5).when(mean > limits.bright, -0.5).otherwise(0.0)
    advice = advice.when(mean < limits.dark, dark).when(mean > limits.bright, bright).otherwise(balanced)
    added = F.when((advice == balanced) & (F.col("low") > F.col("high")), more).when((advice == balanced) & (F.col("high") > F.col("low")), less)
    grade = F.when((over > 10) | (under > 10), "Poor").when((over > 5) | (under > 5), "Fair").when((over < 1) & (under < 1) & mean.between(limits.dark, limits.bright), "Excellent").otherwise("Good")
    return by.select("image_id", stops.alias("exposure_compensation_stops"), advice.alias("recommendation"), added.alias("second_recommendation"), grade.alias("overall_exposure_quality"))


def brightness_summary(pixels: DataFrame) -> DataFrame:
    light, tones, range_ = luminance_metrics(pixels), tonal_histogram(pixels), dynamic_range(pixels)
    return light.join(tones, "image_id").join(range_, "image_id").select(
        "image_id", F.col("avg_luminance").alias("average_brightness"), F.col("tonal_distribution").alias("brightness_distribution"),
        F.col("range_utilization_percent").alias("dynamic_range_utilization"), "histogram_center",
    )


def percentile_normalised(pixels: DataFrame, low: float = 0.01, high: float = 0.998, clip: bool = True, digits: int = 6) -> DataFrame:
    """Gray values stretched so that each image's two percentiles become 0 and 255."""
    q = pixels.groupBy("image_id").agg(F.percentile(gray(), F.array(F.lit(low), F.lit(high))).alias("q"))
    v = 255.0 * (gray() - F.col("q")[0]) / (F.col("q")[1] - F.col("q")[0] + 1e-20)
    v = F.least(F.greatest(v, F.lit(0.0)), F.lit(255.0)) if clip else v
    # A row for each image is the side to hash: pixels, whose number Catalyst may take for that of the images, must not be broadcast.
    return pixels.join(q.hint("shuffle_hash"), "image_id").select("image_id", "row", "col", F.round(v, digits).alias("value"))


def image_problems(images: DataFrame, colour: bool = False) -> DataFrame:
    """(image_id, problem) of images (image_id, height, width, channels) that aren't gray or colour images with pixels.

    colour: three channels are asked for, as the correction of colour fringes needs them.
    """
    shape = F.when(~F.coalesce((F.col("height") > 0) & (F.col("width") > 0), F.lit(False)), "no pixels")
    allowed = [3] if colour else [1, 3, 4]
    problem = shape.when(~F.coalesce(F.col("channels").isin(allowed), F.lit(False)), "not HxWx3" if colour else "not 2D or 3D")
    return images.select("image_id", problem.alias("problem")).where(F.col("problem").isNotNull())


def cropped(pixels: DataFrame, top: int, left: int, height: int, width: int) -> DataFrame:
    """The pixels of a window, their places counted from its corner."""
    r, c = F.col("row"), F.col("col")
    inside = pixels.where((r >= top) & (r < top + height) & (c >= left) & (c < left + width))
    return inside.withColumns({"row": r - top, "col": c - left})
