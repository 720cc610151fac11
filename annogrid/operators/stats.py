"""Validation and statistics of annotation relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _stacked(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def validate_ids(relations: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """For each named relation and id column: rows, distinct ids, and whether ids are unique."""
    return _stacked(
        [
            df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(c).alias("n_distinct")).select(
                F.lit(name).alias("entity"), "n", "n_distinct", (F.col("n") == F.col("n_distinct")).alias("is_unique")
            )
            for name, (df, c) in relations.items()
        ]
    )


def summarise_ids(relations: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Count, smallest and largest id; nulls for an empty relation."""
    return _stacked(
        [
            df.agg(F.count(F.lit(1)).alias("n"), F.min(c).cast("long").alias("min_id"), F.max(c).cast("long").alias("max_id")).select(F.lit(name).alias("entity"), "n", "min_id", "max_id")
            for name, (df, c) in relations.items()
        ]
    )


def duplicates(df: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once, and how often."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def count_by(df: DataFrame, column: str, name: str = "key") -> DataFrame:
    """Rows for each value that occurs."""
    return df.groupBy(F.col(column).alias(name)).agg(F.count(F.lit(1)).alias("n"))


def area_stats(df: DataFrame, area: Column) -> DataFrame:
    return df.agg(F.count(area).alias("n"), F.min(area).alias("min_area"), F.max(area).alias("max_area"), F.round(F.avg(area), 6).alias("mean_area"))


def without_match(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """Distinct ids of the left side that the right side doesn't have."""
    return left.select(left_id).join(right.select(F.col(right_id).alias(left_id)), left_id, "left_anti").distinct()


def keep_ids(df: DataFrame, column: str, ids: list[int] | DataFrame) -> DataFrame:
    """Rows whose value is among the ids, given as a list or as a relation of one column."""
    if isinstance(ids, DataFrame):
        return df.join(ids.toDF(column), column, "left_semi")
    return df.where(F.col(column).isin(ids))


def flat_annotations(boxes: DataFrame, categories: DataFrame) -> DataFrame:
    """Annotations with their category's name (else Unknown) and the box's derived values; other columns are kept."""
    names = categories.select(F.col("id").alias("category_id"), F.col("name").alias("_name"))
    ratio = F.when(F.col("h") > 0, F.col("w") / F.col("h")).otherwise(0.0)
    derived = {"bbox_x": F.col("x"), "bbox_y": F.col("y"), "bbox_width": F.col("w"), "bbox_height": F.col("h"), "bbox_area": F.col("w") * F.col("h"), "bbox_aspect_ratio": ratio}
    joined = boxes.join(names, "category_id", "left").withColumn("category_name", F.coalesce("_name", F.lit("Unknown"))).drop("_name")
    return joined.withColumns({k: v for k, v in derived.items() if k not in boxes.columns})


def category_summary(flat: DataFrame) -> DataFrame:
    """Count, share, mean area and mean aspect ratio by category."""
    by = flat.groupBy(F.col("category_name").alias("category")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("bbox_area"), 6).alias("avg_area"), F.round(F.avg("bbox_aspect_ratio"), 6).alias("avg_aspect_ratio")
    )
    total = by.agg(F.sum("n").alias("_total"))
    return by.crossJoin(F.broadcast(total)).select("category", "n", F.round(100.0 * F.col("n") / F.col("_total"), 6).alias("percentage"), "avg_area", "avg_aspect_ratio")


def categorical_property(flat: DataFrame, prop: str, category: str = "category_name") -> DataFrame:
    """Counts of a property's values by category, as a share of all the category's rows."""
    counts = flat.groupBy(category, F.col(prop).cast("string").alias("prop")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(category).agg(F.sum("n").alias("_total"))
    return counts.where(F.col("prop").isNotNull()).join(totals, category).select(category, "prop", "n", F.round(100.0 * F.col("n") / F.col("_total"), 6).alias("percentage"))


def numerical_property(flat: DataFrame, prop: str, category: str = "category_name", digits: int = 3) -> DataFrame:
    """Count, mean, deviation, extremes and linear quartiles of a property by category; halves are rounded to even."""
    v = F.col(prop).cast("double")
    by = flat.where(v.isNotNull()).groupBy(category).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q")
    )
    q = {"q25": F.col("_q")[0], "median": F.col("_q")[1], "q75": F.col("_q")[2]}
    named = {k: F.bround(F.col(k), digits) for k in ("mean", "std", "min", "max")} | {k: F.bround(x, digits) for k, x in q.items()}
    return by.select(category, "n", *(x.alias(k) for k, x in named.items()))


def property_types(flat: DataFrame, position: str, columns: list[str], sample_size: int = 100) -> DataFrame:
    """The kind of each column's first value among the first rows by position: boolean, numerical, categorical, list or other."""
    kinds = {"boolean": "boolean", "string": "categorical"} | dict.fromkeys(("tinyint", "smallint", "int", "bigint", "float", "double"), "numerical")
    types = dict(flat.dtypes)
    head = flat.orderBy(position).limit(sample_size)
    seen = head.agg(*(F.count(c).alias(c) for c in columns))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("prop"), F.col(c).alias("seen"), F.lit("list" if types[c].startswith("array") else kinds.get(types[c], "other")).alias("kind")) for c in columns))).alias("p")
    return seen.select(pairs).select("p.*").where(F.col("seen") > 0).select("prop", "kind")


def resolution_groups(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """Images and annotations for each resolution."""
    per_image = boxes.groupBy("image_id").agg(F.count(F.lit(1)).alias("k"))
    joined = images.join(per_image, images["id"] == per_image["image_id"], "left")
    return joined.groupBy("width", "height").agg(F.count(F.lit(1)).alias("n_images"), F.coalesce(F.sum("k"), F.lit(0)).cast("long").alias("n_annotations"))
