"""Advice from a clustering: top features, augmentations, class weights, the bundle of all, and the text report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: fixed values: what an important feature calls for, and the sentences
POSITION = ("bbox_x_center", "bbox_y_center", "horizontal_position", "vertical_position")
SIZE = ("bbox_area", "bbox_width", "bbox_height", "bbox_aspect_ratio")
STRETCH = ("bbox_elongation",)
SENTENCES = [
    (POSITION, "Apply random translations, crops, and spatial flips."),
    (SIZE, "Apply random scaling and aspect ratio jitter."),
    (STRETCH, "Consider random rotations and stretching."),
]
STANDARD = "Standard color and geometric augmentations recommended."
BALANCED = "No particularly hard-to-separate clusters detected. Use standard class balancing."


def top_features(importance: DataFrame, n: int) -> DataFrame:
    """The n features (feature, importance) with the highest values, ties by name, ranked from 1."""
    best = importance.orderBy(F.desc("importance"), "feature").limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature"))).select("rank", "feature", "importance")


def augmentations(importance: DataFrame, least: float = 0.2) -> DataFrame:
    """Sentences for the kinds of features of which one has more than `least` importance; else the standard one."""
    flags = importance.agg(*(F.coalesce(F.bool_or(F.col("feature").isin(*names) & (F.col("importance") > least)), F.lit(False)).alias(f"f{k}") for k, (names, _) in enumerate(SENTENCES)))
    said = F.array_compact(F.array(*(F.when(F.col(f"f{k}"), F.lit(s)) for k, (_, s) in enumerate(SENTENCES))))
    said = F.when(F.size(said) > 0, said).otherwise(F.array(F.lit(STANDARD)))
    return flags.select(F.posexplode(said).alias("position", "advice"))


def weak_features(importance: DataFrame) -> DataFrame:
    """Features with less than half of the mean importance."""
    mean = importance.agg((F.avg("importance") / 2).alias("_half"))
    return importance.crossJoin(F.broadcast(mean)).where(F.col("importance") < F.col("_half")).select("feature")


def class_weight_advice(rows: DataFrame, label: str, category: str, importance: DataFrame | None = None) -> DataFrame:
    """Sentences on clusters that mix categories and on features that separate little; else that nothing stands out."""
    from annogrid.operators.clusters import hard_clusters

    hard = hard_clusters(rows, label, category).select("label")
    mixed = rows.join(F.broadcast(hard), rows[label] == hard["label"]).groupBy("label").agg(F.array_join(F.array_sort(F.collect_set(F.col(category).cast("string"))), ", ").alias("cats"))
    listed = hard.agg(F.array_join(F.array_sort(F.collect_list(F.col("label").cast("string"))), ", ").alias("all"), F.count(F.lit(1)).alias("n")).where("n > 0")
    first = listed.select(F.lit(0).alias("position"), F.format_string("Increase loss weight for objects in clusters: [%s] (these are hard to separate).", "all").alias("advice"))
    each = mixed.select(F.lit(1).alias("position"), F.format_string("Cluster %s mixes categories [%s]. Consider more data or cleaning for these.", F.col("label").cast("string"), "cats").alias("advice"))
    out = first.unionByName(each)
    if importance is not None:
        weak = weak_features(importance).agg(F.array_join(F.array_sort(F.collect_list("feature")), ", ").alias("all"), F.count(F.lit(1)).alias("n")).where("n > 0")
        out = out.unionByName(weak.select(F.lit(2).alias("position"), F.format_string("Objects differing mostly by [%s] are difficult to separate; consider more varied examples or domain-specific augmentations.", "all").alias("advice")))
    none = out.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(3).alias("position"), F.lit(BALANCED).alias("advice"))
    return out.unionByName(none)


def recommendations(algorithm: str, k: int, importance: DataFrame, sizes: DataFrame, rows: DataFrame, label: str, category: str) -> DataFrame:
    """(part, position, value) of the whole bundle as strings."""
    from annogrid.operators.clusters import anchors

    spark = importance.sparkSession
    head = spark.createDataFrame([("best_algorithm", 0, algorithm), ("n_clusters", 0, str(k))], "part string, position int, value string")
    top = top_features(importance, 8).select(F.lit("top_features").alias("part"), F.col("rank").alias("position"), F.col("feature").alias("value"))
    boxes = anchors(sizes).select(F.lit("anchor_boxes").alias("part"), F.col("rank").alias("position"), F.format_string("%.6f x %.6f", "w", "h").alias("value"))
    more = augmentations(importance).select(F.lit("augmentations").alias("part"), "position", F.col("advice").alias("value"))
    weights = class_weight_advice(rows, label, category, importance).select(F.lit("class_weight_advice").alias("part"), "position", F.col("advice").alias("value"))
    return head.unionByName(top).unionByName(boxes).unionByName(more).unionByName(weights)


def report(title: str, facts: list[tuple[str, str]], importance: DataFrame, results: DataFrame) -> str:
    """A text of facts, the ten most important features, and all results (name, k, silhouette) by falling silhouette; without one a model was not tried."""
    rule, thin = "=" * 80, "-" * 40
    lines = [rule, title, rule, *(f"{k}: {v}" for k, v in facts), "", "TOP 10 SEPARATING FEATURES", thin]
    lines += [f"{r['rank']:2d}. {r.feature:<30} {r.importance:.6f}" for r in top_features(importance, 10).orderBy("rank").collect()]
    lines += ["", "ALL RESULTS", thin]
    lines += [f"{r.name:<28} | clusters: {r.k:2d} | silhouette: {'not tried' if r.silhouette is None else format(r.silhouette, '.4f')}" for r in results.orderBy(F.desc("silhouette"), "name").collect()]
    return "\n".join(lines)
