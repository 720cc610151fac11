"""Whole analyses: importance of features from several scores, encoding error, and the clustering run with its outputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annogrid.operators import advice, clusters


def combined_importance(scores: list[DataFrame], digits: int = 9) -> DataFrame:
    """Mean of the scores (feature, importance) that there are for each feature, each scaled to a sum of 1."""
    scaled = []
    for s in scores:
        total = s.agg(F.sum("importance").alias("_t"))
        scaled.append(s.crossJoin(F.broadcast(total)).select("feature", F.coalesce(F.try_divide(F.col("importance"), F.col("_t")), F.lit(0.0)).alias("importance")))
    both = reduce(DataFrame.unionByName, scaled)
    return both.groupBy("feature").agg(F.round(F.avg("importance"), digits).alias("importance"))


def encoding(points: DataFrame, k: int) -> tuple[DataFrame, float, list[list[float]]]:
    """Points in k principal components, the mean squared error of going back, and the components' loadings by feature."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = points.withColumn("features", array_to_vector("v"))
    model = PCA(k=k, inputCol="features", outputCol="z").fit(data)
    loadings = model.pc.toArray().tolist()  # one row for each feature
    rows = model.transform(data).select("id", "v", vector_to_array("z").alias("z"))
    table = F.array(*(F.array(*(F.lit(float(x)) for x in row)) for row in loadings))
    back = F.transform(table, lambda row: F.aggregate(F.zip_with(row, F.col("z"), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))
    error = rows.agg(F.avg(F.aggregate(F.zip_with("v", back, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) / F.size("v"))).first()[0]
    return rows.select("id", F.col("z").alias("v")), float(error or 0.0), loadings


def projected_importance(encoded: list[float], loadings: list[list[float]]) -> list[float]:
    """Importance of the encoded dimensions carried back to the features by the loadings' absolute values."""
    raw = [sum(abs(w) * x for w, x in zip(row, encoded, strict=True)) for row in loadings]
    total = sum(raw) or 1.0
    return [x / total for x in raw]


def cluster_run(features: DataFrame, names: list[str], folder: str, ks: range = range(2, 9), eps: tuple[float, ...] = clusters.EPS, id_col: str = "uid") -> DataFrame:
    """Scale, search, score and write: clusters.csv, results.csv, importance.csv and report.txt below the folder; returns the results."""
    from annogrid.operators.features import standardised

    spark = features.sparkSession
    scaled = standardised(features, names, [id_col], digits=12)
    points = scaled.select(F.col(id_col).alias("id"), F.array(*names).alias("v"))
    results = clusters.search(points, ks, eps)
    best = results.where("best").first()
    kind, _, number = best["name"].rpartition("_")
    fit = {"kmeans": clusters.kmeans_labels, "gmm": clusters.gmm_labels, "agglomerative": clusters.ward_labels}.get(kind)
    labels = fit(points, int(number)) if fit else clusters.dbscan(points, float(number))
    labelled = points.join(labels, "id")
    forest = clusters.forest_importance(labelled.select("v", F.col("label").cast("string").alias("label")))
    mutual = clusters.binned_mutual_information(labelled.select("label", "v")).withColumnRenamed("value", "importance")
    by_number = combined_importance([forest, mutual])
    importance = by_number.select(F.get(F.array(*(F.lit(n) for n in names)), F.col("feature")).alias("feature"), "importance")
    features.join(labels.withColumnRenamed("id", id_col), id_col).write.mode("overwrite").option("header", True).csv(f"{folder}/clusters.csv")
    results.write.mode("overwrite").option("header", True).csv(f"{folder}/results.csv")
    importance.write.mode("overwrite").option("header", True).csv(f"{folder}/importance.csv")
    facts = [("Algorithm", kind.upper()), ("Clusters", str(best["k"])), ("Silhouette", f"{best['silhouette']:.4f}"), ("Features", str(len(names)))]
    text = advice.report("ANNOTATION CLUSTERING ANALYSIS REPORT", facts, importance, results)
    spark.createDataFrame([(line,) for line in text.split("\n")], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/report.txt")
    return results
