"""COCO documents: reading one into relations, writing relations as one document or by resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

IMAGES = "array<struct<id:bigint,width:int,height:int,file_name:string,license:int,date_captured:string>>"
CATEGORIES = "array<struct<id:bigint,name:string,supercategory:string>>"
CORE = {"id": "bigint", "image_id": "bigint", "category_id": "bigint", "area": "double", "bbox": "array<double>", "iscrowd": "int", "keypoints": "array<double>"}


def read(spark: SparkSession, path: str, lines: bool = False) -> dict[str, DataFrame]:
    """images, categories, annotations, info and licenses of the JSON documents at a path: one in each file, or one in each line.

    Annotations keep every property in `extra` (variant); segmentation is the list of flat polygons, null where it has
    another form; position numbers them in the order of the document.
    """
    doc = spark.read.option("wholetext", not lines).text(path).select(F.parse_json("value").alias("d"))

    def listed(name: str, kind: str) -> DataFrame:
        return doc.select(F.inline(F.try_variant_get("d", f"$.{name}", kind)))

    items = doc.select(F.posexplode(F.try_variant_get("d", "$.annotations", "array<variant>")).alias("position", "extra"))
    core = [F.try_variant_get("extra", f"$.{c}", kind).alias(c) for c, kind in CORE.items()]
    polygons = F.try_variant_get("extra", "$.segmentation", "array<array<double>>").alias("segmentation")
    return {
        "images": listed("images", IMAGES),
        "categories": listed("categories", CATEGORIES),
        "annotations": items.select("position", *core, polygons, "extra"),
        "info": doc.select(F.try_variant_get("d", "$.info", "map<string,string>").alias("info")),
        "licenses": doc.select(F.explode(F.try_variant_get("d", "$.licenses", "array<map<string,string>>")).alias("license")),
    }


def last_by_id(df: DataFrame, position: str, id_col: str = "id") -> DataFrame:
    """Of rows with the same id the last by position."""
    order = Window.partitionBy(id_col).orderBy(F.desc(position))
    return df.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def boxes(annotations: DataFrame) -> DataFrame:
    """Corners of the annotations that have a box: idx, image_id, x0, y0, x1, y1."""
    b = F.col("bbox")
    return annotations.where(b.isNotNull() & (F.size(b) == 4)).select(F.col("id").alias("idx"), "image_id", b[0].alias("x0"), b[1].alias("y0"), (b[0] + b[2]).alias("x1"), (b[1] + b[3]).alias("y1"))


def rectangles_of_images(annotations: DataFrame, image_ids: DataFrame) -> DataFrame:
    """Rectangles of the images asked for, numbered from 0 in the order of the images, then of the annotations."""
    from annogrid.operators.merge import numbered

    joined = annotations.join(image_ids.select(F.col("id").alias("image_id"), F.col("position").alias("image_position")), "image_id")
    numbers = numbered(joined.select("id", "image_position", "position"), "image_position", "position").withColumn("idx", F.col("number") - 1)
    return boxes(annotations).withColumnRenamed("idx", "id").join(numbers.select("id", "idx"), "id")


def document(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """One row with a whole document as JSON, for datasets that fit into one string; larger ones are written by write_parts."""
    gathered = None
    for name, df, order in (("images", images, "id"), ("annotations", annotations, "id"), ("categories", categories, "id")):
        one = df.agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in df.columns if c != order]))).alias(name))
        gathered = one if gathered is None else gathered.crossJoin(one)
    return gathered.select(F.to_json(F.struct("images", "annotations", "categories")).alias("value"))


def documents(images: DataFrame, annotations: DataFrame, categories: DataFrame, n: int) -> DataFrame:
    """n documents as JSON lines, one for each part of the images (by the hash of their id) with their annotations and all
    categories: a dataset of any size, each document of a bounded one. read() with lines takes the folder they are written to."""
    part = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(n))
    listed = lambda df, name, by: df.groupBy(by.alias("part")).agg(F.array_sort(F.collect_list(F.struct("id", *[c for c in df.columns if c != "id"]))).alias(name))
    parts = listed(images, "images", part("id")).join(listed(annotations, "annotations", part("image_id")), "part", "full")
    named = categories.agg(F.array_sort(F.collect_list(F.struct("id", *[c for c in categories.columns if c != "id"]))).alias("categories"))
    empty = {c: F.coalesce(F.col(c), F.array()) for c in ("images", "annotations")}
    return parts.crossJoin(F.broadcast(named)).withColumns(empty).select(F.to_json(F.struct("images", "annotations", "categories")).alias("value"))


def write_parts(images: DataFrame, annotations: DataFrame, folder: str) -> None:
    """Annotations with their image's size and name as JSON lines, a folder for each resolution."""
    sized = annotations.join(images.select(F.col("id").alias("image_id"), "width", "height", "file_name"), "image_id")
    sized.write.mode("overwrite").partitionBy("width", "height").json(folder)
