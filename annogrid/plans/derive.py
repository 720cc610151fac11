"""Annotation-shaped relations computed from the star-schema tables, by arithmetic that any engine repeats exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, width, height, file_name."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        (640 + 320 * (F.col("o_custkey") % 4)).cast("int").alias("width"),
        (480 + 240 * (F.col("o_orderkey") % 3)).cast("int").alias("height"),
        F.concat(F.lit("image_"), F.lpad(F.col("o_orderkey").cast("string"), 5, "0"), F.lit(".jpg")).alias("file_name"),
    )


def _brand_number():
    return F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit("")).cast("int")


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name."""
    return table(spark, sf_dir, "part").select(_brand_number().alias("id"), F.col("p_brand").alias("name")).distinct()


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, dup_id, image_id, category_id, x, y, w, h, iscrowd, line, status."""
    part = table(spark, sf_dir, "part").select("p_partkey", _brand_number().alias("category_id"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    line, offset = F.col("l_linenumber"), F.col("l_quantity") / 64.0
    return (
        table(spark, sf_dir, "lineitem")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            (F.col("l_orderkey") * 64 + F.row_number().over(order)).alias("uid"),
            (F.col("l_orderkey") * 8 + line).alias("dup_id"),
            F.col("l_orderkey").alias("image_id"),
            "category_id",
            ((F.col("l_partkey") * 31 + line * 97) % 400 + offset).alias("x"),
            ((F.col("l_suppkey") * 53 + line * 17) % 300 + offset).alias("y"),
            (8 + (F.col("l_partkey") * 7 + line * 13) % 200).cast("double").alias("w"),
            (8 + (F.col("l_suppkey") * 11 + line * 5) % 150).cast("double").alias("h"),
            F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("iscrowd"),
            line.alias("line"),
            F.col("l_linestatus").alias("status"),
        )
    )


def with_segmentation(boxes: DataFrame) -> DataFrame:
    """Adds segmentation, one flat polygon: a bow tie on every third line, else the box's rectangle."""
    x, y, x1, y1 = F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")
    bow, plain = F.array(x, y, x1, y1, x1, y, x, y1), F.array(x, y, x1, y, x1, y1, x, y1)
    return boxes.withColumn("segmentation", F.when(F.col("line") % 3 == 0, bow).otherwise(plain))


def rectangles(boxes: DataFrame) -> DataFrame:
    """idx, image_id, x0, y0, x1, y1 of annotations."""
    return boxes.select(F.col("uid").alias("idx"), "image_id", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"))


#: The same relations for the DuckDB side; a query's SQL begins with those it needs.
SQL = {
    "images": """images AS (
  SELECT o_orderkey AS id, CAST(640 + 320 * (o_custkey % 4) AS INT) AS width, CAST(480 + 240 * (o_orderkey % 3) AS INT) AS height,
         concat('image_', lpad(CAST(o_orderkey AS VARCHAR), 5, '0'), '.jpg') AS file_name FROM orders)""",
    "categories": """categories AS (SELECT DISTINCT CAST(replace(p_brand, 'Brand#', '') AS INT) AS id, p_brand AS name FROM part)""",
    "annotations": """annotations AS (
  SELECT l_orderkey * 64 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS uid,
         l_orderkey * 8 + l_linenumber AS dup_id, l_orderkey AS image_id, CAST(replace(p_brand, 'Brand#', '') AS INT) AS category_id,
         (l_partkey * 31 + l_linenumber * 97) % 400 + l_quantity / 64.0 AS x, (l_suppkey * 53 + l_linenumber * 17) % 300 + l_quantity / 64.0 AS y,
         CAST(8 + (l_partkey * 7 + l_linenumber * 13) % 200 AS DOUBLE) AS w, CAST(8 + (l_suppkey * 11 + l_linenumber * 5) % 150 AS DOUBLE) AS h,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS iscrowd, l_linenumber AS line, l_linestatus AS status
  FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "rects": """rects AS (SELECT uid AS idx, image_id, x AS x0, y AS y0, x + w AS x1, y + h AS y1 FROM annotations)""",
}


def sql(*names: str, body: str) -> str:
    """SQL with the relations that it needs."""
    needed = [n for n in SQL if n in names or n == "annotations" and "rects" in names]
    lead = "WITH RECURSIVE " + ",\n".join(SQL[n] for n in needed)
    body = body.strip()
    return f"{lead},\n{body[5:]}" if body.upper().startswith("WITH ") else f"{lead}\n{body}"
