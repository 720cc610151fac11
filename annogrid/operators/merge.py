"""Merging one annotation dataset into another: id collisions, new image and category numbers, references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annogrid.operators.graph import checkpointed


def collision_flags(base: DataFrame, new: DataFrame, id_col: str = "id", position: str = "position") -> DataFrame:
    """For each new row: whether its id is in the base, and whether it occurred earlier among the new rows."""
    order = Window.partitionBy(id_col).orderBy(position)
    numbered = new.withColumn("repeated", F.row_number().over(order) > 1)
    there = base.select(id_col).distinct().withColumn("in_base", F.lit(True))
    return numbered.join(there, id_col, "left").withColumn("in_base", F.coalesce("in_base", F.lit(False)))


def remapped_ids(base: DataFrame, new: DataFrame, id_col: str = "id", position: str = "position", strict: bool = False) -> DataFrame:
    """New rows with new_id and collided.

    Rows are taken in order. An id collides if the base has it, if it came earlier, or if it lies in the range of numbers
    given out so far; the k-th collision gets the largest base id plus k. Only the third test depends on the order, and
    only ids just above the base's largest can meet it, so that the fold runs over those and the flagged rows alone.
    strict: numbers are given out above both datasets, where no id can meet them, and no fold is needed.
    """
    flags = collision_flags(base, new, id_col, position).withColumn("flagged", F.col("in_base") | F.col("repeated"))
    top = base.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("top"))
    if strict:
        top = base.select(id_col).unionByName(new.select(id_col)).agg(F.coalesce(F.max(id_col), F.lit(0)).alias("top"))
        counted = numbered(flags.where("flagged").select(position), position).withColumn("collided", F.lit(True))
        out = flags.join(counted, position, "left").crossJoin(F.broadcast(top))
        return out.select(*new.columns, F.when(F.col("collided"), F.col("top") + F.col("number")).otherwise(F.col(id_col)).alias("new_id"), F.coalesce("collided", F.lit(False)).alias("collided"))
    flags = flags.crossJoin(F.broadcast(top))
    flagged = flags.where("flagged").agg(F.count(F.lit(1)).alias("n"), F.max("top").alias("t")).first()
    # Each id in the reach of the numbers given out can itself collide and lengthen the reach.
    limit, least = flagged["n"], flagged["t"] if flagged["t"] is not None else 0
    while True:
        reach = flags.where(~F.col("flagged") & (F.col(id_col) > least) & (F.col(id_col) <= least + limit)).count()
        if flagged["n"] + reach == limit:
            break
        limit = flagged["n"] + reach
    touched = flags.where(F.col("flagged") | (F.col(id_col) > least) & (F.col(id_col) <= least + limit)).select(position, F.col(id_col).cast("long").alias("_id"), "flagged")
    folded = _folded(touched, position, least)
    out = flags.join(folded, position, "left").withColumn("collided", F.coalesce("collided", F.lit(False)))
    return out.select(*new.columns, F.when(F.col("collided"), F.col("top") + F.col("number")).otherwise(F.col(id_col)).alias("new_id"), "collided")


def _folded(touched: DataFrame, position: str, least: int) -> DataFrame:
    """(position, collided, number) of the rows (position, _id, flagged): the running count of collisions.

    The rows are drawn into ranges of the position, and each range is folded in a task of its own from the number of
    collisions before it. That number is first taken to be the flagged rows before; a round gives each range's own count,
    and rounds are repeated until the numbers they began with are those that came out. The first range is right after
    the first round, and each round makes at least one more final; where ids rise with the position, two or three do.
    """
    import numpy as np
    import pyarrow as pa

    ranged = checkpointed(touched.repartitionByRange(position).withColumn("_p", F.spark_partition_id()))
    kind = dict(touched.dtypes)[position]

    def fold(start: int, table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        table = table.sort_by(position)
        hit = table.column("flagged").to_numpy().copy()
        over = table.column("_id").to_numpy() - least
        before = np.cumsum(hit) - hit  # flagged rows of the range before each row
        extra = 0
        for i in np.flatnonzero(~hit & (over > 0)).tolist():
            if over[i] <= start + int(before[i]) + extra:
                hit[i] = True
                extra += 1
        return table, hit

    def run(starts: dict[int, int] | None):
        def count(table: pa.Table) -> pa.Table:
            p = table.column("_p")[0].as_py()
            return pa.table({"_p": pa.array([p], pa.int32()), "n": pa.array([int(fold(starts[p], table)[1].sum())], pa.int64())})

        def rows(table: pa.Table) -> pa.Table:
            start = starts[table.column("_p")[0].as_py()]
            table, hit = fold(start, table)
            return pa.table({position: table.column(position), "collided": pa.array(hit), "number": pa.array(start + np.cumsum(hit), pa.int64())})

        return count, rows

    def before(counts: dict[int, int]) -> dict[int, int]:
        total, out = 0, {}
        for p in sorted(counts):
            out[p], total = total, total + counts[p]
        return out

    # One number for each range reaches the driver.
    starts = before({r["_p"]: r["n"] for r in ranged.groupBy("_p").agg(F.count_if("flagged").alias("n")).collect()})
    while True:
        found = ranged.groupBy("_p").applyInArrow(run(starts)[0], "_p int, n long").collect()
        after = before({r["_p"]: r["n"] for r in found})
        if after == starts:
            return ranged.groupBy("_p").applyInArrow(run(starts)[1], f"`{position}` {kind}, collided boolean, number long")
        starts = after


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Rows numbered from 1 by the columns without one task for all: counts of ranges are added up before.

    The ranges are drawn once and kept in the checkpoint folder, as both the numbers and the counts rest on them.
    """
    ranged = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    local = ranged.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    local = checkpointed(local)
    counts = local.groupBy("_p").agg(F.max("_k").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return local.join(F.broadcast(before), "_p").select(*df.columns, (F.col("_k") + F.col("_before")).alias("number"))


def merged_images(base: DataFrame, new: DataFrame, position: str = "id") -> DataFrame:
    """(old_id, new_id) of the new images in the order of the position: as in remapped_ids, an id that is taken gets the next number."""
    rows = new.select(F.col("id"), F.col(position).alias("_position"))
    return remapped_ids(base.select("id"), rows, "id", "_position").select(F.col("id").alias("old_id"), "new_id")


def merged_categories(base: DataFrame, new: DataFrame, position: str = "id") -> DataFrame:
    """(old_id, new_id, added) of the new categories: by name.

    A name that the base has takes the base's id, of several the last one's by the position; another name gets the next
    number in the order in which names come first, and keeps it where it comes again (added is true for the first alone).
    """
    known = base.groupBy("name").agg(F.max_by("id", position).alias("_known"))
    joined = new.select("id", "name", F.col(position).alias("_position")).join(known, "name", "left")
    names = joined.where(F.col("_known").isNull()).groupBy("name").agg(F.min(F.struct("_position", "id")).alias("_first"))
    counted = numbered(names.select("name", "_first"), "_first")
    top = base.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    out = joined.join(counted, "name", "left").crossJoin(F.broadcast(top))
    first = F.coalesce((F.col("_position") == F.col("_first._position")) & (F.col("id") == F.col("_first.id")), F.lit(False))
    return out.select(F.col("id").alias("old_id"), F.coalesce("_known", F.col("top") + F.col("number")).cast("long").alias("new_id"), first.alias("added"))


def with_new_references(rows: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Replace a column's values by the mapping's new ids where it has them; of several for one id the last that was given out."""
    m = mapping.groupBy(F.col("old_id").alias(column)).agg(F.max("new_id").alias("_new"))
    return rows.join(m, column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new").select(*rows.columns)


def merge(base: dict[str, DataFrame], new: dict[str, DataFrame], strict: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """Merge images, categories and annotations (id, image_id, category_id, position); the merged relations and one row of counts."""
    images, categories = merged_images(base["images"], new["images"]), merged_categories(base["categories"], new["categories"])
    ids = remapped_ids(base["annotations"], new["annotations"], strict=strict)
    placed = with_new_references(with_new_references(ids, images, "image_id"), categories, "category_id")
    renamed = placed.withColumn("id", F.col("new_id")).drop("new_id", "collided")
    added = new["images"].join(images.withColumnRenamed("old_id", "id").distinct(), "id").withColumn("id", F.col("new_id")).drop("new_id")
    named = new["categories"].join(categories.where("added").withColumnRenamed("old_id", "id"), "id").withColumn("id", F.col("new_id")).drop("new_id", "added")
    out = {
        "annotations": base["annotations"].unionByName(renamed, allowMissingColumns=True),
        "images": base["images"].unionByName(added, allowMissingColumns=True),
        "categories": base["categories"].unionByName(named, allowMissingColumns=True),
    }
    counts = ids.agg(F.count(F.lit(1)).alias("annotations_added"), F.count_if("collided").alias("annotations_remapped"))
    counts = counts.crossJoin(images.agg(F.count_if(F.col("old_id") != F.col("new_id")).alias("images_remapped")))
    return out, counts.crossJoin(categories.agg(F.count_if("added").alias("categories_added")))
