"""What the corpus operators share: reading tables, shared folders, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch: texts may be long, so that batches stay small.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> None:
    """Session settings that bound the Python workers' memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it isn't set, a folder of our own
    on a local master; on a cluster, whose machines share no such folder, an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="annogrid-checkpoints-"))
    return context.getCheckpointDir()


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def stage(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage, survives lost executors.

    The table is deleted when the driver ends, or before by released().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    files, where = _file_system(spark, path)
    files.deleteOnExit(where)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage = path
    return out


def released(df: DataFrame) -> None:
    """Delete a staged table that nothing will read again."""
    files, where = _file_system(df.sparkSession, df._stage)
    files.delete(where, True)
    files.cancelDeleteOnExit(where)


def bounded_sample(rows: DataFrame, id_col: str, text_col: str, other: str, most: int, size: int) -> list[tuple[bytes, object]]:
    """(text, other) of whole rows for the driver: `most` rows and `size` bytes at most.

    Rows are taken in the order of their id's hash. Sizes are looked at before any text is gathered, so that a text that
    no longer fits is passed over without being read to the driver. Equal rows count once.
    """
    keyed = rows.select(F.col(id_col).alias("_id"), F.col(other).alias("_other"), F.encode(text_col, "UTF-8").alias("_text"))
    keyed = keyed.withColumns({"_size": F.octet_length("_text").cast("long"), "_hash": F.xxhash64("_text")})
    order = [F.xxhash64("_id"), F.col("_id"), F.col("_other"), F.col("_hash")]
    listed = keyed.select("_id", "_other", "_size", "_hash").orderBy(*order).limit(most)
    taken, places, total = [], {}, 0
    for row in listed.collect():
        key = (row["_id"], row["_other"], row["_hash"])
        if key not in places and total + row["_size"] <= size:
            places[key] = len(taken)
            taken.append(row)
            total += row["_size"]
    if not taken:
        return []
    chosen = rows.sparkSession.createDataFrame(taken, listed.schema).drop("_size")
    found = keyed.join(F.broadcast(chosen), ["_id", "_other", "_hash"]).dropDuplicates(["_id", "_other", "_hash"]).select("_id", "_other", "_hash", "_text").collect()
    found.sort(key=lambda r: places[r["_id"], r["_other"], r["_hash"]])
    return [(bytes(r["_text"]), r["_other"]) for r in found]


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with one output batch for each input batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def utf8_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, each text's start in them and its length. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    base = int(offsets[0])
    return flat[base : int(offsets[-1])], (offsets[:-1] - base).astype(np.int64), np.diff(offsets)


def texts_of(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
