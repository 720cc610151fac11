"""Connected components by repeated smallest-label exchange, with the lineage cut in the shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it isn't set, a folder of our own on a local master; on a cluster an error, as its
    machines share no such folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="annogrid-checkpoints-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the edges (a, b): labels take the smallest label nearby, then that label's own label."""
    e = edges.where(F.col("a") != F.col("b"))
    both = checkpointed(e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component"))
    labels = checkpointed(labels)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("component").alias("old"), F.least("component", "m").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("component").alias("far"))
        moved = checkpointed(step.join(jump, "new").select("node", "old", F.least("new", "far").alias("component")))
        labels = moved.select("node", "component")
        if not moved.where(F.col("old") != F.col("component")).limit(1).count():
            return labels
