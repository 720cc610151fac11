"""Connected components of an edge table by alternating stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annogrid.llm.common import released, stage

#: Edges in one file of a round's table: a few thousand edges aren't spread over a file (and a task) for each partition.
FILE_ROWS = 8192


def _tally(e: DataFrame) -> tuple:
    return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()


def stars(edges: DataFrame) -> tuple[DataFrame, int]:
    """(u, v) for every node u that can reach a smaller one, v being the smallest, and the number of these rows.

    Each round hangs every node's larger neighbours, then its smaller ones, on its smallest neighbour, until nothing
    changes; the edges are then stars. A round's edges are never more than twice the last one's, and a node's
    neighbours never meet in one row. Edges of a node to itself, repeated edges and those with a null are ignored.
    """
    e = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    e = stage(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before, now = None, _tally(e)
    while now[0] and now != before:
        # Large star: both ends see each other; larger neighbours go to the smallest of the neighbourhood.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        larger = e.select(F.col("v").alias("u"), F.col("u").alias("v"))
        hung = larger.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: what is left of a node's smaller neighbours goes to the smallest of them.
        least = hung.groupBy("u").agg(F.min("v").alias("m"))
        moved = hung.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        last, e = e, stage(new.coalesce(-(-2 * now[0] // FILE_ROWS)))
        released(last)
        before, now = now, _tally(e)
    return e, now[0]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is the smallest node that can be reached."""
    e, _ = stars(edges)
    found = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
