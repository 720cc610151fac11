"""Exact top-k by inner product with Fagin's threshold algorithm.

Vectors are dealt into blocks; each block keeps, for every dimension, its vectors sorted by that component. For a query
the lists are read in parallel, from the end that the query's sign makes best, in stretches that double. Every vector met
gets its exact score; once the k-th best score is at least what a vector not met yet could reach (the sum over the
dimensions of the query's component times the last value read), the block's answer is final. A query's answers of all
blocks are merged by score and id.

The bound is the algorithm's own and nothing else ends a search. Over many dimensions of spread-out vectors it stays above
the k-th score until all vectors have been met (README has figures); over few it stops early.

Defined results: components become floor(scale * x); a vector that is null, has a null or non-finite component or
another length than the first dimension count given takes no part; rows with a null id take no part; every query row
asks for itself, also where rows share an id or are equal, and all rows but itself are its candidates; a query with
fewer than k candidates gets all; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annogrid.llm.common import prepare

#: Vectors in one block of candidates at the least and at the most (so that there are BLOCKS of them), queries in one block,
#: and entries of each list that are read first.
BLOCK_ROWS, MOST_ROWS, BLOCKS, QUERY_ROWS, STRETCH = 4096, 16384, 64, 32768, 32


class SortedLists:
    """A block's vectors with one sorted list for each dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.lists = np.argsort(self.vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(self.vectors, self.lists, axis=0)
        # Inner products in doubles are exact as long as all partial sums stay below 2 ** 53.
        largest = int(np.abs(self.vectors).max(initial=0))
        self.scored = self.vectors.astype(np.float64) if self.vectors.shape[1] * largest * largest < 1 << 50 else self.vectors

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The k best (ids, scores), ties to the smaller id, and how many vectors were scored."""
        n = len(self.ids)
        used = np.flatnonzero(query)
        small = self.vectors.shape[1] * int(np.abs(query).max(initial=0)) ** 2 < 1 << 50
        table = self.scored if small else self.vectors
        asked = query.astype(table.dtype)
        met = np.zeros(n, bool)
        low, high = np.searchsorted(self.ids, [query_id, query_id + 1])
        own = np.flatnonzero((self.vectors[low:high] == query).all(axis=1))
        met[low + own[:1]] = True  # the query's own row
        left = n - int(met.sum())
        total, found, scores = left, np.zeros(0, np.int64), np.zeros(0, np.int64)
        weights, falling = query[used], query[used] > 0
        depth = 0
        while left:
            end = min(n, max(STRETCH, 2 * depth))
            fresh = ~met
            if len(used):  # without a weight all score 0
                read = np.zeros(n, bool)
                read[self.lists[n - end : n - depth, used[falling]]] = True
                read[self.lists[depth:end, used[~falling]]] = True
                fresh &= read
            new = np.flatnonzero(fresh)
            met[new] = True
            left -= len(new)
            own = (table[new] @ asked).astype(np.int64)
            if len(found) == k:
                good = own >= scores[-1]
                new, own = new[good], own[good]
            elif len(new) > k:
                good = own >= np.partition(own, len(own) - k)[len(own) - k]
                new, own = new[good], own[good]
            found, scores = np.concatenate([found, new]), np.concatenate([scores, own])
            best = np.lexsort((found, -scores))[:k]
            found, scores = found[best], scores[best]
            depth = end
            if len(found) == k and left:
                last = np.where(falling, self.values[n - depth, used], self.values[depth - 1, used])
                if scores[-1] > int((last * weights).sum()):
                    break  # with an equal bound a smaller id could still be met
        return self.ids[found], scores, total - left


def exact_top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, dimensions: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id and score of the k best for every query row."""
    spark = vectors.sparkSession
    prepare(spark)
    if dimensions is None:
        sizes = vectors.where(F.col(vector_col).isNotNull()).groupBy(F.size(vector_col).alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
        dimensions = sizes[0]["d"] if sizes else 1
    usable = (F.size(vector_col) == dimensions) & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = vectors.where(F.col(id_col).isNotNull() & F.coalesce(usable, F.lit(False)))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), whole.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    counts = rows.agg(F.count("*"), F.count_if("asks")).first()
    block_rows = min(max(BLOCK_ROWS, -(-counts[0] // BLOCKS)), max(MOST_ROWS, BLOCK_ROWS))
    n_blocks, n_asking = (max(1, math.ceil(c / size)) for c, size in zip(counts, (block_rows, QUERY_ROWS), strict=True))
    cells = n_blocks * n_asking
    every = F.explode(F.sequence(F.lit(0), F.lit(n_asking - 1)))
    # Candidates go to their block's cell for each block of queries, queries to theirs for each block of candidates.
    candidates = rows.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).alias("block"), every.alias("asking"))
    candidates = candidates.select("id", "v", (F.col("block") * n_asking + F.col("asking")).cast("int").alias("cell"))
    asking = rows.where("asks").groupBy("id", "v").agg(F.count(F.lit(1)).alias("rows"))  # equal rows get equal answers
    asking = asking.select("id", "v", "rows", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_asking)).alias("asking"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    asking = asking.select("id", "v", "rows", (F.col("block") * n_asking + F.col("asking")).cast("int").alias("cell"))

    def matrix(table: pa.Table) -> np.ndarray:
        return table.column("v").combine_chunks().flatten().to_numpy().reshape(table.num_rows, dimensions)

    def answer(candidates: pa.Table, asking: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in ("query_id", "query", "rows", "vec_id", "score")}
        if candidates.num_rows and asking.num_rows:
            lists = SortedLists(candidates.column("id").to_numpy(), matrix(candidates))
            for i, n, q in zip(asking.column("id").to_pylist(), asking.column("rows").to_pylist(), matrix(asking), strict=True):
                found, own, _ = lists.top(i, q, k)
                name = int.from_bytes(hashlib.blake2b(q.tobytes(), digest_size=8).digest(), "big", signed=True)
                for column, values in zip(out, ([i] * len(found), [name] * len(found), [n] * len(found), found.tolist(), own.tolist()), strict=True):
                    out[column] += values
        return pa.table({name: pa.array(values, pa.int64()) for name, values in out.items()})

    spread = max(1, min(cells, 4096))
    left, right = (x.repartition(spread, "cell").groupBy("cell") for x in (candidates, asking))
    found = left.cogroup(right).applyInArrow(answer, "query_id long, query long, rows long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("rows")))).select("query_id", "rank", "vec_id", "score")
