"""Bloom filter parameters, bit positions and state."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parameters(n: Column, p: Column) -> dict[str, Column]:
    """Bits, hashes and bytes of a filter for n items at false-positive rate p."""
    m = F.ceil(-(n * F.log(p)) / (math.log(2) ** 2)).cast("long")
    k = F.greatest(F.lit(1), (m / n * math.log(2)).cast("int"))
    return {"m": m, "k": k, "memory_bytes": F.ceil(m / 8).cast("long")}


def size_for(capacity: int, fp_rate: float) -> tuple[int, int]:
    if capacity <= 0 or not 0 < fp_rate < 1:
        raise ValueError("capacity is positive and the rate lies between 0 and 1")
    m = math.ceil(-capacity * math.log(fp_rate) / math.log(2) ** 2)
    return m, max(1, int(m / capacity * math.log(2)))


def murmur3_32(data: bytes, seed: int = 0) -> int:
    """The signed 32-bit MurmurHash3."""
    h, mask = seed & 0xFFFFFFFF, 0xFFFFFFFF

    def scrambled(k: int) -> int:
        k = k * 0xCC9E2D51 & mask
        return ((k << 15 | k >> 17) & mask) * 0x1B873593 & mask

    whole = len(data) // 4 * 4
    for i in range(0, whole, 4):
        h ^= scrambled(int.from_bytes(data[i : i + 4], "little"))
        h = ((h << 13 | h >> 19) & mask) * 5 + 0xE6546B64 & mask
    if tail := data[whole:]:
        h ^= scrambled(int.from_bytes(tail, "little"))
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * factor & mask
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def murmur3_32_of(texts: pa.Array, seed: int = 0) -> np.ndarray:
    """murmur3_32 of every text of an Arrow array of binaries, one word of all texts at a time."""
    flat = np.frombuffer(b"".join(texts.to_pylist()) + b"\0" * 4, np.uint8).astype(np.uint32)
    sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
    starts, whole = np.cumsum(sizes) - sizes, sizes // 4
    h = np.full(len(sizes), seed & 0xFFFFFFFF, np.uint32)

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return x << np.uint32(by) | x >> np.uint32(32 - by)

    def scrambled(k: np.ndarray) -> np.ndarray:
        return turned(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)

    live = np.arange(len(sizes))
    for i in range(int(whole.max(initial=0))):
        live = live[whole[live] > i]
        at = starts[live] + 4 * i
        word = flat[at] | flat[at + 1] << np.uint32(8) | flat[at + 2] << np.uint32(16) | flat[at + 3] << np.uint32(24)
        h[live] = turned(h[live] ^ scrambled(word), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    rest, at = sizes % 4, starts + 4 * whole
    tail = np.zeros(len(sizes), np.uint32)
    for k in range(3):
        more = rest > k
        tail[more] |= flat[at[more] + k] << np.uint32(8 * k)
    h ^= np.where(rest > 0, scrambled(tail), np.uint32(0)) ^ sizes.astype(np.uint32)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> np.uint32(shift)) * np.uint32(factor)
    return (h ^ h >> np.uint32(16)).view(np.int32).astype(np.int64)


def _bytes_of(values: pa.Array) -> pa.Array:
    """The texts of values as Python writes them, as binaries."""
    if pa.types.is_integer(values.type) or pa.types.is_string(values.type):
        return values.cast(pa.string()).fill_null("None").cast(pa.binary())
    return pa.array([str(v).encode() for v in values.to_pylist()], pa.binary())


def positions(items: DataFrame, column: str, m: int, k: int) -> DataFrame:
    """(item, position): k bit positions of each item by double hashing."""

    def run(batches):
        for batch in batches:
            texts = _bytes_of(batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(murmur3_32_of(texts, s)) for s in (0, 1))], ["item", "h1", "h2"])

    hashed = items.select(column).mapInArrow(run, f"item {dict(items.dtypes)[column]}, h1 long, h2 long")
    return hashed.select("item", F.explode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.pmod(F.col("h1") + i * F.col("h2"), F.lit(m)))).alias("position"))


def statistics(items: DataFrame, column: str, capacity: int, fp_rate: float = 0.001) -> DataFrame:
    """Bits set, fill ratio and the false-positive rate that follows from it."""
    m, k = size_for(capacity, fp_rate)
    bits = positions(items, column, m, k).agg(F.count_distinct("position").alias("bits_set"))
    fill = F.col("bits_set") / m
    return bits.select("bits_set", F.lit(m).cast("long").alias("m"), F.lit(k).alias("k"), F.round(fill, 6).alias("fill_ratio"), F.round(F.pow(fill, F.lit(k)), 9).alias("estimated_fp"), (fill > 0.7).alias("should_resize"))


def might_contain(state: DataFrame, probes: DataFrame, column: str, m: int, k: int) -> DataFrame:
    """(item, might_exist) against the distinct positions of a filter."""
    asked = positions(probes, column, m, k)
    hit = asked.join(state.select("position").distinct().withColumn("set", F.lit(1)), "position", "left")
    return hit.groupBy("item").agg((F.count_if(F.col("set").isNull()) == 0).alias("might_exist"))


def exported(items: DataFrame, column: str, capacity: int, fp_rate: float = 0.001) -> DataFrame:
    """A filter's whole state: one row with capacity, fp_rate, m, k and n_items, joined to its set positions, a row for each."""
    m, k = size_for(capacity, fp_rate)
    n = items.agg(F.count(F.lit(1)).alias("n_items"))
    state = F.broadcast(n).select(F.lit(capacity).cast("long").alias("capacity"), F.lit(fp_rate).alias("fp_rate"), F.lit(m).cast("long").alias("m"), F.lit(k).alias("k"), "n_items")
    return positions(items, column, m, k).select("position").distinct().crossJoin(F.broadcast(state))


def imported(state: DataFrame) -> tuple[DataFrame, int, int]:
    """Positions, m and k of an exported state (also one that was written and read); raises if rows of two filters are mixed."""
    kinds = state.select("capacity", "fp_rate", "m", "k").distinct().limit(2).collect()
    if len(kinds) != 1:
        raise ValueError("a state has rows of one filter")
    if size_for(kinds[0]["capacity"], kinds[0]["fp_rate"]) != (kinds[0]["m"], kinds[0]["k"]):
        raise ValueError("size and number of hashes don't fit the capacity")
    return state.select("position"), kinds[0]["m"], kinds[0]["k"]


def with_more(state: DataFrame, items: DataFrame, column: str) -> DataFrame:
    """An exported state after more items were added."""
    first = state.select("capacity", "fp_rate", "m", "k", "n_items").first()
    more = exported(items, column, first["capacity"], first["fp_rate"]).withColumn("n_items", F.col("n_items") + first["n_items"])
    before = state.withColumn("n_items", F.lit(first["n_items"]) + F.lit(items.count()))
    return before.unionByName(more.select(*state.columns)).distinct()
