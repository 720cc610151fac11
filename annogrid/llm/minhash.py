"""Near-duplicates by bottom-k sketches from one hash function.

A document's set is its distinct shingles of `width` words, each hashed to 64 bits; its sketch is the set's SKETCH
smallest hashes. Inverted lists of retained values (runs of RUN values that follow one another in a sketch; single
values for tiny sets) give overlaps, the sketch of the union estimates the similarity and filters, and the exact
Jaccard similarity of the full sets confirms. Components are the connected components of the confirmed links.

No group is expanded into rows of pairs. Documents with equal sets are one representative. Overlaps are sought twice:
first each member of a list meets the list's leader only, by way of the leader within its part; the pairs that the
estimate lets pass are joined into clusters; then the members of a list meet again, but only if they are of different
clusters. After that every pair that a list and the estimate offer lies within a cluster, so that exact verification
takes the clusters one by one: all intersections of a cluster's sets come from products of 0/1 matrices, and only links
that connect something new leave the task. Lists with more than LIST_BLOCK members and clusters with more than
CLUSTER_ROWS members or CLUSTER_ELEMENTS elements are dealt out in pairs of blocks.

What sketches may miss: a pair at the threshold shares no run of three retained values with probability 5e-10 (0.85) or
5e-8 (0.8), and its estimate falls six standard deviations short with probability 1e-7; more similar pairs, less.

Defined results: a null or empty text, or one without words, has an empty set, is linked with nothing and kept; a text
of fewer words than `width` has its whole sequence as the one element; rows that share an id are one document with the
links of all its texts; rows with a null id are linked with nothing, have a null component and are kept; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annogrid.llm.common import map_batches, prepare, stage, texts_of
from annogrid.llm.components import stars
from annogrid.llm.suffix_dedup import _BYTE, _by_bucket, _gathered, _mixed, _pack, _power_tables, _unpack

SKETCH, RUN, TINY = 48, 3, 8
#: Representatives in one part, members of a list compared in one task, bytes hashed at once.
PART_ROWS, LIST_BLOCK, BLOCK = 6000, 2048, 1 << 20
#: The same for members and elements of one block of a cluster, and for elements of one verifying task.
CLUSTER_ROWS, CLUSTER_ELEMENTS, TASK_ELEMENTS = 1024, 1 << 20, 1 << 21
#: Documents asked for, and those that hang on a smaller one, are broadcast up to this number of rows (about 64 MB); more are
#: joined by a shuffle.
BROADCAST_ROWS = 1_500_000
_NONE = np.uint64((1 << 64) - 1)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True
_ODD = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) % (1 << 64) | 1) for k in range(64)]


def _pieces(text: bytes) -> list[bytes]:
    """A long text cut at white space into pieces of about BLOCK bytes."""
    if len(text) <= BLOCK:
        return [text]
    out, at = [], 0
    gaps = np.flatnonzero(_GAP[np.frombuffer(text, np.uint8)])
    while at < len(text):
        k = int(np.searchsorted(gaps, at + BLOCK, "right")) - 1
        cut = int(gaps[k]) + 1 if k >= 0 and gaps[k] >= at else (int(gaps[k + 1]) + 1 if k + 1 < len(gaps) else len(text))
        cut = len(text) if len(text) - at <= BLOCK else cut
        out.append(text[at:cut])
        at = cut
    return out


def _word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """Hashes of the words of texts that together are about BLOCK bytes long."""
    flat = np.frombuffer((b" ".join(texts) + b" ").translate(_LOWER), np.uint8)
    up, down = _power_tables(1 << max(21, int(len(flat)).bit_length()))
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(_BYTE.take(flat) * up[: len(flat)], out=sums[1:])
    step = np.diff((~_GAP[flat]).astype(np.int8), prepend=0)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    words = _mixed((sums[end] - sums[start]) * down[start])
    border = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))
    return np.split(words, border[:-1])


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """For each text its distinct shingles' hashes in ascending order."""
    out: list[np.ndarray] = []
    k = 0
    while k < len(texts):
        if len(texts[k]) > BLOCK:
            words = [np.concatenate([_word_hashes([p])[0] for p in _pieces(texts[k])])]
            k += 1
        else:
            first, size = k, 0
            while k < len(texts) and size + len(texts[k]) <= BLOCK:
                size += len(texts[k])
                k += 1
            words = _word_hashes(texts[first:k])
        for w in words:
            if not len(w):
                out.append(np.zeros(0, np.uint64))
                continue
            n = min(width, len(w))
            total = np.full(len(w) - n + 1, np.uint64(n))
            for j in range(n):
                total += w[j : len(w) - n + 1 + j] * _ODD[j]
            out.append(np.unique(_mixed(total)))
    return out


def keys_of(sketches: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists a sketch is in: the row and the key of each entry. Unused places of a sketch hold the largest value."""
    runs = sketches[:, : SKETCH - RUN + 1] * _ODD[0]
    for j in range(1, RUN):
        runs = runs + sketches[:, j : SKETCH - RUN + 1 + j] * _ODD[j]
    row, _ = there = np.nonzero(sketches[:, RUN - 1 :] != _NONE)
    keys = _mixed(runs)[there]
    tiny = np.flatnonzero(n <= TINY)
    more_row, more_at = np.nonzero(sketches[tiny, :TINY] != _NONE)
    more = _mixed(sketches[tiny[more_row], more_at] ^ np.uint64(0x5851F42D4C957F2D))
    return np.concatenate([row, tiny[more_row]]), np.concatenate([keys, more])


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity by the sketch of the union: the share of its values that both sketches retain."""
    out = np.empty(len(a))
    for k in range(0, len(a), 20000):
        both = np.sort(np.concatenate([a[k : k + 20000], b[k : k + 20000]], axis=1), axis=1)
        new = np.ones(both.shape, bool)
        new[:, 1:] = both[:, 1:] != both[:, :-1]
        real = both != _NONE
        inside = (np.cumsum(new, axis=1) <= SKETCH) & real
        out[k : k + 20000] = (inside & ~new).sum(axis=1) / np.maximum((inside & new).sum(axis=1), 1)
    return out


def _near(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, least: float, t: float) -> np.ndarray:
    """Whether estimates come near the threshold t; they are exact for sets that their sketches hold whole."""
    whole = np.maximum(n_a, n_b) <= SKETCH // 2
    return estimates(a, b) >= np.where(whole, t - 1e-9, least)


def _entries(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets) if sets else np.zeros(0, np.uint64)


def shared_counts(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], rows: int, columns: int) -> np.ndarray:
    """How many elements each left set shares with each right set; sets come as (number of the set, element) entries."""
    out = np.zeros((rows, columns), np.float32)
    common = np.intersect1d(left[1], right[1])
    if not len(common):
        return out
    sides = []
    for number, element in (left, right):
        at = np.minimum(np.searchsorted(common, element), len(common) - 1)
        hit = common[at] == element
        order = np.argsort(at[hit], kind="stable")
        sides.append((number[hit][order], at[hit][order]))
    step = 2048
    for begin in range(0, len(common), step):
        width = min(step, len(common) - begin)
        parts = []
        for (number, at), n in zip(sides, (rows, columns), strict=True):
            low, high = np.searchsorted(at, [begin, begin + width])
            part = np.zeros((n, width), np.float32)
            part[number[low:high], at[low:high] - begin] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def spanning(adjacent: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[list[int], list[int]]:
    """Links (by id) that connect what a 0/1 table of left and right ids connects, each connecting something new."""
    ids, where = np.unique(np.concatenate([left, right]), return_inverse=True)
    at_left, at_right = where[: len(left)], where[len(left) :]
    label = np.arange(len(ids))
    a, b = [], []
    for i in np.flatnonzero(adjacent.any(axis=1)).tolist():
        near = at_right[adjacent[i]]
        _, first = np.unique(label[near], return_index=True)
        for j in near[first].tolist():
            old, new = label[j], label[at_left[i]]
            if old != new:
                label[label == old] = new
                a.append(int(ids[at_left[i]]))
                b.append(int(ids[j]))
    return a, b


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint64).reshape(len(rows), SKETCH)


def _lists(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries in the order of their keys (then rows), and each entry's list number."""
    order = np.lexsort((row, key))
    key = key[order]
    return order, np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) - 1 if len(key) else np.zeros(0, np.int64)


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, high = np.minimum(a, b), np.maximum(a, b)
    keep = low != high
    low, high = low[keep], high[keep]
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    return low[new], high[new]


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.Table:
    a, b = _distinct_pairs(a, b)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def sketch(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, digest of the set (16 bytes) and sketch for each row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(texts_of(batch.column(1)), width)
        kept = np.full((len(sets), SKETCH), _NONE)
        for k, s in enumerate(sets):
            kept[k, : min(SKETCH, len(s))] = s[:SKETCH]
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        sizes = pa.array([len(s) for s in sets], pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), sizes, pa.array(digests, pa.binary()), pa.array([r.tobytes() for r in kept], pa.binary())], ["doc_id", "n_shingles", "digest", "sketch"]
        )

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col), run, "doc_id long, n_shingles long, digest binary, sketch binary")


def _leader_pairs(reps: DataFrame, buckets: int) -> DataFrame:
    """Each member of a list with the smallest member of it in its part, and those with the smallest of all."""

    def send(table: pa.Table) -> pa.Table:
        ids = table.column("rep").to_numpy()
        row, key = keys_of(_matrix(table.column("sketch")), table.column("n").to_numpy())
        order, number = _lists(ids[row], key)
        row, key = row[order], key[order]
        head = np.concatenate([[True], number[1:] != number[:-1]]) if len(number) else np.zeros(0, bool)
        leader = row[head][number] if len(number) else row
        a, b = _distinct_pairs(ids[leader], ids[row])
        part = table.column("part")[0].as_py()
        by_id = np.argsort(ids[row[head]], kind="stable")
        sent = _by_bucket(part, buckets, key[head][by_id], key[head][by_id], ids[row[head]][by_id])
        rows = {b: blob for b, _, blob in sent}
        rows.setdefault(part % buckets, None)
        inner = {part % buckets: _pack(a, b)}
        return pa.table(
            {"bucket": pa.array(list(rows), pa.int32()), "lists": pa.array(list(rows.values()), pa.binary()), "pairs": pa.array([inner.get(b) for b in rows], pa.binary())}
        )

    def meet(table: pa.Table) -> pa.Table:
        lists = [_unpack(x, "ui") for x in table.column("lists").to_pylist() if x is not None]
        pairs = [_unpack(x, "ii") for x in table.column("pairs").to_pylist() if x is not None]
        a, b = [p[0] for p in pairs], [p[1] for p in pairs]
        if lists:
            key, ids = (np.concatenate(c) for c in zip(*lists, strict=True))
            order, number = _lists(ids, key)
            ids = ids[order]
            head = np.concatenate([[True], number[1:] != number[:-1]])
            a.append(ids[head][number])
            b.append(ids)
        return _pairs(np.concatenate(a), np.concatenate(b))

    sent = reps.groupBy("part").applyInArrow(send, "bucket int, lists binary, pairs binary")
    return sent.groupBy("bucket").applyInArrow(meet, "a long, b long").distinct()


def _estimated(pairs: DataFrame, reps: DataFrame, least: float, num: int, den: int) -> DataFrame:
    """Pairs whose sizes allow the threshold and whose union's sketch comes near it."""
    side = reps.select("rep", "n", "sketch")
    both = pairs.join(side.toDF("a", "n_a", "s_a"), "a").where(F.col("n_a") > 0).join(side.toDF("b", "n_b", "s_b"), "b")
    both = both.where(F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = [batch.column(x).to_numpy() for x in ("n_a", "n_b")]
        good = _near(_matrix(batch.column("s_a")), _matrix(batch.column("s_b")), *n, least, num / den)
        return batch.select(["a", "b"]).filter(pa.array(good))

    return map_batches(both.select("a", "b", "n_a", "n_b", "s_a", "s_b"), run, "a long, b long")


def _across_pairs(reps: DataFrame, buckets: int, least: float, num: int, den: int) -> DataFrame:
    """Pairs of a list's members that are of different clusters and whose estimate comes near the threshold."""

    def entries(table: pa.Table):
        ids, n, comp, values = (table.column(x).to_numpy() for x in ("rep", "n", "comp", "n"))
        values = _matrix(table.column("sketch"))
        row, key = keys_of(values, n)
        return ids, n, comp, values, row, key

    def describe(table: pa.Table) -> pa.Table:
        """For each list: its smallest and largest cluster in this part and its number of members."""
        _, _, comp, _, row, key = entries(table)
        order, number = _lists(comp[row], key)
        key, comp = key[order], comp[row][order]
        head = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(key) else np.zeros(0, np.int64)
        tail = np.concatenate([head[1:], [len(key)]]) - 1 if len(key) else head
        part = table.column("part")[0].as_py()
        rows = _by_bucket(part, buckets, key[head], key[head], comp[head], comp[tail], tail - head + 1)
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "part": pa.array([r[1] for r in rows], pa.int32()), "blob": pa.array([r[2] for r in rows], pa.binary())})

    def decide(table: pa.Table) -> pa.Table:
        """Tell each part which of its lists hold several clusters, and in how many blocks they are dealt."""
        (key, low, high, count), part = _gathered(table, "uiii")
        order = np.argsort(key, kind="stable")
        key, low, high, count, part = (x[order] for x in (key, low, high, count, part))
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        number = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) - 1
        several = (np.minimum.reduceat(low, head) < np.maximum.reduceat(high, head))[number]
        blocks = (-(-np.add.reduceat(count, head) // LIST_BLOCK))[number]
        key, blocks, part = key[several], blocks[several], part[several]
        rows = [(p, _pack(key[part == p], blocks[part == p])) for p in np.unique(part).tolist()]
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "blob": pa.array([r[1] for r in rows], pa.binary())})

    def deal(table: pa.Table, answers: pa.Table) -> pa.Table:
        out = {k: [] for k in ("cell", "side", "rep", "n", "comp", "sketch")}
        if table.num_rows and answers.num_rows:
            told = [_unpack(x, "ui") for x in answers.column("blob").to_pylist()]
            wanted, blocks = (np.concatenate(c) for c in zip(*told, strict=True))
            order = np.argsort(wanted)
            wanted, blocks = wanted[order], blocks[order]
            ids, n, comp, values, row, key = entries(table)
            at = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
            hit = wanted[at] == key
            for r, k, nb in zip(row[hit].tolist(), key[hit], blocks[at[hit]].tolist(), strict=True):
                own = int(_mixed(np.array([ids[r]], np.int64).view(np.uint64))[0]) % nb if nb > 1 else 0
                for other in range(nb):
                    i, j = min(own, other), max(own, other)
                    cell = hashlib.blake2b(k.tobytes() + bytes(f"{i},{j}", "ascii"), digest_size=8).digest()
                    out["cell"].append(int.from_bytes(cell, "little", signed=True))
                    out["side"].append(int(own != i))
                    out["rep"].append(int(ids[r]))
                    out["n"].append(int(n[r]))
                    out["comp"].append(int(comp[r]))
                    out["sketch"].append(values[r].tobytes())
        types = {"cell": pa.int64(), "side": pa.int32(), "rep": pa.int64(), "n": pa.int64(), "comp": pa.int64(), "sketch": pa.binary()}
        return pa.table({k: pa.array(v, types[k]) for k, v in out.items()})

    def compare(table: pa.Table) -> pa.Table:
        found_a, found_b = [], []
        cell, side, ids, n, comp = (table.column(x).to_numpy() for x in ("cell", "side", "rep", "n", "comp"))
        values = _matrix(table.column("sketch"))
        order = np.argsort(cell, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], cell[order][1:] != cell[order][:-1], [True]]))
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own = order[low:high]
            left, right = own[side[own] == 0], own[side[own] == 1]
            if not len(right):
                right = left
            entries = [np.nonzero(values[x] != _NONE) for x in (left, right)]
            shared = shared_counts(*((e[0], values[x][e]) for e, x in zip(entries, (left, right), strict=True)), len(left), len(right))
            big = np.maximum(n[left][:, None], n[right])
            good = shared >= least * np.minimum(big, SKETCH) - 1e-6  # what the estimate can reach at best
            good &= (comp[left][:, None] != comp[right]) & (np.minimum(n[left][:, None], n[right]) * den >= big * num)
            i, j = np.nonzero(good)
            i, j = left[i], right[j]
            near = _near(values[i], values[j], n[i], n[j], least, num / den)
            # One pair for each pair of clusters is enough to join them.
            i, j = i[near], j[near]
            _, first = np.unique(np.stack([np.minimum(comp[i], comp[j]), np.maximum(comp[i], comp[j])]), axis=1, return_index=True)
            found_a.append(ids[i[first]])
            found_b.append(ids[j[first]])
        none = [np.zeros(0, np.int64)]
        return _pairs(np.concatenate(found_a or none), np.concatenate(found_b or none))

    by_part = reps.groupBy("part")
    told = by_part.applyInArrow(describe, "bucket int, part int, blob binary").groupBy("bucket").applyInArrow(decide, "part int, blob binary")
    dealt = by_part.cogroup(told.groupBy("part")).applyInArrow(deal, "cell long, side int, rep long, n long, comp long, sketch binary")
    grouped = dealt.withColumn("bucket", F.pmod("cell", F.lit(buckets * 4)))
    return grouped.groupBy("bucket").applyInArrow(compare, "a long, b long")


def _confirmed(docs: DataFrame, clusters: DataFrame, width: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """Links between members of a cluster (rep, n, comp) whose full sets reach the threshold, as many as connect what they connect."""
    spark = docs.sparkSession
    sizes = clusters.groupBy("comp").agg(F.count("*").alias("members"), F.sum("n").alias("elements")).where(F.col("members") > 1)
    blocks = F.greatest(F.ceil(F.col("members") / CLUSTER_ROWS), F.ceil(F.col("elements") / CLUSTER_ELEMENTS)).cast("int")
    members = clusters.join(sizes.select("comp", blocks.alias("blocks")), "comp").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = members.select("rep", "n", "comp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    asked = stage(dealt.select(F.col("rep").alias("_id"), "n", F.xxhash64("comp", low, high).alias("cell"), (F.col("own") > F.col("other")).cast("int").alias("side")))
    number, elements = asked.agg(F.count("*"), F.sum("n")).first()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((elements or 0) / TASK_ELEMENTS))
    asked = asked.select("_id", "cell", "side")
    if number <= BROADCAST_ROWS:
        asked = F.broadcast(asked)
    sent = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).join(asked, "_id").select("_id", "cell", "side", "_text")

    def send(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(texts_of(batch.column(3)), width)
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([s.tobytes() for s in sets], pa.binary())], ["_id", "cell", "side", "elements"])

    def verify(table: pa.Table) -> pa.Table:
        a, b = [], []
        ids, cell, side = (table.column(x).to_numpy() for x in ("_id", "cell", "side"))
        blobs = table.column("elements").to_pylist()
        order = np.lexsort((ids, cell))
        edges = np.flatnonzero(np.concatenate([[True], cell[order][1:] != cell[order][:-1], [True]]))
        for first, last in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            rows = order[first:last]
            left, right = rows[side[rows] == 0], rows[side[rows] == 1]
            right = right if len(right) else left
            sets = [[np.frombuffer(blobs[k], np.uint64) for k in x] for x in (left, right)]
            n = [np.array([len(s) for s in x], np.float64) for x in sets]
            inter = shared_counts(*map(_entries, sets), len(left), len(right)).astype(np.float64)
            near = (den * inter >= num * (n[0][:, None] + n[1] - inter)) & (inter > 0) & (ids[left][:, None] != ids[right])
            more = spanning(near, ids[left], ids[right])
            a += more[0]
            b += more[1]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    sets = map_batches(sent, send, "_id long, cell long, side int, elements binary")
    return sets.withColumn("bucket", F.pmod("cell", F.lit(buckets))).groupBy("bucket").applyInArrow(verify, "a long, b long")


def _few(rows: DataFrame, number: int) -> DataFrame:
    """Rows to be broadcast, unless they are too many."""
    return F.broadcast(rows) if number <= BROADCAST_ROWS else rows


def _placed(reps: DataFrame, hung: DataFrame, number: int) -> DataFrame:
    """The representatives with comp, their cluster's smallest member (themselves if they are alone)."""
    found = _few(hung.select(F.col("u").alias("rep"), F.col("v").alias("comp")), number)
    return reps.join(found, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))


def _linked(docs: DataFrame, width: int, num: int, den: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int]:
    """doc_id and n_shingles of each row; the ids that reach a smaller one (u) with the smallest (v), and their number."""
    spark = docs.sparkSession
    prepare(spark)
    t = num / den
    least = max(0.0, t - 6 * math.sqrt(t * (1 - t) / SKETCH))
    rows = stage(sketch(docs, width, id_col, text_col))
    real = rows.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    equal = real.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    reps = stage(equal)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(reps.count() / PART_ROWS))
    reps = reps.withColumn("part", F.pmod(F.xxhash64("rep"), F.lit(parts)).cast("int"))
    buckets = max(1, parts // 2)
    hung, number = stars(_estimated(_leader_pairs(reps, buckets), reps, least, num, den))
    placed = _placed(reps, hung, number)
    placed = placed if number <= BROADCAST_ROWS else stage(placed)  # read twice: a broadcast is cheap, a shuffle is not
    more = _across_pairs(placed, buckets, least, num, den)
    placed = _placed(reps, *stars(hung.toDF("a", "b").unionByName(more))).select("rep", "n", "comp")
    links = _confirmed(docs, placed, width, num, den, id_col, text_col)
    copies = real.join(reps.select("digest", "rep"), "digest").where(F.col("doc_id") != F.col("rep")).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    return rows.select("doc_id", "n_shingles"), *stars(links.unionByName(copies))


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row its id, n_shingles, component_id and kept; documents are linked if den * intersection >= num * union."""
    rows, hung, number = _linked(docs, width, num, den, id_col, text_col)
    found = _few(hung.select(F.col("u").alias("doc_id"), F.col("v").alias("component")), number)
    out = rows.join(found, "doc_id", "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select(
        F.col("doc_id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def without_near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that near_duplicates() keeps, with all their columns; they are not moved where the ids to drop can be broadcast."""
    _, hung, number = _linked(docs, width, num, den, id_col, text_col)
    gone = _few(hung.select(F.col("u").alias("_gone")), number)
    return docs.join(gone, F.col(id_col).cast("long") == F.col("_gone"), "left_anti")


def brute_force(docs: list[tuple], width: int, num: int, den: int) -> list[tuple]:
    """The contract's rows by comparing all pairs of texts; for tests, with distinct ids."""
    import re

    sets = []
    for _, text in docs:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(_LOWER))
        n = min(width, len(words))
        sets.append({tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set())
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and docs[i][0] is not None and docs[j][0] is not None and den * inter >= num * len(sets[i] | sets[j]) and inter:
                parent[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return [(d, len(s), least[root(i)] if d is not None else None, d is None or least[root(i)] == d) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))]
