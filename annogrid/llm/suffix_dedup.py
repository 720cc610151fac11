"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

A byte is removed if a string of `depth` bytes covers it that also starts earlier (smaller document id, or the same
document and an earlier start). Suffixes are compared through their first `depth` bytes only, in most-significant-digit
passes; after each pass only the suffixes whose group still has company go on, and the groups of the last pass are
exactly the repeated windows.

Digits are fingerprints, so that a pass can deal suffixes out by hash instead of by order:

1. The first digit of a suffix is the smallest hashed gram in its window. Equal windows have it at the same place, and
   consecutive suffixes share it, so that a whole run of suffixes is sorted by one entry.
2. The second digit is the window of the run's first and last suffix, that is all bytes the run can see. Runs that
   agree in it agree in every suffix: all but the first are repeats.
3. Suffixes in runs that share digit 1 but differ in digit 2 are sorted one by one by the hash of their whole window.

A run is dealt out by its first digit where its part has one second digit for it. Where the part has several, the first
digit is known to need pass 3: the part says so in one entry, and its runs are dealt out by both digits. So a bucket gets at
most one entry from each part for any string or gram, however often it occurs and in whatever surroundings (a line that all
documents share has one gram and a second digit in each document).

Equality rests on both digits, 64 bits of the whole view (or window) and about 58 of the gram: among n entries the chance
that any two different ones agree is below n * n / 2 ** 122, 2e-12 for the 3e12 runs of 100 TB. Bytes aren't compared again.

Defined results: a null text is empty; texts shorter than `depth` lose nothing; documents with the same id (those without
one come first) are spread over the parts too, and are taken in the order of the parts (by a hash of id and text), then of
their bytes; a repeated row comes after its copy; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annogrid.llm.common import prepare

#: Bytes of text that one worker holds at once (more if one text is longer), and window starts hashed at once.
PART_BYTES, BLOCK = 8 << 20, 1 << 16
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = base & (1 << 64) - 1
    return np.cumprod(out, dtype=np.uint64)


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _tables:
        _tables.clear()
        _tables[n] = _powers(_MULTIPLIER, n), _powers(pow(_MULTIPLIER, -1, 1 << 64), n)
    return _tables[n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


class Part:
    """The texts of one part in the order of (id, bytes), as one byte array."""

    def __init__(self, table: pa.Table, depth: int):
        ids, texts = table.column(0).to_pylist(), table.column(1).to_pylist()
        rows = sorted(((-(1 << 63) if i is None else i, t or b"", i is None) for i, t in zip(ids, texts, strict=True)), key=lambda r: (not r[2], r[0], r[1]))
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.null = [r[2] for r in rows]
        self.texts = [r[1] for r in rows]
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(self.texts), np.uint8)
        self.depth = depth
        self.valid = np.ones(len(self.flat), bool)
        for end, n in zip((self.start + self.size).tolist(), self.size.tolist(), strict=True):
            self.valid[end - min(n, depth - 1) : end] = False

    def owner(self, positions: np.ndarray) -> np.ndarray:
        """The ids of the documents at these positions."""
        last = np.searchsorted(self.start, positions, "right") - 1
        return self.ids[last]

    def _sums(self, begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        up, down = _power_tables(BLOCK + 2 * self.depth)
        x = _BYTE.take(self.flat[begin:end])
        x *= up[: len(x)]
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x, out=sums[1:])
        return sums, up, down

    def runs(self) -> dict[str, np.ndarray]:
        """Runs of window starts with the same smallest gram: start, n, first digit (gram) and second digit (whole)."""
        depth = self.depth
        gram = max(1, depth * 2 // 5)
        width = depth - gram + 1
        bits = max(1, math.ceil(math.log2(width)))
        low = np.uint64((1 << bits) - 1)
        found: dict[str, list] = {k: [] for k in ("start", "last", "at", "gram", "first", "final")}
        for begin in range(0, len(self.flat), BLOCK):
            sums, _, down = self._sums(begin, min(len(self.flat), begin + BLOCK + depth))
            m = len(sums) - gram
            if m < width:
                break
            best = (sums[gram:] - sums[:m]) * down[:m]
            best = _mixed(best)
            best &= ~low
            step = 1
            while step * 2 <= width:
                best = np.minimum(best[:-step], best[step:] + np.uint64(step))
                step *= 2
            if width > step:
                best = np.minimum(best[: len(best) - (width - step)], best[width - step :] + np.uint64(width - step))
            best = best[:BLOCK]
            at = np.arange(len(best)) + (best & low).astype(np.int64)
            at[~self.valid[begin : begin + len(best)]] = -1
            border = np.flatnonzero(at[1:] != at[:-1])
            start, last = np.concatenate([[0], border + 1]), np.concatenate([border, [len(at) - 1]])
            there = at[start] >= 0
            start, last = start[there], last[there]
            found["start"].append(start + begin)
            found["last"].append(last + begin)
            found["at"].append(at[start] + begin)
            found["gram"].append(best[start] >> np.uint64(bits))
            for name, p in (("first", start), ("final", last)):
                found[name].append((sums[p + depth] - sums[p]) * down[p])
        if not found["start"]:
            return {k: np.zeros(0, np.uint64) for k in ("gram", "whole")} | {k: np.zeros(0, np.int64) for k in ("start", "n")}
        r = {k: np.concatenate(v) for k, v in found.items()}
        goes_on = np.zeros(len(r["start"]), bool)  # a run that a block's border cut
        goes_on[1:] = (r["at"][1:] == r["at"][:-1]) & (r["start"][1:] == r["last"][:-1] + 1)
        head = np.flatnonzero(~goes_on)
        tail = np.concatenate([head[1:], [len(goes_on)]]) - 1
        start, n = r["start"][head], r["last"][tail] - r["start"][head] + 1
        whole = _mixed(r["first"][head]) * np.uint64(0xA24BAED4963EE407) + _mixed(r["final"][tail]) * np.uint64(0x9FB21C651E98DF25)
        whole += n.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + (r["at"][head] - start).astype(np.uint64) * np.uint64(0x165667B19E3779F9)
        return {"start": start, "n": n, "gram": r["gram"][head], "whole": _mixed(whole)}

    def window_hashes(self, positions: np.ndarray) -> np.ndarray:
        """Hashes of the windows at sorted positions."""
        out = np.empty(len(positions), np.uint64)
        blocks = positions // BLOCK
        for b in np.unique(blocks).tolist():
            low, high = np.searchsorted(blocks, [b, b + 1])
            begin = b * BLOCK
            sums, _, down = self._sums(begin, min(len(self.flat), begin + BLOCK + self.depth))
            p = positions[low:high] - begin
            out[low:high] = (sums[p + self.depth] - sums[p]) * down[p]
        return _mixed(out)


def _first_of_group(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by keys (most significant first, ties by place) and where a new group of equal keys begins in it."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for k in keys:
            sorted_k = k[order]
            new[1:] |= sorted_k[1:] != sorted_k[:-1]
    return order, new


def _thin(x: np.ndarray) -> bytes:
    """Slowly growing numbers as differences, bytes of the same weight together."""
    return np.diff(x.astype(np.int64), prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of 8 bytes; signed ones are packed as differences."""
    raw = b"".join(x.tobytes() if x.dtype == np.uint64 else _thin(x) for x in columns)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(blob: bytes, kinds: str) -> list[np.ndarray]:
    """kinds: u for a column of hashes, i for one of numbers."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(len(kinds), -1)
    out = []
    for kind, column in zip(kinds, raw, strict=True):
        if kind == "u":
            out.append(column.view(np.uint64))
        else:
            out.append(np.cumsum(np.ascontiguousarray(column.reshape(8, -1).T).view(np.int64).ravel()))
    return out


def _by_bucket(part: int, buckets: int, key: np.ndarray, *columns: np.ndarray) -> list[tuple[int, int, bytes]]:
    bucket = (key % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    out = []
    for b in np.flatnonzero(np.diff(edges)).tolist():
        pick = order[edges[b] : edges[b + 1]]
        out.append((b, part, _pack(*(c[pick] for c in columns))))
    return out


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    types = {"bucket": pa.int32(), "part": pa.int32(), "kind": pa.int32(), "blob": pa.binary()}
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.table([pa.array(c, types[n]) for c, n in zip(columns, names, strict=True)], names=names)


def _first_runs(runs: dict[str, np.ndarray]) -> np.ndarray:
    """Indices of the runs that are the first of their kind in the part."""
    order, new = _first_of_group(runs["gram"], runs["whole"])
    return np.sort(order[new])


def _gathered(table: pa.Table, kinds: str) -> tuple[list[np.ndarray], np.ndarray]:
    """All entries of a bucket, and the part that sent each."""
    parts = table.column("part").to_pylist()
    blobs = [_unpack(b, kinds) for b in table.column("blob").to_pylist()]
    return [np.concatenate(c) for c in zip(*blobs, strict=True)], np.repeat(np.array(parts, np.int64), [len(b[0]) for b in blobs])


def _answers(kind: int, part: np.ndarray, *columns: np.ndarray) -> list[tuple[int, int, bytes]]:
    order = np.lexsort((columns[0], part))
    part = part[order]
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(1, np.int64)
    return [(int(part[a]), kind, _pack(*(c[order[a:b]] for c in columns))) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def _known(part: Part, answers: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The part's runs and what is known of each: 0 alone, 1 repeated as a whole, 2 to be sorted further."""
    runs = part.runs()
    state = np.ones(len(runs["start"]), np.int64)
    first = _first_runs(runs)
    state[first] = np.where(_alone(runs["gram"][first]), 0, 2)
    for kind, blob in zip(answers.column("kind").to_pylist(), answers.column("blob").to_pylist(), strict=True):
        if kind == 1:
            index, code = _unpack(blob, "ii")
            state[index] = code
    return runs, state


def _alone(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs once."""
    order, new = _first_of_group(keys)
    edge = np.append(new, True)
    out = np.empty(len(keys), bool)
    out[order] = edge[:-1] & edge[1:]
    return out


def _spread(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of runs and the run that each is of."""
    run = np.repeat(np.arange(len(n)), n)
    return np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n), run


def _single(part: Part, runs: dict[str, np.ndarray], state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes to be sorted one by one: positions, first digits, window hashes, and whether each is the part's first of its kind."""
    pick = np.flatnonzero(state == 2)
    positions, run = _spread(runs["start"][pick], runs["n"][pick])
    gram, window = runs["gram"][pick][run], part.window_hashes(positions)
    order, new = _first_of_group(window, gram)
    first = np.zeros(len(positions), bool)
    first[order[new]] = True
    return positions, gram, window, first


def _covered(size: int, spans: list[tuple[np.ndarray, np.ndarray | int]]) -> np.ndarray:
    """Which of so many bytes lie in any span; spans: starts and lengths. Changes are summed in place: in an array of its own the
    sum took twenty bytes a byte, the most that a worker held, in place of five."""
    level = np.zeros(size + 1, np.int32)
    for starts, n in spans:
        np.add.at(level, starts, 1)
        np.add.at(level, starts + n, -1)
    np.cumsum(level, dtype=np.int32, out=level)
    return level[:-1] > 0


def part_of_row(doc_id: Column, text: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(doc_id.cast("long"), text), F.lit(parts)).cast("int")


def repeats(docs: DataFrame, depth: int = 100, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = False) -> DataFrame:
    """For each row its id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256.

    with_spans: also spans (array of struct start, end: bytes removed) and kept (binary, the bytes that are left).
    """
    if depth < 2:
        raise ValueError("depth is at least 2")
    spark = docs.sparkSession
    prepare(spark)
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / PART_BYTES))
    buckets, tasks = max(1, parts // 2), max(1, parts // 2)
    text = F.col(text_col).cast("binary")
    base = docs.select(part_of_row(F.col(id_col), text, parts).alias("part"), F.col(id_col).cast("long").alias("id"), text.alias("text")).repartition(tasks, "part")

    def part_of(table: pa.Table) -> tuple[int, Part]:
        return table.column("part")[0].as_py(), Part(table.select(["id", "text"]), depth)

    def send_runs(table: pa.Table) -> pa.Table:
        number, part = part_of(table)
        runs = part.runs()
        pick = _first_runs(runs)
        gram, whole, owner = runs["gram"][pick], runs["whole"][pick], part.owner(runs["start"][pick])
        one = _alone(gram)
        several = np.unique(gram[~one])
        zeros = np.zeros(len(several), np.int64)
        by_gram = [np.concatenate(x) for x in ((gram[one], several), (whole[one], zeros.view(np.uint64)), (owner[one], zeros), (pick[one], zeros))]
        rows = _by_bucket(number, buckets, by_gram[0], *by_gram)
        gram, whole, owner, pick = (x[~one] for x in (gram, whole, owner, pick))
        rows += [(buckets + b, *rest) for b, *rest in _by_bucket(number, buckets, _mixed(gram ^ whole), gram, whole, owner, pick)]
        return _table(rows, ["bucket", "part", "blob"])

    def sort_runs(table: pa.Table) -> pa.Table:
        """Entries of several parts with one gram: later copies of a run are repeats, and what is left is sorted further if a
        gram has several second digits (0 stands for a part that has several itself)."""
        (gram, whole, owner, index), part = _gathered(table, "uuii")
        by_gram = table.column("bucket")[0].as_py() < buckets
        pick = np.flatnonzero(~_alone(gram))
        order = pick[np.lexsort(tuple(x[pick] for x in (index, part, owner, whole, gram)))]
        gram, whole, index, part = (x[order] for x in (gram, whole, index, part))
        code = np.ones(len(gram), np.int64)
        if len(gram):
            new = np.concatenate([[True], gram[1:] != gram[:-1]])
            head = new.copy()
            head[1:] |= whole[1:] != whole[:-1]
            group = np.cumsum(new) - 1
            several = (np.bincount(group[head]) > 1) | (whole[new] == 0)
            code[head] = np.where(several[group[head]] & by_gram, 2, 0)
        told = (code > 0) & (whole != 0)
        return _table(_answers(1, part[told], index[told], code[told]), ["part", "kind", "blob"])

    def send_suffixes(table: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["bucket", "part", "blob"]
        if not table.num_rows or not answers.num_rows:
            return _table([], names)
        number, part = part_of(table)
        runs, state = _known(part, answers)
        positions, gram, window, first = _single(part, runs, state)
        p = positions[first]
        return _table(_by_bucket(number, buckets, window[first], window[first], gram[first], part.owner(p), p), names)

    def sort_suffixes(table: pa.Table) -> pa.Table:
        (window, gram, owner, position), part = _gathered(table, "uuii")
        order = np.lexsort((position, part, owner, gram, window))
        window, gram, position, part = (x[order] for x in (window, gram, position, part))
        again = np.zeros(len(window), bool)
        again[1:] = (window[1:] == window[:-1]) & (gram[1:] == gram[:-1])
        return _table(_answers(2, part[again], position[again]), ["part", "kind", "blob"])

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        _, part = part_of(table) if table.num_rows else (0, Part(table.select(["id", "text"]), depth))
        runs, state = _known(part, answers)
        pick = np.flatnonzero(state == 1)
        spans = [(runs["start"][pick], runs["n"][pick] - 1 + depth)]
        positions, _, _, first = _single(part, runs, state)
        spans.append((positions[~first], depth))
        for kind, blob in zip(answers.column("kind").to_pylist(), answers.column("blob").to_pylist(), strict=True):
            if kind == 2:
                spans.append((_unpack(blob, "i")[0], depth))
        gone = _covered(len(part.flat), spans)
        out: dict[str, list] = {k: [] for k in ("removed", "count", "digest", "spans", "kept")}
        for text, begin, n in zip(part.texts, part.start.tolist(), part.size.tolist(), strict=True):
            own = gone[begin : begin + n]
            edge = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0))
            left = text if not len(edge) else np.frombuffer(text, np.uint8)[~own].tobytes()
            out["removed"].append(n - len(left))
            out["count"].append(len(edge) // 2)
            out["digest"].append(hashlib.sha256(left).hexdigest())
            if with_spans:
                out["spans"].append([{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
                out["kept"].append(left)
        columns = {
            id_col: pa.array([None if null else i for i, null in zip(part.ids.tolist(), part.null, strict=True)], pa.int64()),
            "n_bytes": pa.array(part.size, pa.int64()),
            "n_removed": pa.array(out["removed"], pa.int64()),
            "n_spans": pa.array(out["count"], pa.int64()),
            "kept_sha256": pa.array(out["digest"], pa.string()),
        }
        if with_spans:
            columns |= {"spans": pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(out["kept"], pa.binary())}
        return pa.table(columns)

    sent, told = "bucket int, part int, blob binary", "part int, kind int, blob binary"
    by_part = base.groupBy("part")
    about_runs = by_part.applyInArrow(send_runs, sent).groupBy("bucket").applyInArrow(sort_runs, told)
    about_suffixes = by_part.cogroup(about_runs.groupBy("part")).applyInArrow(send_suffixes, sent).groupBy("bucket").applyInArrow(sort_suffixes, told)
    extra = ", spans array<struct<start:long,end:long>>, kept binary" if with_spans else ""
    answers = about_runs.unionByName(about_suffixes)
    return by_part.cogroup(answers.groupBy("part")).applyInArrow(finish, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string{extra}")


def brute_force(docs: list[tuple], depth: int) -> list[tuple]:
    """The contract's rows with a dictionary of all windows, for rows (id, text) or (id, text, place among equal ids); for tests."""
    rows = sorted(((d is not None, d or 0, *place, (t or "").encode(), d) for d, t, *place in docs), key=lambda r: r[:-1])
    seen, out = set(), []
    for *_, text, doc_id in rows:
        gone = [False] * len(text)
        for p in range(len(text) - depth + 1):
            window = text[p : p + depth]
            if window in seen:
                gone[p : p + depth] = [True] * depth
            seen.add(window)
        left = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(text), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out
