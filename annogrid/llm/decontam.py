"""Benchmark decontamination with one Aho-Corasick automaton over normalised test questions and answers.

Texts and items are lower-cased in A-Z and cut into words of digits, letters a-z and bytes from 0x80 on. Every window
of `window` consecutive words of an item is a key (an item with fewer words is one key); the automaton holds all keys
as word sequences with a space on either side. A text is normalised to its words, scanned once, and each occurrence's
offsets are mapped back to bytes of the original text.

Defined results: a null or empty text, or one without words, has no words and no hits; an item without words or with a
null text has no windows; an item with a null id marks words but is not named among the items; equal items count each
by its id, the same id once; repeated documents are judged each; empty tables give empty or clean results; other
columns are not read.

The items are broadcast only up to MAX_BLOCK_BYTES of text. A larger benchmark is cut into blocks of items of that
size, the texts are scanned once for each block, and a document's spans are united.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annogrid.llm.common import map_batches, texts_of

#: Text of benchmark items in one automaton.
MAX_BLOCK_BYTES = 4 << 20
_WORD = bytes(
    (b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_IS_WORD = np.frombuffer(_WORD, np.uint8) != 32


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The first byte of each word and the byte after it, in the original text."""
    inside = np.zeros(len(text) + 2, np.int8)
    inside[1:-1] = _IS_WORD[np.frombuffer(text, np.uint8)]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


class WindowAutomaton:
    """All windows of the items in one automaton; scan() finds every occurrence in one pass."""

    def __init__(self, items: list[tuple[object, bytes]], window: int):
        keys: dict[bytes, tuple[int, set]] = {}
        for item_id, text in items:
            words = words_of(text)
            for k in range(max(1, len(words) - window + 1) if words else 0):
                part = words[k : k + window]
                keys.setdefault(b" ".join(part), (len(part), set()))[1].add(item_id)
        self.automaton = ahocorasick.Automaton()
        for key, (n, ids) in keys.items():
            self.automaton.add_word(f" {key.decode('latin-1')} ", (n, frozenset(x for x in ids if x is not None)))
        if keys:
            self.automaton.make_automaton()
        self.empty = not keys

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set]:
        """The text's number of words, the word spans [first, end) of all occurrences, and the ids of the items in them."""
        words = words_of(text)
        if self.empty or not words:
            return len(words), [], set()
        plain = b" " + b" ".join(words) + b" "
        found = list(self.automaton.iter(plain.decode("latin-1")))
        if not found:
            return len(words), [], set()
        spaces = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32)
        ends = np.searchsorted(spaces, [end for end, _ in found])
        spans, ids = [], set()
        for end, (_, (n, names)) in zip(ends.tolist(), found, strict=True):
            spans.append((end - n, end))
            ids |= names
        return len(words), spans, ids


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one."""
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((first, end))
    return out


_automata: dict = {}


def _automaton(key: str, items: list, window: int) -> WindowAutomaton:
    if key not in _automata:
        _automata.clear()
        _automata[key] = WindowAutomaton(items, window)
    return _automata[key]


def _blocks(benchmark: DataFrame, item_id: str, text_col: str) -> Iterator[list[tuple[object, bytes]]]:
    """The items in blocks of bounded size, the last of which may be empty; the driver holds one partition of the items and
    the block it fills."""
    block, size = [], 0
    for row in benchmark.select(item_id, text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        text = row[1].encode()
        if size + len(text) > MAX_BLOCK_BYTES and block:
            yield block
            block, size = [], 0
        block.append((row[0], text))
        size += len(text)
    yield block


_SPANS = "array<struct<first:long,end:long,first_byte:long,end_byte:long>>"
_SPAN_TYPE = pa.list_(pa.struct([(x, pa.int64()) for x in ("first", "end", "first_byte", "end_byte")]))


def _scan_block(rows: DataFrame, items: list, window: int) -> DataFrame:
    """Scan every row once for one block's items. The last column of rows is the text; the others are kept."""
    shared, key = rows.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex
    kept = rows.columns[:-1]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton = _automaton(key, shared.value, window)
        counts, spans, names = [], [], []
        for text in texts_of(batch.column(len(kept))):
            n, found, ids = automaton.scan(text)
            begin, after = word_bounds(text) if found else ([], [])
            counts.append(n)
            names.append(sorted(map(str, ids)))
            spans.append([{"first": a, "end": b, "first_byte": int(begin[a]), "end_byte": int(after[b - 1])} for a, b in united(found)])
        columns = [*batch.columns[: len(kept)], pa.array(counts, pa.int64()), pa.array(spans, _SPAN_TYPE), pa.array(names, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(columns, [*kept, "n_words", "spans", "items"])

    types = "".join(f"`{x}` {kind}, " for x, kind in rows.dtypes[:-1])
    return map_batches(rows, run, f"{types}n_words long, spans {_SPANS}, items array<string>")


def find_spans(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """A row for each row of docs: the columns to keep (the id by default), n_words, spans and items.

    spans: united spans of hit words (first, end) and their bytes in the original text (first_byte, end_byte).
    items: the ids of the items that occur, as strings, sorted.
    """
    keep = keep or [id_col]
    blocks = _blocks(benchmark, item_id, item_text)
    text = F.col(text_col).alias("_text")
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _scan_block(docs.select(*keep, text), first, window)
    # Equal rows have equal results: a row is known by the digest of its columns, which alone goes through the blocks.
    row = F.sha2(F.to_json(F.struct(*(F.col(c) for c in dict.fromkeys([*keep, text_col])))), 256).alias("_row")
    parts = []
    for items in chain([first, second], blocks):
        found = _scan_block(docs.select(row, text), items, window)
        parts.append(found.groupBy("_row").agg(*(F.any_value(c).alias(c) for c in ("n_words", "spans", "items"))))
    whole = reduce(DataFrame.unionByName, parts)
    met = whole.groupBy("_row").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
    )
    return docs.select(*keep, row).join(met, "_row").select(*keep, "n_words", unite_column("spans").alias("spans"), F.array_sort("items").alias("items"))


def unite_column(spans: str):
    """Overlapping or touching spans of an array as one each."""
    start = F.array().cast(_SPANS)

    def step(done, x):
        last = F.element_at(done, -1)
        joined = F.struct(
            last["first"].alias("first"), F.greatest(last["end"], x["end"]).alias("end"), last["first_byte"].alias("first_byte"), F.greatest(last["end_byte"], x["end_byte"]).alias("end_byte")
        )
        touches = (F.size(done) > 0) & (x["first"] <= F.coalesce(last["end"], F.lit(-1)))
        return F.when(touches, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(spans), start, step)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, **names) -> DataFrame:
    """Counts of words and hit words for each document, and the items that occur in it."""
    found = find_spans(docs, benchmark, window, **names)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["first"])
    return found.select(
        found.columns[0],
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def brute_force(docs: list[tuple], items: list[tuple], window: int = 10) -> list[tuple]:
    """The contract's rows by comparing every word position with every window; for tests."""
    keys = []
    for item_id, text in items:
        words = words_of((text or "").encode())
        for k in range(max(1, len(words) - window + 1) if words else 0):
            keys.append((item_id, words[k : k + window]))
    out = []
    for doc_id, text in docs:
        words, hit, ids = words_of((text or "").encode()), set(), set()
        for item_id, key in keys:
            for k in range(len(words) - len(key) + 1):
                if words[k : k + len(key)] == key:
                    hit |= set(range(k, k + len(key)))
                    ids |= {str(item_id)} if item_id is not None else set()
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(ids), digest, bool(hit)))
    return out
