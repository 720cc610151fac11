"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are embedded and convolved by learned filters of WIDTH bytes. Chunks of CHUNK positions, each
reading WIDTH - 1 bytes of the next, cover the whole text; each filter's responses are max-pooled over a chunk, and the
chunks' pooled responses are combined (their maximum and their mean) into one probability.

The network is fitted on the driver on a sample of labelled rows, SAMPLE_ROWS and SAMPLE_BYTES at most: those with the
smallest hash of the id, whole; a text that no longer fits into SAMPLE_BYTES is passed over. It is applied to every byte of every text on the executors.

Defined results: a null or empty text is one chunk of padding and gets that chunk's score; rows without a label, or
whose text is null, are not learned from; rows with the same id in the labels count with the smaller label; repeated
rows get equal scores; with no rows to learn from, or of one class only, every score is that class's smoothed share;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annogrid.llm.common import bounded_sample, map_batches, texts_of

WIDTH, CHUNK, EMBED, FILTERS = 6, 512, 8, 16
#: Labelled rows that are collected to the driver, and bytes of them in all; whole texts only.
SAMPLE_ROWS, SAMPLE_BYTES = 1600, 12 << 20
EPOCHS, RATE, SEED = 6, 0.02, 7


def _chunked(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A row of CHUNK + WIDTH - 1 bytes for each chunk, padded with 0, and the index of each text's first chunk."""
    counts = np.array([max(1, -(-len(t) // CHUNK)) for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    flat = np.zeros(int(counts.sum()) * CHUNK + WIDTH - 1, np.uint8)
    for k, text in zip(first.tolist(), texts, strict=True):
        flat[k * CHUNK : k * CHUNK + len(text)] = np.frombuffer(text, np.uint8)
    rows = np.lib.stride_tricks.sliding_window_view(flat, CHUNK + WIDTH - 1)[::CHUNK].copy()
    ends = np.concatenate([first[1:], [len(rows)]]) - 1
    rows[ends, CHUNK:] = 0  # a text's last chunk doesn't read the next text
    return rows, first


class ByteConvNet:
    """Embedding, convolution, max-pooling by chunk, combination over chunks."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.embed = (rng.standard_normal((256, EMBED)) * 0.5).astype(np.float32)
        self.embed[0] = 0
        self.filters = (rng.standard_normal((WIDTH * EMBED, FILTERS)) / np.sqrt(WIDTH * EMBED)).astype(np.float32)
        self.offset = np.zeros(FILTERS, np.float32)
        self.weights = (rng.standard_normal(2 * FILTERS) * 0.1).astype(np.float32)
        self.bias = np.zeros(1, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.offset, self.weights, self.bias]

    def pair_tables(self) -> list[np.ndarray]:
        """Responses to pairs of bytes: a filter's response is the sum of WIDTH / 2 looked-up rows."""
        out = []
        for j in range(0, WIDTH, 2):
            a, b = (self.embed @ self.filters[k * EMBED : (k + 1) * EMBED] for k in (j, j + 1))
            out.append((a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS))
        return out

    def pooled(self, rows: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        out = np.empty((len(rows), FILTERS), np.float32)
        for k in range(0, len(rows), 64):
            part = rows[k : k + 64].astype(np.int32)
            pairs = part[:, :-1] * 256 + part[:, 1:]
            total = tables[0].take(pairs[:, :CHUNK], axis=0)
            for j in range(1, WIDTH // 2):
                total += tables[j].take(pairs[:, 2 * j : 2 * j + CHUNK], axis=0)
            out[k : k + 64] = total.max(axis=1)
        return np.maximum(out + self.offset, 0)

    def combined(self, pooled: np.ndarray, first: np.ndarray) -> np.ndarray:
        counts = np.diff(np.concatenate([first, [len(pooled)]]))
        return np.hstack([np.maximum.reduceat(pooled, first), np.add.reduceat(pooled, first) / counts[:, None]])

    def probabilities(self, texts: list[bytes], tables: list[np.ndarray] | None = None) -> np.ndarray:
        rows, first = _chunked(texts)
        features = self.combined(self.pooled(rows, tables or self.pair_tables()), first)
        return 1 / (1 + np.exp(-np.clip(features.astype(np.float64) @ self.weights + self.bias, -40, 40)))

    def gradients(self, texts: list[bytes], labels: np.ndarray) -> tuple[list[np.ndarray], float]:
        rows, first = _chunked(texts)
        n, counts = len(rows), np.diff(np.concatenate([first, [len(rows)]]))
        owner = np.repeat(np.arange(len(texts)), counts)
        best = np.empty((n, FILTERS), np.int64)
        top = np.empty((n, FILTERS), np.float32)
        tables = self.pair_tables()
        for k in range(0, n, 64):
            part = rows[k : k + 64].astype(np.int32)
            pairs = part[:, :-1] * 256 + part[:, 1:]
            total = sum(tables[j].take(pairs[:, 2 * j : 2 * j + CHUNK], axis=0) for j in range(WIDTH // 2))
            best[k : k + 64] = total.argmax(axis=1)
            top[k : k + 64] = np.take_along_axis(total, best[k : k + 64, None, :], axis=1)[:, 0]
        pooled = np.maximum(top + self.offset, 0)
        features = self.combined(pooled, first)
        p = 1 / (1 + np.exp(-np.clip(features @ self.weights + self.bias, -40, 40)))
        loss = float(-np.mean(np.log(np.where(labels > 0, p, 1 - p) + 1e-9)))
        d = ((p - labels) / len(texts)).astype(np.float32)
        d_features = d[:, None] * self.weights
        highest = features[:, :FILTERS][owner]
        is_top = (pooled == highest).astype(np.float32)
        is_top /= np.maximum(np.add.reduceat(is_top, first), 1)[owner]
        d_pooled = d_features[owner, :FILTERS] * is_top + (d_features[:, FILTERS:] / counts[:, None])[owner]
        d_pooled *= pooled > 0
        window = rows[np.arange(n)[:, None, None], best[:, :, None] + np.arange(WIDTH)]  # chunk, filter, byte
        seen = self.embed[window]
        d_filters = np.einsum("cf,cfwe->wef", d_pooled, seen).reshape(WIDTH * EMBED, FILTERS)
        shaped = self.filters.reshape(WIDTH, EMBED, FILTERS)
        d_embed = np.zeros_like(self.embed)
        np.add.at(d_embed, window.ravel(), np.einsum("cf,wef->cfwe", d_pooled, shaped).reshape(-1, EMBED))
        d_embed[0] = 0
        return [d_embed, d_filters, d_pooled.sum(axis=0), features.T @ d, np.array([d.sum()], np.float32)], loss


def fit(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> ByteConvNet:
    """Adam over batches of documents of mixed lengths; the order is drawn from the seed."""
    net, rng = ByteConvNet(seed), np.random.default_rng(seed)
    target = np.array(labels, np.float32)
    if len(set(labels)) < 2:
        net.weights[:] = 0
        net.bias[0] = np.log((target.sum() + 0.5) / (len(target) - target.sum() + 0.5))
        return net
    first, second = ([np.zeros_like(x) for x in net.parameters()] for _ in range(2))
    step, total = 0, epochs * -(-len(texts) // 32)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), 32):
            pick = order[k : k + 32]
            grads, _ = net.gradients([texts[i] for i in pick], target[pick])
            step += 1
            rate = RATE * min(1.0, step / 10) * (1 - 0.9 * step / total)
            for x, g, m, v in zip(net.parameters(), grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def fold_of(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def learn(
    docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS
) -> ByteConvNet:
    """Fit on the labelled rows with the smallest hash of the id among those that are usable: `rows` and SAMPLE_BYTES at most."""
    known = labels.select(id_col, F.col(label_col).alias("_label")).where(F.col("_label").isNotNull() & F.col(id_col).isNotNull() & usable)
    known = known.groupBy(id_col).agg(F.min("_label").alias("_label")).orderBy(F.xxhash64(id_col), id_col).limit(rows)
    sample = docs.select(id_col, text_col).where(F.col(text_col).isNotNull() & usable).join(F.broadcast(known), id_col)
    found = bounded_sample(sample, id_col, text_col, "_label", rows, SAMPLE_BYTES)
    return fit([x[0] for x in found], [int(x[1] > 0) for x in found])


def score(docs: DataFrame, net: ByteConvNet, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, threshold: float = 0.7) -> DataFrame:
    """score and predicted beside the id, or beside all columns named in keep."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    names = keep or [id_col]
    state: dict = {}
    types = dict(docs.dtypes)
    schema = ", ".join(f"`{x}` {types[x]}" for x in names) + ", score double, predicted int"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "tables" not in state:
            state["net"] = shared.value
            state["tables"] = state["net"].pair_tables()
        texts, scores, k = texts_of(batch.column("_text")), [], 0
        while k < len(texts):  # texts of about 1 MB at a time
            end, size = k, 0
            while end < len(texts) and (end == k or size + len(texts[end]) < 1 << 20):
                size += len(texts[end])
                end += 1
            scores.append(state["net"].probabilities(texts[k:end], state["tables"]))
            k = end
        p = np.concatenate(scores)
        columns = [batch.column(x) for x in names] + [pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())]
        return pa.RecordBatch.from_arrays(columns, [*names, "score", "predicted"])

    plain = docs.select(*names, F.col(text_col).alias("_text"))
    return map_batches(plain, run, schema)
