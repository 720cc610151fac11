"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

Texts are cut into runs of SPAN bytes. Two light gated units (one update gate, no reset gate) read each run forwards
and backwards; every position gets a probability for each language from both states, and a document's probability is
the mean over its positions. The network is trained on the driver by backpropagation through time, on a sample of
SAMPLE_ROWS rows and SAMPLE_BYTES at most (those with the smallest hash of the id, whole), and applied to every byte of every text.

Defined results: a text that is null, empty or without letters is `und` with score 0; ties go to the language that
comes first by name; repeated rows get equal results; rows without an id aren't learned from; with no rows to learn from every text is `und`; with one
language every text with a letter is of it; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annogrid.llm.common import bounded_sample, map_batches

HIDDEN, SPAN = 8, 64
#: Rows that are collected to the driver for training, and bytes of them in all; whole texts only.
SAMPLE_ROWS, SAMPLE_BYTES = 1200, 32 << 20
STEPS, BATCH, RATE, SEED = 260, 256, 0.02, 11
_LETTER = regex.compile(r"\p{L}")


class GatedReader:
    """h' = h + z (n - h) with z = sigmoid, n = tanh; both are taken from one tanh by halving the gate's part."""

    def __init__(self, rng: np.random.Generator):
        self.table = (rng.standard_normal((256, 2 * HIDDEN)) * 0.3).astype(np.float32)
        self.table[:, :HIDDEN] -= 0.5
        self.loop = (rng.standard_normal((HIDDEN, 2 * HIDDEN)) * 0.3).astype(np.float32)

    def read(self, steps: np.ndarray, keep: bool = False):
        """States after each step; steps: time x sequences of bytes."""
        h = np.zeros((steps.shape[1], HIDDEN), np.float32)
        states = np.empty((*steps.shape, HIDDEN), np.float32)
        acts = np.empty((*steps.shape, 2 * HIDDEN), np.float32) if keep else None
        for t in range(len(steps)):
            a = h @ self.loop
            a += self.table.take(steps[t], axis=0)
            np.tanh(a, out=a)
            z = a[:, :HIDDEN] * 0.5
            z += 0.5
            new = a[:, HIDDEN:] - h
            new *= z
            new += h
            h = states[t] = new
            if keep:
                acts[t] = a
        return states, acts

    def back(self, steps: np.ndarray, states: np.ndarray, acts: np.ndarray, d_states: np.ndarray) -> list[np.ndarray]:
        d_table, d_loop = np.zeros_like(self.table), np.zeros_like(self.loop)
        d_h = np.zeros(states.shape[1:], np.float32)
        d_a = np.empty_like(acts)
        zero = np.zeros_like(states[0])
        for t in range(len(steps) - 1, -1, -1):
            d_h += d_states[t]
            a, before = acts[t], states[t - 1] if t else zero
            z, n = a[:, :HIDDEN] * 0.5 + 0.5, a[:, HIDDEN:]
            d_a[t, :, :HIDDEN] = d_h * (n - before) * 0.5 * (1 - a[:, :HIDDEN] ** 2)
            d_a[t, :, HIDDEN:] = d_h * z * (1 - n**2)
            d_loop += before.T @ d_a[t]
            d_h = d_h * (1 - z) + d_a[t] @ self.loop.T
        flat, where = d_a.reshape(-1, 2 * HIDDEN), steps.ravel()
        for k in range(2 * HIDDEN):
            d_table[:, k] = np.bincount(where, flat[:, k], 256)
        return [d_table, d_loop]


class LanguageNet:
    def __init__(self, languages: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.forth, self.back = GatedReader(rng), GatedReader(rng)
        self.out = (rng.standard_normal((2 * HIDDEN, len(languages))) * 0.1).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.forth.table, self.forth.loop, self.back.table, self.back.loop, self.out, self.bias]

    def position_probabilities(self, steps: np.ndarray) -> np.ndarray:
        """time x sequences x languages."""
        forth, _ = self.forth.read(steps)
        back, _ = self.back.read(steps[::-1])
        logits = forth.reshape(-1, HIDDEN) @ self.out[:HIDDEN]
        logits += back[::-1].reshape(-1, HIDDEN) @ self.out[HIDDEN:]
        logits += self.bias
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits.reshape(*steps.shape, -1)

    def gradients(self, steps: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[list[np.ndarray], float]:
        forth, forth_acts = self.forth.read(steps, True)
        back, back_acts = self.back.read(steps[::-1], True)
        both = np.concatenate([forth, back[::-1]], axis=2)
        logits = both @ self.out + self.bias
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        loss = float(-(np.log(np.take_along_axis(p, target[None, :, None], 2)[..., 0] + 1e-9) * weight).sum() / weight.sum())
        np.put_along_axis(p, np.broadcast_to(target[None, :, None], (*steps.shape, 1)), np.take_along_axis(p, target[None, :, None], 2) - 1, 2)
        d = p * (weight / weight.sum())[..., None]
        d_both = d @ self.out.T
        d_out = both.reshape(-1, 2 * HIDDEN).T @ d.reshape(-1, d.shape[-1])
        grads = self.forth.back(steps, forth, forth_acts, d_both[..., :HIDDEN])
        grads += self.back.back(steps[::-1], back, back_acts, d_both[::-1, :, HIDDEN:])
        return [*grads, d_out, d.sum(axis=(0, 1))], loss

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """A text's mean probability of each language over all its bytes; texts are not empty."""
        sizes = np.array([len(t) for t in texts], np.int64)
        runs = -(-sizes // SPAN)
        first = np.concatenate([[0], np.cumsum(runs)[:-1]]).astype(np.int64)
        flat = np.zeros((int(runs.sum()), SPAN), np.uint8)
        line = flat.reshape(-1)
        for k, text in zip((first * SPAN).tolist(), texts, strict=True):
            line[k : k + len(text)] = np.frombuffer(text, np.uint8)
        filled = np.full(len(flat), SPAN)
        filled[first + runs - 1] = sizes - (runs - 1) * SPAN
        sums = np.empty((len(flat), len(self.languages)))
        for k in range(0, len(flat), 1024):
            steps = np.ascontiguousarray(flat[k : k + 1024].T)
            p = self.position_probabilities(steps)
            p *= (np.arange(SPAN)[:, None] < filled[None, k : k + 1024])[..., None]
            sums[k : k + 1024] = p.sum(axis=0)
        return np.add.reduceat(sums, first) / sizes[:, None]


def fit(texts: list[bytes], languages: list[str], steps: int = STEPS, seed: int = SEED) -> LanguageNet:
    """Adam over random runs of the texts, languages drawn evenly; gradients are clipped by norm."""
    names = sorted(set(languages))
    net, rng = LanguageNet(names, seed), np.random.default_rng(seed)
    by_name = {x: [t for t, lang in zip(texts, languages, strict=True) if lang == x and t] for x in names}
    used = [k for k, x in enumerate(names) if by_name[x]]
    if len(used) < 2:
        return net
    weights = {k: np.cumsum([len(t) for t in by_name[names[k]]]) for k in used}
    first, second = ([np.zeros_like(x) for x in net.parameters()] for _ in range(2))
    for step in range(1, steps + 1):
        target = np.array(used)[rng.integers(0, len(used), BATCH)]
        runs, weight = np.zeros((SPAN, BATCH), np.uint8), np.zeros((SPAN, BATCH), np.float32)
        for j, k in enumerate(target.tolist()):
            text = by_name[names[k]][int(np.searchsorted(weights[k], rng.integers(0, weights[k][-1]), "right"))]
            start = int(rng.integers(0, max(1, len(text) - SPAN // 2)))
            part = np.frombuffer(text[start : start + SPAN], np.uint8)
            runs[: len(part), j], weight[: len(part), j] = part, 1
        grads, _ = net.gradients(runs, target, weight)
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads)))
        rate = RATE * (1 - 0.9 * step / steps)
        clip = min(1.0, 1.0 / max(norm, 1e-9))
        for x, g, m, v in zip(net.parameters(), grads, first, second, strict=True):
            g = g * clip
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def learn(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS) -> LanguageNet | None:
    """Fit on the usable rows with a language, those with the smallest hash of the id: `rows` and SAMPLE_BYTES at most; None if there are none."""
    known = docs.select(id_col, text_col, lang_col).where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & usable)
    found = bounded_sample(known, id_col, text_col, lang_col, rows, SAMPLE_BYTES)
    return fit([x[0] for x in found], [x[1] for x in found]) if found else None


def predict(docs: DataFrame, net: LanguageNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """lang_pred and score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    id_type = dict(docs.dtypes)[id_col]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        net, n = shared.value, batch.num_rows
        names, scores = ["und"] * n, np.zeros(n)
        plain = [x or "" for x in batch.column(1).to_pylist()]
        there = [k for k, x in enumerate(plain) if net is not None and _LETTER.search(x)]
        k = 0
        while k < len(there):  # texts of about 1 MB at a time
            end, size, texts = k, 0, []
            while end < len(there) and size < 1 << 20:
                texts.append(plain[there[end]].encode())
                size += len(texts[-1])
                end += 1
            p = net.pooled(texts)
            best = p.argmax(axis=1)
            for i, row in enumerate(there[k:end]):
                names[row], scores[row] = net.languages[best[i]], min(1.0, float(p[i, best[i]]))
            k = end
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [id_col, "lang_pred", "score"])

    return map_batches(docs.select(id_col, text_col), run, f"`{id_col}` {id_type}, lang_pred string, score double")
