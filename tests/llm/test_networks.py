import random

import numpy as np
from pyspark.sql import functions as F

from annogrid.llm import langid, quality


def numeric(loss, x, i, eps=1e-2):
    old = x.flat[i]
    x.flat[i] = old + eps
    a = loss()
    x.flat[i] = old - eps
    b = loss()
    x.flat[i] = old
    return (a - b) / (2 * eps)


def test_language_gradients():
    net = langid.LanguageNet(["a", "b", "c"])
    rng = np.random.default_rng(0)
    steps, target, weight = rng.integers(0, 256, (7, 5)).astype(np.uint8), rng.integers(0, 3, 5), np.ones((7, 5), np.float32)
    weight[5:, 2] = 0
    grads, _ = net.gradients(steps, target, weight)
    for x, g in zip(net.parameters(), grads, strict=True):
        for i in np.argsort(-np.abs(g).ravel())[:4]:
            assert abs(numeric(lambda: net.gradients(steps, target, weight)[1], x, i) - g.flat[i]) < 2e-3 + 0.05 * abs(g.flat[i])


def test_quality_gradients():
    net = quality.ByteConvNet()
    rng = np.random.default_rng(1)
    texts, labels = [rng.integers(1, 256, n).astype(np.uint8).tobytes() for n in (30, 700, 5)], np.array([1, 0, 1], np.float32)
    grads, _ = net.gradients(texts, labels)
    for x, g in zip(net.parameters(), grads, strict=True):
        for i in np.argsort(-np.abs(g).ravel())[:3]:
            assert abs(numeric(lambda: net.gradients(texts, labels)[1], x, i, 1e-3) - g.flat[i]) < 3e-3 + 0.1 * abs(g.flat[i])


def test_every_byte_counts_for_quality():
    net = quality.ByteConvNet()
    tables = net.pair_tables()
    text = bytes(random.Random(2).choices(b"abcdefgh ", k=3000))
    rows, first = quality._chunked([text, b"", b"x"])
    assert len(rows) == 8 and first.tolist() == [0, 6, 7]
    flat = np.frombuffer(text + bytes(quality.WIDTH), np.uint8)
    windows = np.lib.stride_tricks.sliding_window_view(flat, quality.WIDTH)[: len(text)]
    direct = net.embed[windows].reshape(len(text), -1) @ net.filters
    assert np.allclose(net.pooled(rows, tables)[:6].max(axis=0), np.maximum(np.maximum(direct.max(axis=0), (net.embed[rows[5, -quality.WIDTH :]].reshape(1, -1) @ net.filters)[0]) + net.offset, 0), atol=1e-4)


def made(spark, n=240):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        good = i % 3 != 0
        lang = ["en", "fr"][i % 2]
        words = ["the", "and", "thing", "with"] if lang == "en" else ["été", "le", "où", "que"]
        text = " ".join(rng.choice(words) + ("" if good else "***") for _ in range(rng.randint(5, 200)))
        rows.append((i, text, lang, f"s{i % 5}", len(text)))
        labels.append((i, int(good), 0))
    odd = [(1000, None, "en", "s", 0), (1001, "", None, None, None), (1002, "12 34 !", "fr", "s", 7), (1003, "the thing " * 30000, "en", "s", 1), (None, "the and", "en", "s", 1), (0, rows[0][1], "en", "s", 1)]
    docs = spark.createDataFrame([(*r, "x") for r in rows + odd], "doc_id long, text string, lang string, source string, n_chars long, score string")
    return docs, spark.createDataFrame(labels + [(1, None, None), (0, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(spark):
    docs, labels = made(spark)
    out = F.coalesce(quality.fold_of("doc_id", 4) == 2, F.lit(False))
    net = quality.learn(docs, labels, ~out)
    rows = quality.score(docs, net).withColumn("held_out", out).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 1000]
    assert np.mean([r.predicted == int(r.doc_id % 3 != 0) for r in held]) > 0.95
    assert quality.score(docs.limit(0), net).count() == 0
    none = quality.learn(docs, labels.limit(0), ~out)
    assert {round(r.score, 6) for r in quality.score(docs, none).collect()} == {0.5}


def test_language_on_held_out_rows(spark):
    docs, _ = made(spark)
    out = F.coalesce(quality.fold_of("doc_id", 3) == 1, F.lit(False))
    net = langid.learn(docs, ~out)
    rows = langid.predict(docs, net).withColumn("held_out", out).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.doc_id: r.lang_pred for r in rows if r.doc_id in (1000, 1001, 1002, 1003)} == {1000: "und", 1001: "und", 1002: "und", 1003: "en"}
    assert np.mean([r.lang_pred == ["en", "fr"][r.doc_id % 2] for r in rows if r.held_out and r.doc_id < 1000]) > 0.98
    assert {r.lang_pred for r in langid.predict(docs, langid.learn(docs.limit(0), ~out)).collect()} == {"und"}
