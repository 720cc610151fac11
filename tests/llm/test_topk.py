import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from annogrid.llm import topk


def brute(ids, vectors, place, q, k):
    """The best for the query row at a place; -1 for one that isn't in the table."""
    scored = sorted((-int(v @ q), int(j)) for row, (j, v) in enumerate(zip(ids, vectors, strict=True)) if row != place)
    return [(j, -s) for s, j in scored[:k]]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 300), st.integers(1, 6), st.integers(1, 7), st.integers(1, 40), st.booleans())
def test_lists_give_the_best(seed, n, d, k, spread, own):
    rng = np.random.default_rng(seed)
    ids, vectors = rng.integers(0, n, n), rng.integers(-spread, spread + 1, (n, d))
    place = int(rng.integers(0, n)) if own else -1
    q = vectors[place] if own else rng.integers(-2, 3, d)
    found, scores, _ = topk.SortedLists(ids, vectors).top(int(ids[place]) if own else -1, q, k)
    assert list(zip(found.tolist(), scores.tolist(), strict=True)) == brute(ids, vectors, place, q, k)


def test_stops_early():
    rng = np.random.default_rng(1)
    vectors = rng.integers(-1000, 1000, (4000, 2))
    _, _, scored = topk.SortedLists(np.arange(4000), vectors).top(-1, np.array([3, -2]), 5)
    assert scored < 2000


def test_query(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 60)
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(300)]
    rows += [(300, None), (301, [0.1, None, 0.2, 0.3]), (302, [float("nan")] * 4), (303, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (7, rows[8][1]), (304, rows[8][1]), (350, [0.0] * 4), (10, rows[10][1]), (20, rows[8][1]), (20, rows[9][1])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in topk.exact_top_k(frame, F.col("vec_id") % 10 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    whole = [(i, np.floor(np.float32(v).astype(float) * 256).astype(int)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    ids, vectors = np.array([i for i, _ in whole]), np.array([v for _, v in whole])
    want = {}
    for place, (i, v) in enumerate(whole):
        if i % 10 == 0:
            want.setdefault(i, []).extend((r + 1, *x) for r, x in enumerate(brute(ids, vectors, place, v, 5)))
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in want.items()} and len(want[10]) == 10 and len(want[20]) == 15
    assert topk.exact_top_k(frame.limit(0), F.col("vec_id") % 10 == 0).count() == 0
