import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from annogrid.llm import components as star_rounds
from annogrid.llm import minhash
from annogrid.llm.components import components

NAMES = ["doc_id", "n_shingles", "component_id", "kept"]


def rows(frame):
    return sorted((tuple(r[x] for x in NAMES) for r in frame.collect()), key=str)


def made(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["Été", "A b"]
    docs, texts = [], []
    line = " ".join(rng.choice(vocabulary) for _ in range(12))
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 9, 30, 120, 300]))]
        for _ in range(rng.randint(1, 9)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                k = rng.randrange(len(words))
                words[k : k + rng.randint(0, 2)] = [rng.choice(vocabulary)] * rng.randint(0, 2)
            text = "".join(w.upper() + rng.choice([" ", "\t", "\n", "  "]) if rng.random() < 0.3 else w + " " for w in words)
            texts.append(text + (line if rng.random() < 0.3 else ""))
    ids = list(range(len(texts) + 4))
    rng.shuffle(ids)
    docs = list(zip(ids, texts + [texts[0], None, "", " \n "], strict=True))
    return docs


@pytest.mark.parametrize(("width", "num", "seed"), [(3, 85, 1), (5, 80, 2), (3, 60, 3)])
def test_same_as_brute_force(spark, monkeypatch, width, num, seed):
    docs = made(seed)
    frame = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, n_shingles long")
    if seed == 2:
        monkeypatch.setattr(minhash, "BROADCAST_ROWS", 0)
    got = rows(minhash.near_duplicates(frame, width, num, 100))
    assert got == sorted(minhash.brute_force(docs, width, num, 100), key=str)


def test_chains_longer_than_a_leader_reaches(spark):
    rng = random.Random(8)
    words = [f"v{rng.randrange(10**6)}" for _ in range(400)]
    docs = []
    for k in range(30):  # each is linked with the next few only
        docs.append((100 - k, " ".join(words[4 * k : 4 * k + 120])))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(minhash.near_duplicates(frame, 3, 85, 100)) == sorted(minhash.brute_force(docs, 3, 85, 100), key=str)
    assert {r[2] for r in rows(minhash.near_duplicates(frame, 3, 85, 100))} == {71}


def test_odd_rows(spark):
    text = "one two three four five six seven eight"
    docs = [(None, text), (7, text), (7, text), (9, text), (5, None), (6, "x " * 300000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(minhash.near_duplicates(frame, 3, 85, 100)) == sorted(
        [(None, 6, None, True), (7, 6, 7, True), (7, 6, 7, True), (9, 6, 7, False), (5, 0, 5, True), (6, 1, 6, True)], key=str
    )
    assert rows(minhash.near_duplicates(frame.limit(0), 3, 85, 100)) == []


def test_blocks_of_a_list(spark, monkeypatch):
    monkeypatch.setattr(minhash, "LIST_BLOCK", 3)
    monkeypatch.setattr(minhash, "CLUSTER_ROWS", 3)
    monkeypatch.setattr(minhash, "_leader_pairs", lambda reps, buckets: reps.select(reps.rep.alias("a"), reps.rep.alias("b")).limit(0))
    docs = made(5)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(minhash.near_duplicates(frame, 3, 85, 100)) == sorted(minhash.brute_force(docs, 3, 85, 100), key=str)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 10**6), max_size=90), st.lists(st.integers(0, 10**6), max_size=90))
def test_estimates_of_small_sets_are_exact(a, b):
    a, b = set(a[:40]), set(b[:40])
    sketches = np.full((2, minhash.SKETCH), minhash._NONE)
    for row, s in zip(sketches, (a, b), strict=True):
        row[: len(s)] = sorted(s)
    if len(a | b) <= minhash.SKETCH:
        assert minhash.estimates(sketches[:1], sketches[1:])[0] == pytest.approx(len(a & b) / max(len(a | b), 1))


def test_shared_counts():
    rng = np.random.default_rng(3)
    sets = [[np.unique(rng.integers(0, 9000, rng.integers(0, 6000)).astype(np.uint64)) for _ in range(n)] for n in (7, 5)]
    got = minhash.shared_counts(*map(minhash._entries, sets), 7, 5)
    assert got.tolist() == [[len(np.intersect1d(x, y)) for y in sets[1]] for x in sets[0]]


def test_components(spark):
    rng = random.Random(6)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(5, 5), (None, 3)]
    frame = spark.createDataFrame(edges, "a long, b long")
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert {(r.node, r.component) for r in components(frame).collect()} == {(i, root(i)) for i in list(parent)}
    assert components(frame.limit(0)).count() == 0


@pytest.mark.parametrize("most", [minhash.BROADCAST_ROWS, 0])
def test_rows_kept_are_not_moved(spark, monkeypatch, most):
    """Whole rows were shuffled and sorted by their ids."""
    monkeypatch.setattr(minhash, "BROADCAST_ROWS", most)
    docs = made(7)
    docs += [(None, docs[0][1]), docs[3]]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, other string")
    out = minhash.without_near_duplicates(frame, 3, 85, 100)
    ids = [d for d, _ in docs]
    kept = {d for d, *_, k in minhash.brute_force(docs, 3, 85, 100) if k}
    assert sorted((r.doc_id, r.text, r.other) for r in out.where("doc_id is not null").collect()) == sorted(((*d, "x") for d in docs if d[0] in kept - {None}), key=lambda r: r[0])
    assert out.where("doc_id is null").count() == 1 and len(kept) < len(set(ids))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # the table of ids is small enough here for any join
    try:
        plan = out.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert ("Exchange hashpartitioning" in plan) == (most == 0)


def test_rounds_write_few_files(spark, monkeypatch):
    """A round's edges, few as they are, were written as a file for each partition."""
    files, put = [], spark.conf
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)], "a long, b long")
    whole = star_rounds.stage

    def counted(df):
        out = whole(df)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(star_rounds, "stage", counted)
    before = put.get("spark.sql.shuffle.partitions")
    put.set("spark.sql.shuffle.partitions", "24")
    put.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = components(edges)
        assert {(r.node, r.component) for r in found.collect()} == {(k, 0) for k in range(301)}
        assert len(files) > 2 and max(files[1:]) == 1
        files.clear()
        monkeypatch.setattr(star_rounds, "FILE_ROWS", 100)
        found = components(edges)
        assert {(r.node, r.component) for r in found.collect()} == {(k, 0) for k in range(301)}
        assert 1 < max(files[1:]) <= 6
    finally:
        put.set("spark.sql.shuffle.partitions", before)
        put.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_links_are_written_once(spark, monkeypatch):
    """The pairs that an estimate lets pass were written, and written again as the first round's edges."""
    names, whole = [], minhash.stage
    monkeypatch.setattr(minhash, "stage", lambda df: names.append(df.columns) or whole(df))
    docs = made(9)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(minhash.near_duplicates(frame, 3, 85, 100)) == sorted(minhash.brute_force(docs, 3, 85, 100), key=str)
    assert len(names) == 3 and ["a", "b"] not in names
