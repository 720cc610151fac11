import random

import pytest
from pyspark.sql import functions as F

from annogrid.llm import suffix_dedup

NAMES = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def rows(frame):
    return sorted((tuple(r[x] for x in NAMES) for r in frame.collect()), key=str)


def placed(spark, frame):
    """(id, text, place): the part that a row is dealt to puts rows of the same id in order."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = suffix_dedup.part_of_row(F.col("doc_id"), F.col("text").cast("binary"), parts)
    return [(r.doc_id, r.text, r.place) for r in frame.select("doc_id", "text", place.alias("place")).collect()]


def made(seed, n=60):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abé d") for _ in range(rng.randint(5, 60))) for _ in range(6)]
    docs = []
    for i in range(n):
        text = "".join(rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice("xyz ") for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(0, 8)))
        docs.append((i * 7 % n, text))
    docs += [(n, "ab" * 300), (n + 1, "aaaa" * 100), (n + 2, None), (n + 3, ""), (3, docs[3][1]), (None, passages[0] * 2), (None, passages[1] * 3), (-5, passages[2] * 2)]
    near = "".join(rng.choice("klmnop ") for _ in range(300))
    for i in range(12):
        k = rng.randint(0, 299)
        docs.append((n + 10 + i, near[:k] + "Q" + near[k + 1 :]))
    return docs


@pytest.mark.parametrize("depth", [12, 31, 100])
def test_same_as_brute_force(spark, monkeypatch, depth):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 256)
    docs = made(depth)
    frame = spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, part string")
    assert rows(suffix_dedup.repeats(frame, depth)) == sorted(suffix_dedup.brute_force(placed(spark, frame), depth), key=str)


def test_rows_of_one_id_are_spread(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(12)) for _ in range(8)]
    docs = [(rng.choice([None, 5]), "".join(rng.choice(words) for _ in range(6))) for _ in range(80)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = placed(spark, frame)
    assert len({place for *_, place in found}) > 1
    assert rows(suffix_dedup.repeats(frame, 30)) == sorted(suffix_dedup.brute_force(found, 30), key=str)


def test_a_line_of_all_documents_is_not_one_bucket(spark):
    """Each part tells a bucket of a line's grams once, in however many surroundings the line stands."""
    import pyarrow as pa

    rng = random.Random(4)
    line = "this line of seventy-eight letters stands in every single one of the documents"
    texts = ["".join(rng.choice("abcdefghijklm ") for _ in range(150)) + line + "".join(rng.choice("nopqrstuv ") for _ in range(150)) for _ in range(300)]
    part = suffix_dedup.Part(pa.table({"id": pa.array(range(300), pa.int64()), "text": pa.array([t.encode() for t in texts])}), 100)
    runs = part.runs()
    first = suffix_dedup._first_runs(runs)
    gram = runs["gram"][first]
    alone = suffix_dedup._alone(gram)
    hot = max(set(gram.tolist()), key=lambda g: int((gram == g).sum()))
    assert int((gram == hot).sum()) >= 250 and not alone[gram == hot].any() and alone.sum() > 1000
    docs = list(enumerate(texts))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(suffix_dedup.repeats(frame, 70)) == sorted(suffix_dedup.brute_force(docs, 70), key=str)


def test_spans_and_kept_bytes(spark):
    passage = "the passage that is repeated word by word"
    frame = spark.createDataFrame([(2, "x " + passage + " y"), (1, passage)], "doc_id long, text string")
    found = {r.doc_id: r for r in suffix_dedup.repeats(frame, 20, with_spans=True).collect()}
    assert bytes(found[2].kept) == b"x  y" and [(s.start, s.end) for s in found[2].spans] == [(2, 2 + len(passage))]
    assert bytes(found[1].kept) == passage.encode() and found[1].n_spans == 0


def test_long_texts_and_empty_tables(spark):
    docs = [(1, "abcdefghij" * 30000), (2, "q" * 70000 + "end")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(suffix_dedup.repeats(frame, 100)) == sorted(suffix_dedup.brute_force(docs, 100), key=str)
    assert rows(suffix_dedup.repeats(frame.limit(0), 100)) == []


def test_covered_bytes_take_few_bytes_each():
    """A worker held twenty bytes for each byte of its part here, most of what it held at once."""
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(5)
    size = 1 << 20
    starts = np.sort(rng.integers(0, size - 100, 5000))
    tracemalloc.start()
    found = suffix_dedup._covered(size, [(starts, 100), (starts[::7], np.full(len(starts[::7]), 100))])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 7 * size
    plain = np.zeros(size, bool)
    for a in starts.tolist():
        plain[a : a + 100] = True
    assert (found == plain).all()
