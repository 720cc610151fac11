import random

from annogrid.llm import decontam

NAMES = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def cases():
    rng = random.Random(3)
    vocabulary = ["aa", "Bb", "c9", "dé", "ee", "x"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 14)))) for i in range(12)] + [(3, "aa Bb"), (None, "x x x"), (99, None), (100, "...")]
    docs = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        text = "".join(w + rng.choice([" ", ", ", "\n", "--"]) for w in words)
        if i % 3 == 0:
            text += (items[i % 12][1]).upper().replace(" ", " ; ") + " tail"
        docs.append((i, text))
    return docs + [(60, None), (61, ""), (62, "!!!"), (0, docs[0][1]), (None, "aa bb"), (64, "x x x " * 20000)], items


def rows(frame):
    return sorted((tuple(r[x] for x in NAMES) for r in frame.collect()), key=str)


def test_same_as_brute_force(spark):
    docs, items = cases()
    frame = spark.createDataFrame([(*d, "n") for d in docs], "doc_id long, text string, n_hit string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(decontam.brute_force([d for d in docs if d[0] != 64], items, 3), key=str)
    got = rows(decontam.contamination(frame, benchmark, 3))
    assert [r for r in got if r[0] != 64] == want
    assert [r[1:4] for r in got if r[0] == 64] == [(60000, 60000, sum("x" in (t or "") and set((t or "").split()) == {"x"} for i, t in items if i is not None))]


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs, items = cases()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = rows(decontam.contamination(frame, benchmark, 4))
    monkeypatch.setattr(decontam, "MAX_BLOCK_BYTES", 40)
    assert rows(decontam.contamination(frame, benchmark, 4)) == want


def test_offsets_point_into_the_original(spark):
    text = "Zé -- The CAT, sat (on) it! Ok"
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(5, "the cat sat on"), (6, "cat sat on it")], "item_id long, text string")
    (row,) = decontam.find_spans(frame, benchmark, 10).collect()
    (span,) = row.spans
    assert text.encode()[span.first_byte : span.end_byte].decode() == "The CAT, sat (on) it"
    assert (span.first, span.end, row.items) == (1, 6, ["5", "6"])


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert rows(decontam.contamination(docs.limit(0), items)) == []
    assert rows(decontam.contamination(docs, items.limit(0)))[0][2:4] == (0, 0)
