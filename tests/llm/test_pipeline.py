import hashlib
import random
import re

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from annogrid.llm import bpe, decontam, minhash, pii
from annogrid.llm.common import stage


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus: clean texts, copies, benchmark passages, personal data, junk."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(words(20)).capitalize() + ".") for i in range(5)]
    docs, labels = [], []
    for i in range(260):
        body = words(rng.randint(30, 150))
        if i % 13 == 1:
            body = body[:10] + items[i % 5][1].upper().split() + body[10:]
        if i % 11 == 2:
            body += ["write", "to", "jo.do@mail.example.com", "or", "+1 (743) 555-3824"]
        text = " ".join(body)
        if i % 7 == 3 and i > 20:
            text = docs[i - 10][1] + " " + rng.choice(vocabulary)
        if i % 5 == 4:
            text = " ".join(w + "$$$" for w in body)
        docs.append((i, text, "en", f"s{i % 3}", len(text), "extra"))
        labels.append((i, int(i % 5 != 4), 0))
    docs += [(1000, None, None, None, None, "e"), (1001, "", "en", "s", 0, "e"), (None, " ".join(words(40)), "en", "s", 1, "e"), (0, docs[0][1], "en", "s", 1, "e")]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, items


def test_each_stage(spark, folder):
    path, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = []
    for name, function in corpus_pipeline.STAGES:
        out = stage(function(spark, docs, path))
        before, after = ([r.asDict() for r in x.collect()] for x in (docs, out))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == corpus_pipeline.COLUMNS
        kept.append((name, before, after))
        docs = out
    (_, before, after), near, clean, private, encoded = kept
    ids = lambda rows: sorted((r["doc_id"] for r in rows), key=str)
    junk = {i for i in range(260) if i % 5 == 4}
    assert {None, 1000} <= {r["doc_id"] for r in after if r["text"] is None or r["doc_id"] is None}
    assert len(set(ids(after)) & junk) <= 2 and len({i for i in range(260)} - junk - set(ids(after))) <= 2
    _, before, after = near
    rows = [(r["doc_id"], r["text"]) for r in before if r["doc_id"] is not None]
    once = list(dict(rows).items())
    want = [d for d, _, _, k in minhash.brute_force(once, 5, 80, 100) if k]
    assert set(ids(after)) - {None} == set(want)
    _, before, after = clean
    want = [d for d, _, hit, *_ in decontam.brute_force([(r["doc_id"], r["text"]) for r in before], items, 10) if not hit]
    assert ids(after) == sorted(want, key=str) and len(after) < len(before)
    _, before, after = private
    texts = {r["doc_id"]: r["text"] for r in before}
    changed = 0
    for r in after:
        assert r["text"] == (pii.replace(texts[r["doc_id"]], pii.Pseudonyms(pii.key_of(spark)))[0] if texts[r["doc_id"]] else texts[r["doc_id"]])
        if texts[r["doc_id"]] and "+1 (743) 555-3824" in texts[r["doc_id"]]:
            assert re.fullmatch(re.escape(texts[r["doc_id"]]).replace(re.escape("jo.do@"), r"[a-z]{2}\.[a-z]{2}@").replace(re.escape("+1 (743) 555-3824"), r"\+1\ \(\d{3}\)\ \d{3}\-\d{4}"), r["text"])
        assert "743) 555" not in (r["text"] or "") and "jo.do@" not in (r["text"] or "")
        changed += r["text"] != texts[r["doc_id"]]
    assert changed > 5 and len(after) == len(before)
    ranks = bpe.parse_ranks(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    _, before, after = encoded
    texts = {r["doc_id"]: r["text"] for r in before}
    assert ids(after) == ids(before)
    for r in after:
        text = texts[r["doc_id"]] or ""
        assert r["n_tokens"] == len(library.encode_ordinary(text)) and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder[0]).count() > 100


def test_empty_tables(spark, folder, tmp_path):
    path, items = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and "ids_sha256" in out.columns


def test_near_dedup_does_not_move_texts(spark, folder):
    """Texts were shuffled and sorted to drop a few ids."""
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # the table of ids is small enough here for any join
    try:
        plan = out.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange hashpartitioning" not in plan and "LeftAnti" in plan
