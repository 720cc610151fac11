import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from annogrid.llm import bpe

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DATA = open(VOCABULARY, "rb").read()
RANKS = bpe.parse_ranks(DATA)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODER = bpe.TextCoder(DATA, public_tokenizers.PATTERN)
ALPHABETS = ["ab", "aab ", "the ing", "éèà e", "\n \t", "0123 a", "!@#$ ", "zß人a", "don't we'll "]


def ids(text):
    return np.frombuffer(CODER.encode(text), "<u4").tolist()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_same_as_library(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)
    assert CODER.decode(CODER.encode(text)) == text.encode()


def test_same_as_library_on_narrow_alphabets():
    rng = random.Random(5)
    for _ in range(1500):
        text = "".join(rng.choice(rng.choice(ALPHABETS)) for _ in range(rng.randint(0, 50)))
        assert ids(text) == LIBRARY.encode_ordinary(text)
    for text in ("a" * 5000, "ab" * 3000, " " * 300, "é" * 700 + "x"):
        assert ids(text) == LIBRARY.encode_ordinary(text)


def test_table_appends_cuts_and_edits():
    rng = random.Random(7)
    encoder = CODER.encoder
    for _ in range(100):
        table, data = bpe.PrefixTable(encoder), b""
        for _ in range(8):
            more = "".join(rng.choice("theingabé ") for _ in range(rng.randint(0, 9))).encode()
            if rng.random() < 0.5:
                table.append(more)
                data += more
            else:
                start = rng.randint(0, len(data))
                end = rng.randint(start, len(data))
                table.edit(start, end, more)
                data = data[:start] + more + data[end:]
            fresh = bpe.PrefixTable(encoder, data)
            assert table.ids() == fresh.ids() and encoder.decode(table.ids()) == data
            assert table.ids(len(data) // 2) == bpe.PrefixTable(encoder, data[: len(data) // 2]).ids()


def test_text_appends_and_edits():
    rng = random.Random(9)
    for _ in range(150):
        text = "".join(rng.choice(rng.choice(ALPHABETS)) for _ in range(rng.randint(0, 40)))
        kept = bpe.EncodedText(CODER.encoder, public_tokenizers.PATTERN, text)
        for _ in range(5):
            start = rng.randint(0, len(text))
            end = rng.randint(start, min(len(text), start + 6))
            new = "".join(rng.choice(rng.choice(ALPHABETS)) for _ in range(rng.randint(0, 6)))
            kept.edit(start, end, new)
            text = text[:start] + new + text[end:]
            assert kept.ids() == LIBRARY.encode_ordinary(text), (text, new)
    long = bpe.EncodedText(CODER.encoder, public_tokenizers.PATTERN, "some words here " * 500)
    long.edit(4000, 4003, "xyz")
    assert long.recoded < 12


def test_documents(spark):
    rows = [(1, "Hello there", "x"), (2, None, "y"), (3, "", None), (1, "Hello there", "x"), (None, "zß人 " * 3000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = bpe.encode_documents(docs, VOCABULARY, public_tokenizers.PATTERN, with_ids=True).collect()
    assert len(out) == 5
    for row in out:
        text = {1: "Hello there", 2: "", 3: "", None: "zß人 " * 3000}[row.doc_id]
        want = np.array(LIBRARY.encode_ordinary(text), "<u4").tobytes()
        assert bytes(row.ids) == want and row.n_tokens == len(want) // 4
        assert row.ids_sha256 == hashlib.sha256(want).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and bytes(row.decoded) == text.encode()
    assert bpe.encode_documents(docs.limit(0), VOCABULARY, public_tokenizers.PATTERN).count() == 0


def test_large_vocabularies_are_refused(spark, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_VOCABULARY_BYTES", 10)
    with pytest.raises(ValueError):
        bpe.encode_documents(spark.createDataFrame([(1, "a")], "doc_id long, text string"), VOCABULARY, public_tokenizers.PATTERN)
