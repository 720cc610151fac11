"""The corpus pipeline: five stages, each over all that the one before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annogrid.llm import bpe, decontam, minhash, pii, quality
from annogrid.llm.common import read_table, stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents that score less are rejected; the threshold of the classifier's own query.
LEAST_QUALITY = 0.7

def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject the documents that the quality classifier scores below LEAST_QUALITY; without a text there is nothing to reject."""
    net = quality.learn(docs, read_table(spark, sf_dir, "labels"), F.lit(True))
    return quality.score(docs, net, keep=COLUMNS, threshold=LEAST_QUALITY).where((F.col("predicted") == 1) | F.col("text").isNull()).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group whose shingles of five words are 0.8 alike: the one with the smallest id."""
    return minhash.without_near_duplicates(docs.select(*COLUMNS), width=5, num=80, den=100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents in which ten consecutive words of a benchmark item (or a shorter item) occur."""
    spans = decontam.find_spans(docs.select(*COLUMNS), read_table(spark, sf_dir, "benchmark"), window=10, keep=COLUMNS)
    return spans.where(F.size("spans") == 0).select(*COLUMNS)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal numbers, dates and addresses by pseudonyms of the same format."""
    done = pii.pseudonymise(docs, pii.key_of(spark), keep=[c for c in COLUMNS if c != "n_chars"])
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every text by the public vocabulary and decode it again."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("PII", pseudonymise),
    ("byte-level BPE encoding and decoding", encode),
]

#: SQL can express neither the networks nor the encoder; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
