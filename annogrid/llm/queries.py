"""The query of each corpus operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annogrid.llm import bpe, decontam, html_extract, langid, minhash, pii, quality, suffix_dedup, topk, warc
from annogrid.llm.common import read_table


OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + least(len(w), 3) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 3) + 2)) AS k FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
walk(node, far) AS (SELECT a, a FROM edges UNION SELECT w.node, e.b FROM walk w JOIN edges e ON w.far = e.a),
comps AS (SELECT node, min(far) AS c FROM walk GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN comps ON node = d.doc_id
"""

def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.pages_to_responses(read_table(spark, sf_dir, "pages"))).drop("record")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(read_table(spark, sf_dir, "documents"), depth=100)


OP2_SQL = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (SELECT doc_id, h, length(h) // 2 AS n FROM docs),
starts AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS win FROM (SELECT doc_id, h, n, unnest(range(0, n - 99)) AS p FROM sized WHERE n >= 100)),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY win ORDER BY doc_id, p) AS r FROM starts) WHERE r > 1),
edges AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS step FROM again),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM (SELECT *, count(*) FILTER (step IS NULL OR step > 100) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM edges) GROUP BY doc_id, g),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER w, 0) AS a, s.a AS b FROM spans s WINDOW w AS (PARTITION BY doc_id ORDER BY s.a)
  UNION ALL SELECT s.doc_id, coalesce(max(b), 0), any_value(n) FROM sized s LEFT JOIN spans USING (doc_id) GROUP BY s.doc_id),
kept AS (SELECT g.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS k FROM gaps g JOIN sized USING (doc_id) GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(n - length(k) // 2 AS BIGINT) AS n_removed, CAST((SELECT count(*) FROM spans x WHERE x.doc_id = sized.doc_id) AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM sized JOIN kept USING (doc_id)
"""


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(quality.fold_of("doc_id", 3) == 1, F.lit(False))
    net = langid.learn(docs, ~held_out)
    return langid.predict(docs, net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), width=3, num=85, den=100)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(read_table(spark, sf_dir, "documents"), pii.key_of(spark))


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), window=10)


OP6_SQL = """
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
items AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10 + 1, 1) + 1)) AS k FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
starts AS (
  SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM words CROSS JOIN sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, k, s.n, item_id FROM starts s JOIN windows v ON s.n = v.n AND s.win = v.win),
hits AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS j FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(quality.fold_of("doc_id", 4) == 2, F.lit(False))
    net = quality.learn(docs, read_table(spark, sf_dir, "labels"), ~held_out)
    return quality.score(docs, net, threshold=0.7).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


OP9_SQL = """
WITH usable AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND c.r <> q.r)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {
    "op1_warc": op1_warc,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_langid": op3_langid,
    "op4_minhash": op4_minhash,
    "op5_pii": op5_pii,
    "op6_decontam": op6_decontam,
    "op7_quality": op7_quality,
    "op8_html": op8_html,
    "op9_topk": op9_topk,
    "op10_bpe": op10_bpe,
}
ORACLES: dict[str, str] = {"op2_suffix_dedup": OP2_SQL, "op4_minhash": OP4_SQL, "op6_decontam": OP6_SQL, "op9_topk": OP9_SQL}
