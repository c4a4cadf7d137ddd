"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillstream.llm import decontaminate, html_text, ngram_join, outliers, quality, sentence_pieces, token_binary, token_counts, toxicity, warc
from quillstream.llm.common import table


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.verdicts(decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archives(table(spark, sf_dir, "pages")).drop("url", "html")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.quality_rules(table(spark, sf_dir, "documents"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_bradley_terry_quality": op1,
    "op2_benchmark_decontamination": op2,
    "op3_warc_zstd": op3,
    "op4_sentence_pieces": op4,
    "op5_token_counts": op5,
    "op6_html_extraction": op6,
    "op7_token_binary": op7,
    "op8_robust_outliers": op8,
    "op9_weak_toxicity": op9,
    "op10_ngram_jaccard": op10,
}

_FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Every window of every length that items have, looked up among the documents' runs of that length.
_OP2 = f"""
WITH d AS (SELECT doc_id, CASE WHEN text IS NULL THEN CAST([] AS VARCHAR[]) ELSE {_WORDS} END AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(list_slice(w, s, s + least(len(w), 13) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
run AS (SELECT doc_id, s, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT doc_id, s, run.k AS k, item_id FROM run JOIN win ON run.k = win.k AND run.g = win.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: Base32 of the digest: 5 bits from two hexadecimal digits each.
_OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT hex, min(page_id) AS first_id FROM p GROUP BY hex)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(hex || '0', CAST(floor(5 * i / 4) AS INTEGER) + 1, 2) AS INTEGER) >> (3 - (5 * i) % 4)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM p JOIN f USING (hex)
"""

#: All pairs of n-gram sets that share an n-gram, then the least id reachable over links.
_OP10 = f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, s, s + 4), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM w WHERE len(w) > 0)),
c AS (SELECT doc_id, string_agg(g, '|' ORDER BY g) AS key, count(*) AS n FROM g GROUP BY doc_id),
cls AS (SELECT key, min(doc_id) AS rep, count(*) AS copies, any_value(n) AS n FROM c GROUP BY key),
rg AS (SELECT g.doc_id AS rep, g.g FROM g JOIN cls ON g.doc_id = cls.rep),
common AS (SELECT x.rep AS a, y.rep AS b, count(*) AS k FROM rg x JOIN rg y ON x.g = y.g AND x.rep <> y.rep GROUP BY x.rep, y.rep),
link AS (SELECT a, b, cb.copies AS m FROM common JOIN cls ca ON ca.rep = a JOIN cls cb ON cb.rep = b WHERE 10 * k >= 8 * (ca.n + cb.n - k)),
reach(a, b) AS (SELECT rep, rep FROM cls UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
comp AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a),
deg AS (SELECT a, count(*) AS k, sum(m) AS m FROM link GROUP BY a)
SELECT w.doc_id, coalesce(cls.rep, w.doc_id) AS rep_id, coalesce(class_id, w.doc_id) AS class_id, coalesce(copies, 1) AS n_copies,
  CAST(coalesce(deg.m, 0) + coalesce(copies - 1, 0) AS BIGINT) AS n_links, coalesce(deg.k, 0) AS n_class_links
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN cls ON c.key = cls.key LEFT JOIN comp ON comp.a = cls.rep LEFT JOIN deg ON deg.a = cls.rep
"""

ORACLE: dict[str, str] = {
    "op2_benchmark_decontamination": _OP2,
    "op3_warc_zstd": _OP3,
    "op10_ngram_jaccard": _OP10,
}
