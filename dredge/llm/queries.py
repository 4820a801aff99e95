"""The registered queries of the corpus operators, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dredge.llm import decontamination, fingerprints, html_extraction, language_id, near_dedup, packing, substring_dedup, suffix_dedup, toxicity, warc
from dredge.llm.common import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file; every executor has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.measure(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.measure(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.measure(table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.measure(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.measure(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_substring_dedup, op2_decontamination, op3_suffix_dedup, op4_fingerprints, op5_toxicity, op6_warc, op7_near_dedup, op8_html_extraction, op9_language_id, op10_packing)
    return {f.__name__: f for f in every}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP1_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS l FROM documents),
  g AS (SELECT doc_id, i, array_to_string(l[i:i + 12], ' ') AS s FROM (SELECT doc_id, l, unnest(range(1, len(l) - 11)) AS i FROM w)),
  m AS (SELECT s, min(doc_id) AS d FROM g GROUP BY s),
  h AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT doc_id, i FROM g JOIN m USING (s) WHERE d < doc_id), range(13) r(k)),
  e AS (SELECT doc_id, l[i] AS word, i FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM w)),
  k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM e ANTI JOIN h USING (doc_id, i) GROUP BY doc_id),
  n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id)
SELECT w.doc_id, len(l)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)"""

OP2_SQL = f"""
WITH b AS (SELECT item_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS l FROM benchmark),
  p AS (SELECT DISTINCT item_id, least(len(l), 13) AS n, array_to_string(l[i:i + least(len(l), 13) - 1], ' ') AS s FROM (SELECT item_id, l, unnest(range(1, greatest(len(l) - 11, 2))) AS i FROM b WHERE len(l) > 0)),
  w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS l FROM documents),
  g AS (SELECT doc_id, n, i, array_to_string(l[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, l, n, unnest(range(1, len(l) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM p))),
  f AS (SELECT doc_id, item_id, i, n FROM g JOIN p USING (n, s)),
  h AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM f, range(13) r(k) WHERE k < n GROUP BY doc_id),
  t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS items FROM f GROUP BY doc_id)
SELECT w.doc_id, len(l)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(l) AS contaminated FROM w LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""

OP3_SQL = """
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
  g AS (SELECT doc_id, i, t[i:i + 99] AS s FROM (SELECT doc_id, t, unnest(range(1, octet_length(t) - 98)) AS i FROM b)),
  m AS (SELECT s, min((doc_id, i)) AS f FROM g GROUP BY s HAVING count(*) > 1),
  h AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM g JOIN m USING (s) WHERE (doc_id, i) > f),
  k AS (SELECT doc_id, i, count(*) FILTER (before IS NULL OR i > before + 100) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM h),
  r AS (SELECT doc_id, n, min(i) AS a, max(i) + 99 AS z FROM k GROUP BY doc_id, n),
  e AS (SELECT doc_id, sum(z - a + 1)::BIGINT AS gone, count(*) AS spans, list_concat([0], list(z ORDER BY a)) AS ends, list(a ORDER BY a) AS starts FROM r GROUP BY doc_id)
SELECT doc_id, octet_length(t)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(CASE WHEN gone IS NULL THEN t ELSE list_reduce(list_transform(range(1, len(ends) + 1), lambda j: t[ends[j] + 1:coalesce(starts[j], octet_length(t) + 1) - 1]), lambda x, y: x || y) END) AS kept_sha256 FROM b LEFT JOIN e USING (doc_id)"""

OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), m AS (SELECT h, max(page_id) AS top FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN top > page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN top > page_id THEN top END AS refers_to FROM p LEFT JOIN m USING (h)"""

OP7_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_SPACED}) AS l FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(l[i:i + 3], ' ') AS x FROM (SELECT doc_id, l, unnest(range(1, greatest(len(l) - 2, 2))) AS i FROM w WHERE len(l) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
  e AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
  l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
  r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
  t AS (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id, least(w.doc_id, coalesce(m, w.doc_id)) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """SQL twins where SQL says the same; the other queries are held against brute force in the tests."""
    return {"op1_substring_dedup": OP1_SQL, "op2_decontamination": OP2_SQL, "op3_suffix_dedup": OP3_SQL, "op6_warc": OP6_SQL, "op7_near_dedup": OP7_SQL}
