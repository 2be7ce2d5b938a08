"""The queries of this subpackage: each operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import best_fit, bottom_k, bpe_automaton, interpolated_lm, kd_shards, language_id, lz_fingerprint, personal_data, rotated_codes, url_rules
from millrace.llm.common import documents
from millrace.session import importable

#: Fixed values of the URL rules (host, path).
BLOCK = ["net/", "example.com/de/"]
ALLOW = ["example.net/en/", "org/fr/"]


def op1_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.fingerprints(documents(spark, sf_dir))


def op2_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards.shard(documents(spark, sf_dir))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return url_rules.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), BLOCK, ALLOW)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.detect(documents(spark, sf_dir))


def op6_bpe_automaton(spark: SparkSession, sf_dir: str, tokenizer_file: str | None = None) -> DataFrame:
    if tokenizer_file is None:
        import public_tokenizers

        tokenizer_file = public_tokenizers.path("word_bpe_49k.json")
    return bpe_automaton.encode_decode(documents(spark, sf_dir), tokenizer_file)


def op7_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return rotated_codes.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated_lm.score(documents(spark, sf_dir))


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(documents(spark, sf_dir))


def op10_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottom_k.near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op3_url_rules": OP3, "op7_rotated_codes": OP7, "op10_bottom_k": OP10}


OP3 = """
WITH rules(verdict, rule, host, path) AS (VALUES
  ('block', 'net/', 'net', '/'), ('block', 'example.com/de/', 'example.com', '/de/'),
  ('allow', 'example.net/en/', 'example.net', '/en/'), ('allow', 'org/fr/', 'org', '/fr/')),
parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS n FROM parts),
hit AS (
  SELECT c.*, r.rule, r.verdict,
         row_number() OVER (PARTITION BY c.n ORDER BY length(r.rule) DESC, length(r.host) DESC, r.verdict DESC) AS k
  FROM cut c LEFT JOIN rules r ON (c.host = r.host OR ends_with(c.host, '.' || r.host)) AND starts_with(c.path, r.path))
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(verdict, 'allow') AS verdict FROM hit WHERE k = 1
"""

OP7 = """
WITH rows AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_reduce(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]), lambda a, b: a + b) AS score
  FROM rows q JOIN rows c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""

OP10 = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT e.b AS a, r.c FROM reach r JOIN edges e ON e.a = r.a WHERE r.c < e.b),
low AS (SELECT a, min(c) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, low.c AS component_id, low.c = d.doc_id AS kept
FROM documents d JOIN low ON low.a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""
