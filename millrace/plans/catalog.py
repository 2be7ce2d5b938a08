"""Registry of the reference-parity queries: name, builder over whole tables, and the DuckDB text of the same rows.

A query is declared by ``@query(sql)``; without SQL it is checked by the tests' brute-force versions instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import ids, spans, text
from millrace.operators import audit, citations, claims, dedup, evaluation, expansion, gates, graph, lineage, registry, retrieval, sampling, stats
from millrace.session import checkpoint_dir, importable, small_batches
from millrace.sources import html, sinks
from millrace.streaming import ingest

FLAGSHIP = "hybrid_rrf_topk"
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable(spark)
            small_batches(spark)
            return f(Tables(spark, sf_dir))

        _QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


class Tables:
    """The tables of one folder as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---- identifiers, splits, text -------------------------------------------------------------------------------


@query("SELECT doc_id, substring(sha256(to_json([doc_id::VARCHAR, source])::VARCHAR), 1, 20) AS stable_id FROM documents")
def stable_ids(t):
    return t.documents.select("doc_id", ids.stable_id("doc_id", "source").alias("stable_id"))


@query("""SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || '}') AS identity FROM documents""")
def identity_hashes(t):
    return t.documents.select("doc_id", ids.identity_hash(n_chars=F.col("n_chars"), doc_id=F.col("doc_id"), lang=F.col("lang")).alias("identity"))


@query("SELECT doc_id, round(('0x' || substring(sha256('s:' || doc_id), 1, 16))::UBIGINT::DOUBLE / 1.8446744073709552e19, 9) AS unit FROM documents")
def unit_hash(t):
    return t.documents.select("doc_id", F.round(ids.unit_interval(F.col("doc_id").cast("string"), "s"), 9).alias("unit"))


_SPLIT = """
WITH r AS (SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY substring(sha256(to_json([doc_id::VARCHAR, '42'])::VARCHAR), 1, 20), doc_id) - 1) % 10 AS m FROM documents)
SELECT doc_id, lang, CASE WHEN m < 7 THEN 'train' WHEN m < 9 THEN 'dev' ELSE 'test' END AS split FROM r"""


@query(_SPLIT)
def stratified_split(t):
    return sampling.stratified_split(t.documents.select("doc_id", "lang"), "doc_id", ["lang"], "42")


@query("SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) % 7)::INTEGER AS shard FROM documents")
def stride_shard(t):
    return sampling.stride_shard(t.documents.select("doc_id"), "doc_id", 7)


@query("""SELECT 'quality' AS filter, d.doc_id, l.doc_id IS NOT NULL AND l.quality = 1 AND n_chars >= 80 AS kept,
CASE WHEN l.doc_id IS NULL THEN 'unlabelled' WHEN l.quality <> 1 THEN 'low_quality' WHEN n_chars < 80 THEN 'too_short' END AS reason
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def filter_manifest(t):
    return _quality(t).manifest("doc_id")


def _quality(t):
    d = t.documents.join(t.labels, "doc_id", "left")
    return audit.filter_audit(d, "quality", ("unlabelled", F.col("quality").isNull()), ("low_quality", F.col("quality") != 1), ("too_short", F.col("n_chars") < 80))


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'unlabelled' WHEN l.quality <> 1 THEN 'low_quality' WHEN n_chars < 80 THEN 'too_short' END AS reason
FROM documents d LEFT JOIN labels l USING (doc_id)) WHERE reason IS NOT NULL GROUP BY reason""")
def filter_reason_counts(t):
    return _quality(t).counts()


@query("""SELECT 'quality' AS filter, count(*) AS n_in, count(*) FILTER (quality = 1 AND n_chars >= 80) AS n_kept,
count(*) - count(*) FILTER (quality = 1 AND n_chars >= 80) AS n_dropped FROM documents LEFT JOIN labels USING (doc_id)""")
def filter_rollup(t):
    return _quality(t).rollup()


@query("""SELECT doc_id, lower(trim(lang)) IN ('en', 'de') AS kept, CASE WHEN lower(trim(lang)) IN ('en', 'de') THEN NULL ELSE 'category_not_allowed' END AS reason FROM documents""")
def category_filter(t):
    return audit.by_category(t.documents, F.col("lang"), ["en", "de"]).decided.select("doc_id", "kept", "reason")


@query(r"SELECT doc_id, nullif(regexp_replace(nfc_normalize(text), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '') AS norm FROM documents")
def null_text_normalise(t):
    return t.documents.select("doc_id", text.optional_text(F.col("text")).alias("norm"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(replace(lower(nfc_normalize(translate(text, '’‘ʼ', ''''''''))), 'ß', 'ss'), '[\s\p{Z}]+', ' ', 'g'))) AS h FROM documents")
def dedup_keys(t):
    return t.documents.select("doc_id", F.sha2(text.dedup_key(F.col("text")), 256).alias("h"))


@query(r"SELECT p_partkey, array_to_string(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+'), ' ') AS label FROM part")
def label_keys(t):
    return t.part.select("p_partkey", text.label_key(F.concat_ws(" ", "p_name", "p_type")).alias("label"))


@query(r"""SELECT page_id, lower(regexp_replace(regexp_replace(replace(trim(url), '\', '/'), '/+', '/', 'g'), '/$', '')) AS path,
list_last(string_split(lower(regexp_replace(regexp_replace(replace(trim(url), '\', '/'), '/+', '/', 'g'), '/$', '')), '/')) AS base FROM pages""")
def path_keys(t):
    return t.pages.select("page_id", text.path_key(F.col("url")).alias("path"), text.basename(F.col("url")).alias("base"))


@query(r"""SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM documents)""")
def token_counts(t):
    k = text.tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(k).cast("long").alias("n_tokens"), F.size(F.array_distinct(k)).cast("long").alias("n_distinct"))


@query(r"""SELECT doc_id, array_to_string(list_transform(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: w NOT IN ('a', 'an', 'and', 'for', 'of', 'the', 'to')), lambda w: substring(w, 1, 1)), '') AS initials FROM documents""")
def acronym_initials(t):
    return t.documents.select("doc_id", text.initials(F.col("text")).alias("initials"))


@query(r"""SELECT doc_id, CASE WHEN l AND g THEN 'mixed' WHEN l THEN 'latin' WHEN g THEN 'greek' ELSE 'unknown' END AS script
FROM (SELECT doc_id, regexp_matches(text, '[A-Za-z\x{00C0}-\x{024F}]') AS l, regexp_matches(text, '[\x{0370}-\x{03FF}]') AS g FROM documents)""")
def script_buckets(t):
    return t.documents.select("doc_id", text.script_bucket(F.col("text")).alias("script"))


@query("""WITH m(a, l) AS (VALUES ('en', 'en'), ('fr', 'fr'), ('de', 'de'), ('es', 'es'), ('pt', 'pt'), ('it', 'it'), ('ru', 'ru'), ('zh', 'zh'), ('ja', 'ja'), ('ko', 'ko'), ('hi', 'hi'), ('ta', 'ta'))
SELECT doc_id, x.l AS label, x.l = 'en' AS is_english FROM documents LEFT JOIN m x ON x.a = lower(trim(lang))""")
def language_labels(t):
    return t.documents.select("doc_id", text.language_label(F.col("lang")).alias("label"), text.language_match(F.col("lang"), F.lit("English")).alias("is_english"))


@query(r"""WITH c AS (SELECT conv_id, turn, text || ' [E' || (turn + 1) || '] and [E' || (conv_id % 7) || '].' AS x FROM conversations)
SELECT conv_id, turn, array_to_string(regexp_extract_all(x, '\[(E[1-9][0-9]*)\]', 1), ',') AS cited FROM c""")
def citation_tokens(t):
    x = F.concat("text", F.lit(" [E"), F.col("turn") + 1, F.lit("] and [E"), F.col("conv_id") % 7, F.lit("]."))
    return t.conversations.select("conv_id", "turn", F.array_join(text.citations(x), ",").alias("cited"))


@query("""SELECT conv_id, turn, ['complete', 'closing_only', 'truncated', 'none'][(conv_id + turn) % 4 + 1] AS thinking_state,
CASE WHEN (conv_id + turn) % 4 = 3 THEN '' ELSE 'plan ' || turn END AS reasoning, CASE WHEN (conv_id + turn) % 4 = 2 THEN '' ELSE role END AS visible FROM conversations""")
def think_split(t):
    k = (F.col("conv_id") + F.col("turn")) % 4
    plan = F.concat(F.lit("plan "), "turn")
    raw = F.when(k == 0, F.concat(F.lit("<think> "), plan, F.lit(" </think> "), "role")).when(k == 1, F.concat(plan, F.lit(" </think> "), "role")).when(k == 2, F.concat(F.lit("<think> "), plan)).otherwise(F.col("role"))
    return t.conversations.select("conv_id", "turn", *[c.alias(n) for n, c in text.think_split(raw).items()])


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, event_type || ':' || json_extract_string(props, '$.k') AS label FROM events")
def json_fields(t):
    p = F.from_json("props", "k long")
    return t.events.select("event_id", p["k"].alias("k"), F.concat_ws(":", "event_type", p["k"].cast("string")).alias("label"))


@query("SELECT conv_id, turn, (conv_id + turn) % 4 < 2 AS abstains FROM conversations")
def safe_abstentions(t):
    k = (F.col("conv_id") + F.col("turn")) % 4
    cited = F.concat(F.lit(text.ABSTENTIONS[0]), F.lit(" [E"), F.col("turn") + 1, F.lit("]"))
    said = F.when(k == 0, F.lit("  I cannot verify  this from the available evidence!! ")).when(k == 1, F.lit(text.ABSTENTIONS[2])).when(k == 2, cited).otherwise(F.col("role"))
    return t.conversations.select("conv_id", "turn", text.safe_abstention(said).alias("abstains"))


@query("SELECT event_id, round(1 / (1 + exp(-(value - 10))), 9) AS p FROM events")
def sigmoid_scores(t):
    return t.events.select("event_id", F.round(text.sigmoid(F.col("value") - 10), 9).alias("p"))


@query("""WITH s AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'x' WHEN 2 THEN 'Infinity' WHEN 3 THEN ' ' ELSE value::VARCHAR END AS raw FROM events)
SELECT event_id, ['missing', 'invalid', 'nonfinite', 'missing', 'valid'][event_id % 5 + 1] AS status FROM s""")
def score_statuses(t):
    k = F.col("event_id") % 5
    raw = F.when(k == 1, "x").when(k == 2, "Infinity").when(k == 3, " ").when(k == 4, F.col("value").cast("string"))
    return t.events.select("event_id", text.score_status(raw).alias("status"))


# ---- retrieval -----------------------------------------------------------------------------------------------

_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_BM25 = f"""
d AS MATERIALIZED (SELECT doc_id, {_TOK} AS t FROM documents),
p AS MATERIALIZED (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d),
tf AS MATERIALIZED (SELECT doc_id, dl, term, count(*) AS tf FROM p GROUP BY ALL),
q AS (SELECT item_id, unnest(list_distinct({_TOK})) AS term FROM benchmark),
n AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
idf0 AS (SELECT term, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM tf, n GROUP BY term, n),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM idf0) ELSE raw END AS idf FROM idf0),
bm AS (SELECT item_id AS query_id, doc_id AS candidate_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM q JOIN idf USING (term) JOIN tf USING (term), n GROUP BY 1, 2)"""
_TOP = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id)"


def _lexical(t):
    return retrieval.lexical_top(t.documents, "doc_id", "text", t.benchmark, "item_id", "text", 12).withColumn("score", F.round("score", 9))


@query(f"WITH {_BM25}, b2 AS (SELECT query_id, candidate_id, round(score, 9) AS score FROM bm), r AS (SELECT *, {_TOP} AS rank FROM b2) SELECT query_id, candidate_id, round(score, 6) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 12 AND score > 0")
def bm25_topk(t):
    return retrieval.top_k(_lexical(t).where("branch = 'bm25'"), 12).where("score > 0").select("query_id", "candidate_id", F.round("score", 6).alias("score"), "rank")


_OVERLAP = f"""
qn AS (SELECT item_id, len(list_distinct({_TOK})) AS n FROM benchmark),
ov AS (SELECT q.item_id AS query_id, tf.doc_id AS candidate_id, round(count(*) / any_value(qn.n), 9) AS score FROM q JOIN tf USING (term) JOIN qn ON qn.item_id = q.item_id GROUP BY 1, 2)"""
_HITS = f"""b2 AS (SELECT query_id, candidate_id, round(score, 9) AS score FROM bm),
hits AS (SELECT * FROM (SELECT 'bm25' AS branch, query_id, candidate_id, score, {_TOP} AS rank FROM b2) WHERE rank <= 12 AND score > 0
  UNION ALL SELECT * FROM (SELECT 'overlap' AS branch, query_id, candidate_id, score, {_TOP} AS rank FROM ov) WHERE rank <= 12)"""
_FUSED = "fused AS (SELECT query_id, candidate_id, sum(CASE branch WHEN 'bm25' THEN 1.0 ELSE 1.1 END / (60 + rank)) AS rrf, string_agg(branch, ',' ORDER BY branch) AS branches FROM hits GROUP BY 1, 2)"


def _hits(t):
    w = Window.partitionBy("branch", "query_id").orderBy(F.desc("score"), "candidate_id")
    hits = _lexical(t).withColumn("rank", F.row_number().over(w)).where("rank <= 12")
    return hits.where("branch = 'overlap' OR score > 0")


def _fused(t):
    return retrieval.reciprocal_rank_fusion(_hits(t), {"bm25": 1.0, "overlap": 1.1})


@query(f"""WITH {_BM25}, {_OVERLAP}, {_HITS}, {_FUSED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, candidate_id) AS rank FROM fused)
SELECT query_id, candidate_id, round(rrf, 9) AS rrf_score, branches, rank::INTEGER AS rank FROM r WHERE rank <= 5""")
def hybrid_rrf_topk(t):
    f = _fused(t).withColumn("rrf_score", F.round("rrf_score", 12))
    f = f.withColumn("branches", F.array_join(F.transform("traces", lambda x: x["branch"]), ","))
    top = retrieval.top_k(f, 5, "rrf_score")
    return top.select("query_id", "candidate_id", F.round("rrf_score", 9).alias("rrf_score"), "branches", "rank")


@query(f"""WITH {_BM25}, {_OVERLAP}, {_HITS}
SELECT query_id, branch, candidate_id, round(CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS normalized
FROM hits WINDOW w AS (PARTITION BY query_id, branch)""")
def minmax_by_branch(t):
    m = retrieval.min_max(_hits(t), "score", "query_id", "branch")
    return m.select("query_id", "branch", "candidate_id", F.round("normalized", 6).alias("normalized"))


_DENSE = """
e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS candidate_id, list_reduce(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]), lambda x, y: x + y) AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS rank FROM s)"""


@query(f"WITH {_DENSE} SELECT query_id, candidate_id, round(score, 6) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 12 AND score >= 0.25")
def dense_topk(t):
    e = t.embeddings
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return retrieval.dense(asked, e.select(F.col("vec_id").alias("candidate_id"), F.col("embedding").alias("v")), 12, 0.25).select("query_id", "candidate_id", F.round("score", 6).alias("score"), "rank")


_SELECT = f"""WITH {_DENSE}, p AS (SELECT query_id, candidate_id, round(1 / (1 + exp(-(10 * score - 3))), 9) AS probability FROM r WHERE rank <= 12),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY probability DESC, candidate_id) AS place FROM p)"""


@query(_SELECT + " SELECT query_id, candidate_id, round(probability, 6) AS probability, probability >= 0.55 AND place <= 5 AS selected, CASE WHEN probability < 0.55 THEN 'below_floor' WHEN place > 5 THEN 'over_limit' ELSE 'selected' END AS reason FROM k")
def evidence_select(t):
    return _selected(t).select("query_id", "candidate_id", F.round(F.round("probability", 9), 6).alias("probability"), "selected", "reason")


def _selected(t):
    e = t.embeddings
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    top = retrieval.dense(asked, e.select(F.col("vec_id").alias("candidate_id"), F.col("embedding").alias("v")), 12, -1.0)
    return retrieval.select_evidence(top.withColumn("logit", 10 * F.col("score") - 3), 0.55, 5)


@query(_SELECT + " SELECT query_id, 'no_candidate_above_floor' AS reason FROM k GROUP BY query_id HAVING count(*) FILTER (probability >= 0.55 AND place <= 5) = 0")
def evidence_abstentions(t):
    return retrieval.abstentions(_selected(t))


@query("""WITH a AS (SELECT o_custkey AS q, o_orderkey AS c FROM orders WHERE o_orderstatus = 'O'), b AS (SELECT o_custkey AS q, o_orderkey AS c FROM orders WHERE o_totalprice > 100000),
u AS (SELECT coalesce(a.q, b.q) AS q, (a.c IS NOT NULL)::INT AS x, (b.c IS NOT NULL)::INT AS y FROM a FULL JOIN b ON a.q = b.q AND a.c = b.c)
SELECT q AS query_id, count(*) AS universe, sum(x * y)::BIGINT AS shared, sum(x * (1 - y))::BIGINT AS gained, sum((1 - x) * y)::BIGINT AS lost FROM u GROUP BY q""")
def paired_universe(t):
    o = t.orders.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("candidate_id"), "o_orderstatus", "o_totalprice")
    return retrieval.membership(o.where("o_orderstatus = 'O'"), o.where("o_totalprice > 100000"))


@query("""WITH u AS (SELECT l_orderkey, l_linenumber, l_extendedprice, sum(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS used FROM lineitem)
SELECT l_orderkey, l_linenumber, round(used, 4) AS used FROM u WHERE used <= 100000""")
def prefix_budget(t):
    return retrieval.prefix_budget(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "l_extendedprice", 100000).select("l_orderkey", "l_linenumber", F.round("used", 4).alias("used"))


# ---- graph ---------------------------------------------------------------------------------------------------

_EDGES = """
edges AS (SELECT 'S' || s_suppkey AS s, 'located_in' AS ty, 'N' || s_nationkey AS d FROM supplier
  UNION ALL SELECT 'C' || c_custkey, 'located_in', 'N' || c_nationkey FROM customer
  UNION ALL SELECT 'N' || n_nationkey, 'part_of', 'R' || n_regionkey FROM nation),
near AS (SELECT s, ty AS rel, d FROM edges UNION SELECT d, 'reverse:' || ty, s FROM edges)"""


def _edges(t):
    def e(df, s, key, kind, d, to):
        return df.select(F.concat(F.lit(s), key).alias("source_id"), F.lit(kind).alias("type"), F.concat(F.lit(d), to).alias("target_id"))

    return e(t.supplier, "S", "s_suppkey", "located_in", "N", "s_nationkey").unionAll(e(t.customer, "C", "c_custkey", "located_in", "N", "c_nationkey")).unionAll(e(t.nation, "N", "n_nationkey", "part_of", "R", "n_regionkey"))


def _nodes(t):
    e = _edges(t)
    return e.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()


@query(f"WITH {_EDGES} SELECT s AS src, rel AS relation, d AS dst FROM near")
def graph_adjacency(t):
    return graph.adjacency(_edges(t), _nodes(t))


_PATHS = f"""WITH {_EDGES}, seeds AS (SELECT r_regionkey AS query_id, 'R' || r_regionkey AS node FROM region),
p0 AS (SELECT query_id, node, 0 AS hop, [node] AS nodes, []::VARCHAR[] AS rels FROM seeds),
p1 AS (SELECT query_id, d AS node, 1 AS hop, list_append(nodes, d) AS nodes, list_append(rels, rel) AS rels FROM p0 JOIN near ON s = node WHERE NOT list_contains(nodes, d)),
p2 AS (SELECT query_id, d AS node, 2 AS hop, list_append(nodes, d) AS nodes, list_append(rels, rel) AS rels FROM p1 JOIN near ON s = node WHERE NOT list_contains(nodes, d)),
p AS (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2)"""


def _paths(t):
    seeds = t.region.select(F.col("r_regionkey").alias("query_id"), F.concat(F.lit("R"), "r_regionkey").alias("node"))
    return graph.expand(seeds, graph.adjacency(_edges(t), _nodes(t)), 2)


@query(_PATHS + " SELECT query_id, node, hop, array_to_string(nodes, '>') AS nodes, array_to_string(rels, '>') AS relations FROM p")
def graph_expand_2hop(t):
    return _paths(t).select("query_id", "node", "hop", F.array_join("nodes", ">").alias("nodes"), F.array_join("relations", ">").alias("relations"))


@query(_PATHS + " SELECT query_id, node, min(hop) AS hop, round(pow(0.7, min(hop)), 6) AS score, count(DISTINCT array_to_string(nodes, '>') || array_to_string(rels, '>')) AS n_paths FROM p GROUP BY 1, 2")
def graph_reach(t):
    return graph.reach(_paths(t), 0.7).withColumn("score", F.round("score", 6))


@query(f"WITH {_EDGES} SELECT id, count(*) AS degree FROM (SELECT s AS id FROM edges UNION ALL SELECT d FROM edges) GROUP BY id")
def degree(t):
    return graph.degree(_edges(t))


@query("SELECT o_custkey, o_orderkey AS source, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS target FROM orders QUALIFY target IS NOT NULL")
def claim_chain_pairs(t):
    return graph.claim_chain(t.orders, "o_custkey", "o_orderkey")


@query("""WITH i AS (SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::DOUBLE AS i FROM documents)
SELECT doc_id, source, round(10 * sqrt(i + 0.5) * cos(i * 2.399963229728653), 4) AS x, round(10 * sqrt(i + 0.5) * sin(i * 2.399963229728653), 4) AS y FROM i""")
def lineage_layout(t):
    return graph.sunflower(t.documents.select("doc_id", "source"), "source", "doc_id", 10.0).select("doc_id", "source", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(f"WITH {_EDGES} SELECT 'N' || n_nationkey AS id, round(least(16.0, 3 + 2.2 * log2(count(*) + 1)), 6) AS size FROM nation JOIN edges ON d = 'N' || n_nationkey GROUP BY 1")
def entity_sizes(t):
    n = _edges(t).where("type = 'located_in'").groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("n"))
    return n.select("id", F.round(graph.entity_size(F.col("n")), 6).alias("size"))


# ---- registry, catalog, dedup --------------------------------------------------------------------------------


@query("""SELECT 'DOC:' || substring(sha256(text), 1, 20) AS document_uid, min('d/' || doc_id) AS relative_path, count(*) AS copies,
string_agg('d/' || doc_id, ',' ORDER BY 'd/' || doc_id) AS paths FROM documents GROUP BY sha256(text)""")
def content_dedup_registry(t):
    files = t.documents.select(F.concat(F.lit("d/"), "doc_id").alias("relative_path"), F.sha2("text", 256).alias("content_sha256"))
    return registry.content_registry(files).select("document_uid", "relative_path", "copies", F.array_join("relative_paths", ",").alias("paths"))


@query("""WITH f AS (SELECT 'documents/' || source || '/' || doc_id || '.html' AS p, doc_id FROM documents)
SELECT p AS relative_path, doc_id AS ord, CASE doc_id % 3 WHEN 0 THEN 'hash' WHEN 1 THEN 'path' ELSE 'basename' END AS matched_by FROM f""")
def overlay_match(t):
    d = t.documents
    path = F.concat(F.lit("documents/"), "source", F.lit("/"), "doc_id", F.lit(".html"))
    files = d.select(path.alias("relative_path"), F.sha2(F.col("doc_id").cast("string"), 256).alias("content_sha256"))
    k = F.col("doc_id") % 3
    records = d.select(F.col("doc_id").alias("ord"), F.when(k == 0, F.sha2(F.col("doc_id").cast("string"), 256)).alias("sha256"), F.when(k == 1, F.concat("source", F.lit("/"), "doc_id", F.lit(".html"))).when(k == 2, F.concat(F.lit("other/"), "doc_id", F.lit(".html"))).alias("path"))
    return registry.overlay_match(files, records)


@query("""SELECT p_brand, min_by(p_type, (CASE WHEN p_type LIKE 'A%' THEN 0 WHEN p_type LIKE 'P%' THEN 1 ELSE 2 END, p_type)) AS p_type FROM part GROUP BY p_brand""")
def type_by_priority(t):
    p = t.part.withColumn("k", F.when(F.startswith("p_type", F.lit("A")), 0).when(F.startswith("p_type", F.lit("P")), 1).otherwise(2))
    return p.groupBy("p_brand").agg(F.min_by("p_type", F.struct("k", "p_type")).alias("p_type"))


@query()
def alias_catalog(t):
    rows = t.nation.select(F.lit("corpus").alias("namespace"), F.lit("place").alias("entity_type"), F.col("n_name").alias("label")).unionAll(t.region.select(F.lit("corpus"), F.lit("unknown"), "r_name")).unionAll(t.supplier.select(F.lit("target"), F.lit("organisation"), "s_name"))
    return registry.entity_catalog(rows).select("entity_id", "canonical_name", F.array_join("aliases", "|").alias("aliases"), "entity_type", "namespace", "ambiguous")


@query("""SELECT s_suppkey AS mention_id, row_number() OVER (PARTITION BY s_suppkey ORDER BY n_name)::INTEGER AS rank, n_nationkey AS entity_id, n_name AS canonical_name FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def candidate_lookup(t):
    cat = t.nation.select(F.col("n_nationkey").alias("entity_id"), F.col("n_name").alias("canonical_name"), F.lit("corpus").alias("namespace"), F.array(text.normalized(F.col("n_name"))).alias("aliases"))
    mentions = t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("mention_id"), F.upper("n_name").alias("text"))
    return registry.candidates(mentions, cat)


@query(r"""SELECT sha256(k) AS group_hash, min(doc_id) AS first_id, count(*) AS n FROM (SELECT doc_id, trim(regexp_replace(replace(lower(nfc_normalize(translate(text, '’‘ʼ', ''''''''))), 'ß', 'ss'), '[\s\p{Z}]+', ' ', 'g')) AS k FROM documents) GROUP BY 1""")
def exact_dup(t):
    return dedup.exact_groups(t.documents, "doc_id", "text")


@query(r"""SELECT count(*) AS n, count(DISTINCT k) AS n_distinct, count(*) - count(DISTINCT k) AS n_duplicates FROM (SELECT trim(regexp_replace(replace(lower(nfc_normalize(translate(text, '’‘ʼ', ''''''''))), 'ß', 'ss'), '[\s\p{Z}]+', ' ', 'g')) AS k FROM documents)""")
def duplicate_stats(t):
    return dedup.duplicate_statistics(t.documents, "text")


@query("""SELECT conv_id, turn FROM conversations a WHERE NOT EXISTS (SELECT 1 FROM conversations b WHERE a.conv_id = b.conv_id AND a.turn <> b.turn AND
((lower(a.text) = lower(b.text) AND b.turn < a.turn) OR (length(a.text) >= 40 AND length(b.text) > length(a.text) AND contains(lower(b.text), lower(a.text)))))""")
def contained_dedup(t):
    return dedup.contained(t.conversations, "conv_id", "turn", "text").select("conv_id", "turn")


@query()
def near_dup_pairs(t):
    return dedup.near_classes(t.documents, "doc_id", "text", 0.8).withColumn("score", F.round("score", 6))


# ---- pages, sentences, windows -------------------------------------------------------------------------------


@query()
def html_blocks(t):
    return html.block_table(t.pages)


@query()
def sentence_windows(t):
    return spans.window_table(t.documents, "doc_id", "text", 600)


@query(r"SELECT doc_id::VARCHAR AS key, length(regexp_replace(text, '[\s\p{Z}]', '', 'g')) AS n_solid, true AS holds FROM documents WHERE length(trim(text)) > 0")
def window_invariants(t):
    """Every window is the exact slice of its text, none too long, in order, without loss of non-blank text (n_solid characters)."""
    w = spans.window_table(t.documents, "doc_id", "text", 600).join(t.documents.select(F.col("doc_id").cast("string").alias("key"), F.col("text").alias("whole")), "key")
    order = Window.partitionBy("key").orderBy("chunk_index")
    w = w.withColumn("after", F.coalesce(F.lag("span_end").over(order), F.lit(0)) <= F.col("span_start"))
    ok = F.col("after") & (F.substr(F.col("whole"), F.col("span_start") + 1, F.col("span_end") - F.col("span_start")) == F.col("text")) & (F.length("text") <= 600)
    n = F.length(F.regexp_replace("text", r"(?U)\s", ""))
    g = w.groupBy("key").agg(F.bool_and(ok).alias("ok"), F.sum(n).alias("n"), F.max(F.length(F.regexp_replace("whole", r"(?U)\s", ""))).alias("m"))
    return g.select("key", F.col("n").alias("n_solid"), (F.col("ok") & (F.col("n") == F.col("m"))).alias("holds"))


@query("""WITH h AS (SELECT conv_id, turn, CASE WHEN length(text) < 200 THEN text END AS heading FROM conversations)
SELECT conv_id, turn, last_value(heading IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM h""")
def heading_carry(t):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return t.conversations.select("conv_id", "turn", F.last(F.when(F.length("text") < 200, F.col("text")), ignorenulls=True).over(w).alias("section"))


# ---- aggregates and statistics -------------------------------------------------------------------------------


@query("""SELECT lang, count(*) AS n, min(n_chars) AS min_len, max(n_chars) AS max_len, round(avg(n_chars), 6) AS mean_len, round(quantile_cont(n_chars, 0.25), 6) AS p25,
round(quantile_cont(n_chars, 0.5), 6) AS median, round(quantile_cont(n_chars, 0.75), 6) AS p75 FROM documents GROUP BY lang""")
def length_summary(t):
    s = stats.length_summary(t.documents, "n_chars", "lang")
    return s.select("lang", "n", "min_len", "max_len", *[F.round(c, 6).alias(c) for c in ("mean_len", "p25", "median", "p75")])


@query("""WITH m AS (SELECT event_type, CASE WHEN user_id % 9 = 0 THEN 'missing' ELSE 'scored' END AS status, value FROM events)
SELECT event_type, count(*) FILTER (status = 'scored') AS n_scored, round(avg(value) FILTER (status = 'scored'), 6) AS mean, count(*) AS n_rows FROM m GROUP BY 1""")
def metric_summary(t):
    m = t.events.select("event_type", F.when(F.col("user_id") % 9 == 0, "missing").otherwise("scored").alias("status"), "value")
    return stats.metric_summary(m, "event_type").withColumn("mean", F.round("mean", 6))


@query("SELECT event_type, string_agg(status || '=' || n, ',' ORDER BY status) AS counts FROM (SELECT event_type, CASE WHEN user_id % 9 = 0 THEN 'missing' ELSE 'scored' END AS status, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def status_counts(t):
    m = t.events.select("event_type", F.when(F.col("user_id") % 9 == 0, "missing").otherwise("scored").alias("status"))
    c = stats.count_map(m, ["event_type"], "status", "counts")
    return c.select("event_type", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("counts"))


_METRIC = "m AS (SELECT user_id AS id, event_type AS variant, round(avg(value), 9) AS v FROM events GROUP BY 1, 2)"
_PAIRS = f"{_METRIC}, w AS (SELECT id, max(v) FILTER (variant = 'click') AS a, max(v) FILTER (variant = 'view') AS b FROM m GROUP BY id), p AS (SELECT * FROM w WHERE a IS NOT NULL AND b IS NOT NULL)"


def _metric(t):
    return t.events.groupBy(F.col("user_id").alias("id"), F.col("event_type").alias("variant")).agg(F.round(F.avg("value"), 9).alias("v"))


@query(f"WITH {_PAIRS} SELECT count(*) AS n, round(avg(a - b), 6) AS mean_difference, round(avg((a - b > 1e-12)::INT), 6) AS win_rate, round(avg((abs(a - b) <= 1e-12)::INT), 6) AS tie_rate, round(avg((a - b < -1e-12)::INT), 6) AS loss_rate FROM p")
def paired_stats(t):
    s = stats.paired_summary(stats.paired(_metric(t), "id", "variant", "v", "click", "view"))
    return s.select("n", *[F.round(c, 6).alias(c) for c in s.columns[1:]])


@query("""WITH d AS (SELECT l_orderkey AS g, l_extendedprice - 35000 AS d, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
m AS (SELECT d.g, n, mask, sum(CASE WHEN (mask >> i) & 1 = 1 THEN -d ELSE d END) AS s, sum(d) AS seen FROM d, LATERAL (SELECT unnest(range(0, (1 << n)::BIGINT)) AS mask) GROUP BY 1, 2, 3)
SELECT g AS l_orderkey, n::INTEGER AS n, round(avg((abs(s) >= abs(seen) - 1e-6)::INT), 6) AS p_value FROM m GROUP BY 1, 2""")
def paired_exact_p(t):
    d = t.lineitem.select("l_orderkey", (F.col("l_extendedprice") - 35000).alias("d"))
    return stats.sign_permutation(d, "l_orderkey", "d", 1e-6).withColumn("p_value", F.round("p_value", 6))


@query("""WITH p AS (SELECT user_id, least(1.0, round(avg(value) / 40, 9)) AS p FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p, user_id) AS r, count(*) OVER () AS m FROM p)
SELECT user_id, round(least(1.0, min(p * m / r) OVER (ORDER BY p, user_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q_value FROM r""")
def bh_qvalues(t):
    p = t.events.groupBy("user_id").agg(F.least(F.lit(1.0), F.round(F.avg("value") / 40, 9)).alias("p"))
    return stats.benjamini_hochberg(p, "p", "user_id").select("user_id", F.round("q_value", 6).alias("q_value"))


@query("""WITH c AS (SELECT quality AS a, toxic AS b, count(*)::DOUBLE AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1, 2), x AS (SELECT a, sum(n) AS x FROM c GROUP BY a), y AS (SELECT b, sum(n) AS y FROM c GROUP BY b)
SELECT (SELECT sum(n) FROM c)::BIGINT AS n, round(1 - (SELECT sum(abs(a - b) * n) FROM c) * (SELECT sum(n) FROM c) / (SELECT sum(abs(a - b) * x * y) FROM x, y), 6) AS kappa""")
def weighted_kappa(t):
    return stats.weighted_kappa(t.labels, "quality", "toxic").withColumn("kappa", F.round("kappa", 6))


@query("""WITH r AS (SELECT doc_id AS u, quality::DOUBLE AS s FROM labels UNION ALL SELECT doc_id, toxic FROM labels), g AS (SELECT u, count(*)::DOUBLE AS m, sum(s) AS s, sum(s * s) AS q FROM r GROUP BY u HAVING count(*) > 1)
SELECT count(*) AS n_units, round(1 - sum(2 * (m * q - s * s) / (m - 1)) * (sum(m) - 1) / (2 * (sum(m) * sum(q) - sum(s) * sum(s))), 6) AS alpha FROM g""")
def ordinal_alpha(t):
    r = t.labels.select("doc_id", F.explode(F.array(F.struct(F.lit("quality").alias("rater"), F.col("quality").alias("score")), F.struct(F.lit("toxic").alias("rater"), F.col("toxic").alias("score")))).alias("x")).select("doc_id", "x.*")
    return stats.ordinal_alpha(r, "doc_id", "rater", "score").withColumn("alpha", F.round("alpha", 6))


@query("""WITH v AS (SELECT l_linenumber AS id, l_returnflag AS variant, round(avg(l_quantity), 6) AS quantity, round(avg(l_discount), 6) AS discount, round(avg(l_tax), 6) AS tax FROM lineitem GROUP BY 1, 2),
l AS (UNPIVOT v ON quantity, discount, tax INTO NAME metric VALUE x), c(a, b) AS (VALUES ('R', 'A'), ('R', 'N'), ('A', 'N')),
p AS (SELECT c.a || '_vs_' || c.b AS comparison, l.metric, CASE WHEN l.metric = 'tax' THEN r.x - l.x ELSE l.x - r.x END AS d, row_number() OVER (PARTITION BY c.a, c.b, l.metric ORDER BY l.id) - 1 AS i
FROM c JOIN l ON l.variant = c.a JOIN l r ON r.variant = c.b AND r.metric = l.metric AND r.id = l.id),
g AS (SELECT comparison, metric, count(*) AS n, avg(d) AS mean_difference, avg((d > 1e-12)::INT) AS win_rate, abs(sum(d)) AS seen FROM p GROUP BY 1, 2),
m AS (SELECT comparison, metric, mask, abs(sum(CASE WHEN (mask >> i) & 1 = 1 THEN -d ELSE d END)) AS s FROM p, (SELECT unnest(range(0, 128)) AS mask) GROUP BY 1, 2, 3),
t AS (SELECT g.comparison, g.metric, n, mean_difference, win_rate, avg((s >= seen - 1e-12)::INT) AS p FROM g JOIN m USING (comparison, metric) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (ORDER BY p, comparison, metric) AS r, count(*) OVER () AS k FROM t)
SELECT comparison, metric, CASE WHEN metric = 'tax' THEN 'lower' ELSE 'higher' END AS direction, n::INTEGER AS n, round(mean_difference, 6) AS mean_difference, round(win_rate, 6) AS win_rate, round(p, 6) AS p_value,
round(least(1.0, min(p * k / r) OVER (ORDER BY p, comparison, metric ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q_value FROM r""")
def metric_family(t):
    mean = {n: F.round(F.avg(f"l_{n}"), 6).alias(n) for n in ("quantity", "discount", "tax")}
    v = t.lineitem.groupBy(F.col("l_linenumber").alias("id"), F.col("l_returnflag").alias("variant")).agg(*mean.values())
    f = stats.metric_family(v, "id", "variant", list(mean), [("R", "A"), ("R", "N"), ("A", "N")], ["tax"])
    return f.select("comparison", "metric", "direction", "n", *[F.round(c, 6).alias(c) for c in ("mean_difference", "win_rate", "p_value", "q_value")])


_RATINGS = "r AS (SELECT doc_id AS u, 'quality' AS r, quality AS s FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels UNION ALL SELECT doc_id, 'third', CASE WHEN doc_id % 5 > 0 THEN quality * (doc_id % 3) END FROM labels)"


@query(f"""WITH {_RATINGS}, o AS (SELECT u, r, s::DOUBLE AS s FROM r WHERE s IS NOT NULL),
g AS (SELECT u, count(*)::DOUBLE AS m, sum(s) AS s, sum(s * s) AS q FROM o GROUP BY u HAVING count(*) > 1),
alpha AS (SELECT count(*) AS overlap, 1 - sum(2 * (m * q - s * s) / (m - 1)) * (sum(m) - 1) / (2 * (sum(m) * sum(q) - sum(s) * sum(s))) AS alpha FROM g),
p AS (SELECT x.r || '_vs_' || y.r AS pair, x.s AS a, y.s AS b FROM o x JOIN o y ON x.u = y.u AND x.r < y.r),
e AS (SELECT pair, sum((a - b) * (a - b)) AS seen, count(*) AS n, count(*) * (sum(a * a) + sum(b * b)) - 2 * sum(a) * sum(b) AS chance FROM p GROUP BY pair)
SELECT pair, round(1 - seen * n / chance, 6) AS kappa, 3 AS distinct_raters, (SELECT count(DISTINCT u) FROM r) AS unit_count, overlap AS overlap_count, (SELECT count(*) FROM o) AS observed_cells,
(SELECT count(*) FROM r) AS expected_cells, (SELECT count(*) FROM r WHERE s IS NULL) AS missingness_count, round(alpha, 6) AS alpha, 'scored' AS status FROM e, alpha""")
def agreement_report(t):
    third = F.when(F.col("doc_id") % 5 > 0, F.col("quality") * (F.col("doc_id") % 3))
    scores = {"quality": F.col("quality"), "toxic": F.col("toxic"), "third": third}
    cells = F.explode(F.array(*[F.struct(F.lit(r).alias("rater"), s.cast("long").alias("score")) for r, s in scores.items()]))
    report = stats.agreement_report(t.labels.select("doc_id", cells.alias("x")).select("doc_id", "x.*"), "doc_id", "rater", "score")
    kept = [c for c in report.columns if c not in ("kappa", "alpha")]
    return report.select(*kept, F.round("alpha", 6).alias("alpha"), F.explode("kappa").alias("pair", "k")).withColumn("kappa", F.round("k", 6)).drop("k")


@query("""WITH c AS (SELECT 'S' || s_suppkey AS e, s_suppkey % 3 > 0 AS factual, s_suppkey % 4 > 0 AS usable FROM supplier UNION ALL SELECT 'P' || p_partkey, p_partkey % 2 = 0, true FROM part),
f AS (SELECT e FROM c WHERE factual AND usable),
g AS (SELECT count(*) AS n, count(*) FILTER ('S' || l_suppkey IN (SELECT e FROM f) OR 'P' || l_partkey IN (SELECT e FROM f)) AS linked FROM lineitem WHERE l_returnflag <> 'R'),
s AS (SELECT o_orderkey AS q, 'S' || (o_custkey % 15 + 1) AS e FROM orders UNION ALL SELECT o_orderkey, 'P' || (o_orderkey % 211) FROM orders),
k AS (SELECT q, count(*) FILTER (factual AND usable) AS linked, count(*) FILTER (NOT factual AND usable) AS target, count(*) FILTER (usable IS NOT TRUE) AS invalid FROM s LEFT JOIN c USING (e) GROUP BY q),
a AS (SELECT count(*) AS total, count(*) FILTER (linked > 0) AS linked, count(*) FILTER (linked = 0 AND target > 0 AND invalid = 0) AS target FROM k)
SELECT g.n AS accepted_claims, g.linked AS linked_claims, round(g.linked / g.n, 6) AS graph_linked_claim_rate, a.total AS total_queries, a.linked AS linked_queries, round(a.linked / a.total, 6) AS linked_query_rate,
a.target AS target_anchor_only, g.linked >= 1 AND g.linked / g.n >= 0.02 AND a.linked >= 1 AND a.linked / a.total >= 0.02 AS passed FROM g, a""")
def linkage_gate(t):
    def entity(prefix, key, factual, usable):
        return [F.concat(F.lit(prefix), key).alias("entity_id"), F.lit("corpus").alias("namespace"), factual.alias("factual_identity_allowed"), usable.alias("retrieval_allowed"), F.lit("linked").alias("link_status")]

    s = t.supplier.select(*entity("S", "s_suppkey", F.col("s_suppkey") % 3 > 0, F.col("s_suppkey") % 4 > 0))
    p = t.part.select(*entity("P", "p_partkey", F.col("p_partkey") % 2 == 0, F.lit(True)))
    ends = [F.concat(F.lit("S"), "l_suppkey").alias("subject_entity_id"), F.concat(F.lit("P"), "l_partkey").alias("object_entity_id")]
    c = t.lineitem.select(F.when(F.col("l_returnflag") == "R", "rejected").otherwise("accepted").alias("review_status"), *ends)
    ids_ = F.array(F.concat(F.lit("S"), F.col("o_custkey") % 15 + 1), F.concat(F.lit("P"), F.col("o_orderkey") % 211))
    q = t.orders.select(F.col("o_orderkey").alias("query_id"), ids_.alias("entity_ids"))
    g = claims.linkage_gate(c, s.unionAll(p), q)
    return g.withColumns({x: F.round(x, 6) for x in ("graph_linked_claim_rate", "linked_query_rate")})


@query("""WITH d AS (SELECT doc_id, text, CASE WHEN doc_id % 7 > 0 THEN source END AS ref, CASE WHEN doc_id % 5 > 0 THEN text END AS hyp,
CASE WHEN lower(trim(lang)) IN ('en', 'fr', 'de', 'es', 'pt', 'it', 'ru', 'zh', 'ja', 'ko', 'hi', 'ta') THEN lower(trim(lang)) END AS lang, contains(text, 'a') AS a FROM documents),
s AS (SELECT *, CASE WHEN coalesce(lang, 'en') NOT IN ('en', 'hi', 'ta') THEN 'unsupported_language' WHEN text IS NULL OR trim(text) = '' THEN 'unavailable' WHEN coalesce(lang, 'en') <> 'en' THEN 'mismatch' ELSE 'scored' END AS ls,
CASE WHEN ref IS NULL THEN 'missing_reference' WHEN hyp IS NULL THEN 'missing_hypothesis' END AS why FROM d),
m AS (SELECT s.*, x.metric FROM s, (VALUES ('chrf'), ('bertscore'), ('rouge_l'), ('meteor'), ('detoxify')) AS x(metric)),
j AS (SELECT *, CASE WHEN metric <> 'chrf' AND ls = 'mismatch' THEN 'language_mismatch' WHEN metric <> 'chrf' AND ls <> 'scored' THEN 'unsupported_language'
WHEN metric <> 'detoxify' AND why IS NOT NULL THEN CASE WHEN ref IS NULL THEN 'excluded_missing_reference' ELSE why END WHEN metric IN ('bertscore', 'meteor') THEN 'unavailable'
WHEN metric = 'detoxify' AND hyp IS NULL THEN 'invalid_score' ELSE 'scored' END AS status FROM m)
SELECT doc_id::VARCHAR AS ID, ls AS language_status, metric, status, CASE WHEN status = 'language_mismatch' THEN 'detected_language_mismatch'
WHEN status = 'unsupported_language' THEN CASE WHEN metric = 'bertscore' THEN 'language_not_supported' ELSE 'english_only_metric' END WHEN status = 'unavailable' THEN metric || '_scorer_unavailable'
WHEN status = 'invalid_score' THEN 'nonfinite_metric_value' WHEN status <> 'scored' THEN why END AS reason,
CASE WHEN status = 'scored' AND metric = 'rouge_l' THEN length(ref) / 64.0 WHEN status = 'scored' AND metric = 'detoxify' THEN CASE WHEN a THEN 0.5 ELSE 0.25 END END::DOUBLE AS value FROM j""")
def record_evaluation(t):
    d = t.documents.select("doc_id", "text", "lang", F.when(F.col("doc_id") % 7 > 0, F.col("source")).alias("ref"), F.when(F.col("doc_id") % 5 > 0, F.col("text")).alias("hyp"))
    scorers = {"rouge_l": lambda r, h: F.length(r) / 64, "detoxify": lambda r, h: F.when(F.contains(h, F.lit("a")), 0.5).when(h.isNotNull(), 0.25)}
    e = evaluation.evaluate_records(d, "doc_id", "text", "ref", "hyp", "lang", lambda x: F.lit("ENGLISH"), scorers)
    # an array, not the map: of a map's rows Spark infers a filter that computes all metrics again
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col("metrics")[m].alias("m")) for m in ("chrf", "bertscore", *evaluation.ENGLISH_ONLY)]))
    m = e.select(F.nullif("ID", F.lit("")).alias("ID"), "language_status", each.alias("x"))  # the SQL keeps a missing id null
    return m.select("ID", "language_status", "x.metric", "x.m.status", "x.m.reason", F.when(F.col("x.metric") != "chrf", F.col("x.m.value")).alias("value"))


_GRID = "WITH t(threshold) AS (VALUES (0.25::DOUBLE), (0.5), (0.75)), g AS (SELECT quality = 1 AS gold, (doc_id % 97) / 97.0 AS s FROM labels), c AS (SELECT threshold, count(*) FILTER (gold AND s >= threshold) AS tp, count(*) FILTER (NOT gold AND s >= threshold) AS fp, count(*) FILTER (gold AND s < threshold) AS fn FROM g, t GROUP BY threshold)"


@query(_GRID + " SELECT threshold, tp + fn AS support, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c")
def threshold_grid(t):
    g = t.labels.select((F.col("quality") == 1).alias("gold"), ((F.col("doc_id") % 97) / 97.0).alias("s"))
    r = stats.threshold_grid(g, "gold", "s", [0.25, 0.5, 0.75])
    return r.select("threshold", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query()
def chrf_pairs(t):
    b = t.benchmark
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("hyp"))
    return b.join(nxt, "item_id").select("item_id", F.round(stats.chrf(F.col("text"), F.col("hyp")), 6).alias("chrf"))


@query()
def rouge_l_pairs(t):
    a, b = t.conversations.where("turn % 2 = 0"), t.conversations.where("turn % 2 = 1")
    b = b.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(stats.rouge_l("text", "answer"), 6).alias("rouge_l"))


@query()
def bootstrap_ci(t):
    c = stats.bootstrap_mean_ci(t.events.select("value"), "value")
    return c.select(*[F.round(x, 6).alias(x) for x in ("mean", "low", "high")])


# ---- sampling, schedules, rules ------------------------------------------------------------------------------


@query("""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY substring(sha256(to_json([doc_id::VARCHAR, '7'])::VARCHAR), 1, 20), doc_id) AS round FROM documents)
SELECT doc_id, lang, round::INTEGER AS round FROM r ORDER BY round, lang LIMIT 60""")
def round_robin_sample(t):
    return sampling.round_robin(t.documents.select("doc_id", "lang"), "doc_id", "lang", 60, "7")


@query("""WITH i AS (SELECT unnest(range(0, 240)) AS i) SELECT 'REQ' || lpad((i + 1)::VARCHAR, 6, '0') AS request_id, ['a', 'b', 'c'][(i % 3 + 1)::INT] AS category, ['en', 'de'][(i // 3 % 2 + 1)::INT] AS language FROM i""")
def quota_schedule(t):
    return sampling.quota_schedule(t.spark, 240, category=["a", "b", "c"], language=["en", "de"])


@query("""WITH o AS (SELECT lang, count(*) AS observed FROM documents GROUP BY lang), e AS (SELECT lang, count(*) AS expected FROM documents JOIN labels USING (doc_id) GROUP BY lang)
SELECT lang, coalesce(observed, 0) AS observed, coalesce(expected, 0) AS expected, coalesce(observed, 0) = coalesce(expected, 0) AS holds FROM o FULL JOIN e USING (lang)""")
def quota_audit(t):
    return sampling.quota_audit(t.documents, t.documents.join(t.labels.select("doc_id"), "doc_id"), "lang")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_antijoin(t):
    return sampling.pending(t.documents.select("doc_id"), t.labels, "doc_id")


@query("""WITH s AS (SELECT DISTINCT user_id AS request_id FROM events), r AS (SELECT user_id AS id FROM events WHERE event_type = 'error' UNION ALL SELECT unnest([user_id, user_id + 1]) FROM events WHERE event_type = 'signup')
SELECT request_id, count(id) AS retries FROM s LEFT JOIN r ON id = request_id GROUP BY 1""")
def retry_counts(t):
    e = t.events
    one = F.when(F.col("event_type") == "error", F.col("user_id"))
    many = F.when(F.col("event_type") == "signup", F.array("user_id", F.col("user_id") + 1))
    events = e.select(one.alias("request_id"), many.alias("request_ids")).where("request_id IS NOT NULL OR request_ids IS NOT NULL")
    return sampling.retry_counts(e.select(F.col("user_id").alias("request_id")).distinct(), events)


@query(r"""SELECT doc_id, array_to_string(list_sort(list_filter([CASE WHEN regexp_matches(text, '[0-9]{4}') THEN 'long_number' END, CASE WHEN contains(lower(text), 'licensed under') THEN 'license' END,
CASE WHEN NOT regexp_matches(text, '[.]') THEN 'no_sentence' END], lambda x: x IS NOT NULL)), ',') AS reasons FROM documents""")
def rule_engine_reasons(t):
    rules = t.spark.createDataFrame(
        [("r1", "regex", "veto", "[0-9]{4}", "long_number"), ("r2", "marker", "veto", "Licensed under", "license"), ("r3", "regex", "require", "[.]", "no_sentence")],
        "rule_id string, kind string, mode string, pattern string, reason string",
    )
    return audit.rule_reasons(t.documents, rules, "doc_id", "text").select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@query("""SELECT conv_id, max(text) FILTER (turn = 0 AND role = 'user') AS first_user, count(*) AS turns FROM conversations GROUP BY conv_id""")
def conversation_heads(t):
    return t.conversations.groupBy("conv_id").agg(F.max(F.when((F.col("turn") == 0) & (F.col("role") == "user"), F.col("text"))).alias("first_user"), F.count("*").alias("turns"))


@query("""SELECT id, round(max(v) FILTER (variant = 'click'), 6) AS click, round(max(v) FILTER (variant = 'view'), 6) AS "view" FROM (SELECT user_id AS id, event_type AS variant, avg(value) AS v FROM events GROUP BY 1, 2) GROUP BY id""")
def variant_pivot(t):
    p = sinks.variant_columns(_metric(t), "id", "variant", "v", ["click", "view"])
    return p.select("id", F.round("click", 6).alias("click"), F.round("view", 6).alias("view"))


@query("SELECT event_id, sha256(event_type) AS h FROM events WHERE event_id % 3 <> 0")
def idempotent_append(t):
    """The rows that an append of all events would add where every third one is already there."""
    e = t.events.select("event_id", F.sha2("event_type", 256).alias("h"))
    return sinks.new_rows(e.where("event_id % 3 = 0"), e.unionAll(e.where("event_id % 2 = 0")), "event_id")


@query("SELECT user_id AS id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 1")
def uniqueness_violations(t):
    return audit.require_unique(t.events.withColumnRenamed("user_id", "id"), "id")


@query("""SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def tumbling_windows(t):
    return ingest.tumbling(t.events, "6 hours").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


# ---- citations -----------------------------------------------------------------------------------------------

_CLAIMS = r"""c AS (SELECT conv_id AS response_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS claim_index,
  ['E' || (turn + 1), 'E' || (conv_id % 7)] AS ids FROM conversations),
l AS (SELECT conv_id AS response_id, 'E' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS id FROM conversations)"""


def _claims(t):
    x = F.concat(F.lit("Claim [E"), F.col("turn") + 1, F.lit("] and [E"), F.col("conv_id") % 7, F.lit("]."))
    c = citations.claim_records(t.conversations.select(F.col("conv_id").alias("response_id"), F.col("turn").alias("start"), x.alias("text")))
    entries = citations.ledger(t.conversations.withColumnRenamed("conv_id", "response_id"), "response_id", "turn", "text")
    return citations.resolve(c, entries)


@query(f"""WITH {_CLAIMS}, h AS (SELECT response_id, list(id) AS have FROM l GROUP BY 1)
SELECT response_id, claim_index, 'claim and' AS claim_text, array_to_string(list_sort(list_distinct(list_filter(ids, lambda i: i <> 'E0' AND list_contains(have, i)))), ',') AS known,
array_to_string(list_sort(list_distinct(list_filter(ids, lambda i: i <> 'E0' AND NOT list_contains(have, i)))), ',') AS unknown FROM c JOIN h USING (response_id)""")
def claim_citations(t):
    c = _claims(t).select("response_id", "claim_index", F.regexp_replace("claim_text", r" \[e0\]", "").alias("claim_text"), F.array_join(F.array_sort("known_ids"), ",").alias("known"), F.array_join(F.array_sort("unknown_ids"), ",").alias("unknown"))
    return c


@query()
def citation_support(t):
    c = _claims(t)
    each = c.select("response_id", "claim_index", F.explode(F.concat(F.array("known_ids"), F.transform("known_ids", lambda i: F.array(i)))).alias("premise_ids")).distinct()
    scores = each.withColumn("score", (F.size("premise_ids") * 0.3 + (F.col("response_id") % 5) * 0.1))
    s = citations.support(c, scores, 0.5)
    return s.select("response_id", "factual", "supported", "necessary", "overcitations", F.round("claim_recall", 6).alias("claim_recall"), F.round("citation_precision", 6).alias("citation_precision"))


@query("""WITH s AS (SELECT conv_id, turn, length(text) AS size FROM conversations), c AS (SELECT conv_id, turn + 1 AS place, sum(size) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM s UNION ALL SELECT DISTINCT conv_id, 0, 0 FROM s),
f AS (SELECT conv_id, p.payload, place, p.base + used AS total FROM c, (VALUES (0, 900), (1, 100)) p(payload, base) WHERE p.base + used <= 1000)
SELECT conv_id, arg_min(payload, (payload, -place))::INTEGER AS payload, arg_min(place, (payload, -place))::BIGINT AS evidence_count, arg_min(total, (payload, -place))::BIGINT AS total FROM f GROUP BY conv_id""")
def prompt_fit(t):
    c = t.conversations.select("conv_id", (F.col("turn") + 1).alias("place"), F.length("text").cast("long").alias("size"))
    c = c.unionAll(c.select("conv_id", F.lit(0).cast("long"), F.lit(0).cast("long")).distinct())
    payloads = t.spark.createDataFrame([(0, 900), (1, 100)], "payload int, base long")
    return citations.fit_prompt(c.crossJoin(F.broadcast(payloads)), "conv_id", 1000)


# ---- claims, the claim graph, retrieval on it ----------------------------------------------------------------


def _claim_table(t):
    """One claim per conversation turn: the first word is the subject, the role the object; every seventh row has a fault."""
    d = t.conversations.where(F.length(F.split("text", " ")[0]) > 0)
    word = F.split("text", " ")[0]
    k = F.col("conv_id") % 7
    status = F.when(k == 1, "nil").when(k == 2, "weird").otherwise("canonical")
    entity = F.when(k == 1, F.lit(None)).otherwise(F.concat(F.lit("ENT:"), "role"))
    subject = F.struct(F.lit("m1").alias("mention_id"), word.alias("text"), F.when(k == 3, 1).otherwise(0).alias("start"), (F.length(word) + F.when(k == 3, 1).otherwise(0)).alias("end"), entity.alias("entity_id"), status.alias("entity_status"), F.col("role").alias("canonical_name"))
    return d.select(
        F.concat(F.lit("D"), "conv_id").alias("document_uid"), F.concat(F.lit("C"), "turn").alias("chunk_id"), "text", F.lit(0).alias("claim_index"), F.lit(None).cast("string").alias("claim_id"),
        F.array(subject).alias("mentions"), F.when(k == 4, "m9").otherwise("m1").alias("subject"), F.struct(F.lit(None).cast("string").alias("mention_id"), F.col("role").alias("value"), F.lit("text").alias("value_type")).alias("object"),
        F.when(k == 5, "likes").otherwise("describes").alias("predicate"), F.when(k == 6, "negated").otherwise("affirmed").alias("polarity"),
        F.lit(None).cast("struct<text: string, start: int, end: int>").alias("polarity_scope"), F.lit("asserted").alias("modality"), F.lit(None).cast("string").alias("attribution"), F.when((k == 0) & (F.col("turn") % 2 == 1), "quotes").otherwise("supports").alias("evidence_stance"), F.lit(0.9).alias("model_confidence"),
    )


_CLAIM_SQL = """
c AS (SELECT 'D' || conv_id AS document_uid, 'C' || turn AS chunk_id, conv_id % 7 AS k, turn, role, string_split(text, ' ')[1] AS w, text FROM conversations WHERE length(string_split(text, ' ')[1]) > 0),
v AS (SELECT *, CASE k WHEN 2 THEN 'subject_endpoint_missing,unknown_entity_status' WHEN 3 THEN 'mention_span_mismatch,subject_endpoint_missing' WHEN 4 THEN 'subject_endpoint_missing' WHEN 5 THEN 'unknown_predicate' WHEN 6 THEN 'missing_polarity_scope'
  WHEN 1 THEN 'unresolved_entity' WHEN 0 THEN CASE WHEN turn % 2 = 1 THEN 'quoted_only' ELSE '' END END AS reasons FROM c),
routed AS (SELECT *, CASE WHEN k IN (2, 3, 4, 5, 6) THEN 'quarantined' WHEN reasons <> '' THEN 'reviewed' ELSE 'accepted' END AS route FROM v)"""


@query(f"WITH {_CLAIM_SQL} SELECT document_uid, chunk_id, route, reasons FROM routed")
def claim_validate(t):
    return claims.validate(_claim_table(t)).select("document_uid", "chunk_id", "route", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {_CLAIM_SQL} SELECT document_uid, CASE WHEN count(DISTINCT route) = 1 THEN min(route) ELSE 'partial' END AS status FROM routed GROUP BY 1")
def extraction_status(t):
    return claims.extraction_status(claims.validate(_claim_table(t)).withColumn("chunk_id", F.lit("all"))).select("document_uid", "status")


def _claim_graph(t):
    c = t.conversations
    chunks = c.select(F.concat(F.lit("D"), "conv_id").alias("document_uid"), F.concat(F.lit("C"), "turn").alias("chunk_id"), "text", F.sha2("text", 256).alias("text_sha256"), F.lit(True).alias("factual_index_allowed"), F.lit("accepted").alias("status"), F.lit("review").alias("source_type"), F.lit(0.8).alias("authority_score"), F.col("turn").alias("ord"))
    ok = claims.validate(_claim_table(t)).where("route = 'accepted'")
    return claims.build_graph(ok, chunks)


@query(f"WITH {_CLAIM_SQL}, a AS (SELECT * FROM routed WHERE route = 'accepted') SELECT type, count(*) AS n FROM (SELECT DISTINCT document_uid, role, unnest(['has_subject', 'has_object']) AS type FROM a UNION ALL SELECT document_uid, chunk_id, unnest(['supports', 'from_document', 'evidenced_by']) FROM a) GROUP BY type")
def graph_build_edges(t):
    return gates.frequency(_claim_graph(t)["edges"], "type")


@query(f"WITH {_CLAIM_SQL} SELECT document_uid, 'ENT:' || role AS subject_entity_id, role AS object_value, count(*) AS n_evidence FROM routed WHERE route = 'accepted' GROUP BY ALL")
def graph_build_claims(t):
    return _claim_graph(t)["Claim"].select("document_uid", "subject_entity_id", "object_value", F.size("evidence_occurrence_ids").cast("long").alias("n_evidence"))


@query()
def graph_components_score(t):
    checkpoint_dir(t.spark)
    g = {k: v.checkpoint() for k, v in _claim_graph(t).items() if k in ("EvidenceChunk", "Claim", "Entity", "edges")}
    e = g["EvidenceChunk"]
    signatures = t.spark.createDataFrame([(0, ["ENT:user"], ["describes"], ["affirmed"], ["asserted"], ["supports"]), (1, ["ENT:none"], [], [], [], [])], "query_id int, entity_ids array<string>, predicates array<string>, polarities array<string>, modalities array<string>, stances array<string>")
    seeds = e.crossJoin(F.broadcast(signatures.select("query_id"))).select("query_id", F.lit("dense").alias("branch"), (F.length("text") / 1000.0).alias("raw_score"), "evidence_chunk_id", "document_uid", "chunk_id")
    return expansion.graph_hits(seeds, signatures, g, expansion.Settings()).select("query_id", "candidate_id", "hop", F.round("score", 6).alias("score"), "rank", "n_paths")


@query("""SELECT conv_id AS document_uid, turn AS chunk_id, max_by(text, (length(text), text)) AS text FROM (SELECT conv_id, turn % 2 AS turn, text FROM conversations) GROUP BY 1, 2""")
def chunk_last_wins(t):
    c = t.conversations.select(F.col("conv_id").alias("document_uid"), (F.col("turn") % 2).alias("chunk_id"), "text", F.struct(F.length("text").alias("n"), F.col("text").alias("x")).alias("ord"))
    return claims.last_chunks(c).select("document_uid", "chunk_id", "text")


# ---- summaries and gates -------------------------------------------------------------------------------------


@query("SELECT d.doc_id, l.doc_id IS NOT NULL AS reference_available FROM documents d LEFT JOIN labels l USING (doc_id)")
def reference_quarantine(t):
    d = t.documents.join(t.labels.select("doc_id", F.col("quality").cast("string").alias("ref")), "doc_id", "left")
    return gates.scorable(d, "ref").select("doc_id", "reference_available")


@query("SELECT lang, count(*) AS n, round(avg((lang = 'en')::INT), 6) AS match_rate, 'english=' || count(*) AS detected FROM documents GROUP BY lang")
def language_summary(t):
    d = t.documents.select("lang", F.lit("english").alias("detected"))
    s = gates.language_summary(d, "lang", "detected")
    return s.select("lang", "n", F.round("match_rate", 6).alias("match_rate"), F.array_join(F.transform(F.map_entries("detected_counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("detected"))


@query("SELECT event_type AS metric, count(*) AS n_input, count(*) FILTER (user_id % 9 <> 0) AS n_scorable, round(avg((user_id % 9 <> 0)::INT), 6) AS coverage FROM events GROUP BY 1")
def reference_audit(t):
    m = t.events.select(F.col("event_type").alias("metric"), F.when(F.col("user_id") % 9 == 0, "missing").otherwise("scored").alias("status"))
    return gates.reference_audit(m).withColumn("coverage", F.round("coverage", 6))


@query("SELECT event_type, count(*) AS n_rows, count(DISTINCT user_id) AS n_ids, count(*) FILTER (value > 10) AS n_accepted, round(count(*) FILTER (value > 10) / greatest(1, count(*)), 6) AS rate FROM events GROUP BY 1")
def variant_quality(t):
    return gates.variant_quality(t.events, "event_type", "user_id", F.col("value") > 10).withColumn("rate", F.round("rate", 6))


@query("SELECT c_custkey, count(o_orderkey) AS n_chunks, count(o_orderkey) > 0 AS indexable FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def chunk_counts(t):
    return gates.chunk_counts(t.customer, t.orders.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query("SELECT lang, count(*) AS n, count(*) FILTER (n_chars >= 500) AS n_consistent, round(avg((n_chars >= 500)::INT), 6) AS rate FROM documents GROUP BY ROLLUP (lang)")
def language_consistency(t):
    return gates.consistency(t.documents, "lang", F.col("n_chars") >= 500).withColumn("rate", F.round("rate", 6))


@query("SELECT count(*) AS n, count(*) FILTER (quality = 1) AS n_accepted, round(avg((quality = 1)::INT), 6) AS rate, avg((quality = 1)::INT) >= 0.98 AS passed FROM labels")
def parse_rate_gate(t):
    return gates.rate_gate(t.labels, F.col("quality") == 1, 0.98).withColumn("rate", F.round("rate", 6))


@query("SELECT count(*) AS n, count(*) FILTER (n_chars >= 80) AS healthy, round(count(*) FILTER (n_chars >= 80) / count(*), 6) AS coverage, count(*) FILTER (n_chars >= 80) >= 40 AND count(*) FILTER (n_chars >= 80) / count(*) >= 0.8 AS passed FROM documents")
def availability_gate(t):
    return gates.availability_gate(t.documents, F.col("n_chars") >= 80, 40, 0.8).withColumn("coverage", F.round("coverage", 6))


@query("WITH n AS (SELECT p_brand, p_type, count(*) AS n, min(p_partkey) AS o FROM part GROUP BY 1, 2) SELECT p_brand, arg_max(p_type, (n, -o)) AS p_type FROM n GROUP BY 1")
def mode_label(t):
    return gates.mode_label(t.part, "p_brand", "p_type", "p_partkey")


@query("""WITH c AS (SELECT quality AS g, toxic AS p FROM labels), l AS (SELECT DISTINCT g AS label FROM c UNION SELECT p FROM c)
SELECT label, count(*) FILTER (g = label) AS support, count(*) FILTER (g = label AND p = label) AS correct, round(coalesce(count(*) FILTER (g = label AND p = label) / nullif(count(*) FILTER (p = label), 0), 0), 6) AS precision,
round(coalesce(count(*) FILTER (g = label AND p = label) / nullif(count(*) FILTER (g = label), 0), 0), 6) AS recall FROM c, l GROUP BY label""")
def per_label_scores(t):
    p = gates.per_label(t.labels, "quality", "toxic")
    return p.select("label", F.col("support").cast("long").alias("support"), F.col("correct").cast("long").alias("correct"), F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def set_differences(t):
    return gates.set_differences(t.documents, t.labels, "doc_id")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'missing' ELSE 'changed' END AS reason FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0")
def cache_mismatches(t):
    a = t.documents.select("doc_id", F.sha2("text", 256).alias("h"))
    b = a.where("doc_id % 5 <> 0").withColumn("h", F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.col("h")))
    return gates.cache_mismatches(a, b, "doc_id", "h")


# ---- lineage -------------------------------------------------------------------------------------------------

_LINEAGE = """chunk AS (SELECT conv_id, turn, 'chunk:' || conv_id || ':' || turn AS id FROM conversations),
n AS (SELECT DISTINCT 'document:' || conv_id AS id, 'document' AS kind FROM conversations UNION ALL SELECT id, 'chunk' FROM chunk UNION ALL SELECT DISTINCT 'entity:' || role, 'entity' FROM conversations),
e AS (SELECT 'document:' || conv_id AS source, id AS target, 'contains' AS kind FROM chunk UNION ALL SELECT 'chunk:' || conv_id || ':' || turn, 'entity:' || role, 'mentions' FROM conversations)"""


def _lineage(t):
    c = t.conversations.select(F.col("conv_id").cast("string").alias("document"), F.concat_ws(":", "conv_id", "turn").alias("chunk"), F.col("role").alias("entity"))
    return lineage.build(c)


@query(f"WITH {_LINEAGE} SELECT n.id, n.kind, count(e.source) AS degree FROM n LEFT JOIN e ON n.id IN (e.source, e.target) GROUP BY 1, 2")
def lineage_nodes(t):
    return _lineage(t)[0].select("id", "kind", "degree")


@query(f"WITH {_LINEAGE} SELECT source, target, kind FROM e")
def lineage_edges(t):
    return _lineage(t)[1]


@query(f"""WITH {_LINEAGE}, b AS (SELECT source AS s, target AS d FROM e UNION ALL SELECT target, source FROM e), h1 AS (SELECT DISTINCT d FROM b WHERE s = 'document:0'),
h2 AS (SELECT DISTINCT b.d FROM b JOIN h1 ON b.s = h1.d) SELECT d AS id FROM (SELECT 'document:0' AS d UNION SELECT d FROM h1 UNION SELECT d FROM h2)""")
def lineage_neighbourhood(t):
    return lineage.neighbourhood(_lineage(t)[1], "document:0", 2)
