"""Hybrid retrieval over whole tables, the query as a column (TK1-TK7, WN1-WN4, JN4, JN6).

Every operator takes and gives (query_id, candidate_id, ...) rows. Thresholds come after the limit, as stated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import tokens

K1, B = 1.5, 0.75
QUERY_BLOCK, ITEM_BLOCK = 4096, 16384
#: The most terms of all queries that are sent to every task, and the scores or summands that are held at once.
ASKED, CELLS = 500_000, 2_000_000


def ranked(df: DataFrame, score: str = "score", group: str = "query_id", item: str = "candidate_id") -> DataFrame:
    """rank from 1 by score descending, item ascending (WN1)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), item)))


def top_k(df: DataFrame, k: int, score: str = "score", group: str = "query_id", item: str = "candidate_id") -> DataFrame:
    return ranked(df, score, group, item).where(F.col("rank") <= k)


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """candidate_id, term, tf, dl of a corpus; one shuffle on (document, term), pre-aggregated map-side."""
    terms = docs.select(F.col(key).alias("candidate_id"), tokens(F.col(text)).alias("t")).select("candidate_id", F.size("t").cast("long").alias("dl"), F.explode("t").alias("term"))
    return terms.groupBy("candidate_id", "dl", "term").agg(F.count("*").alias("tf"))


def _idf(docs: DataFrame, text: str, df: DataFrame, asked: DataFrame) -> DataFrame:
    """term, avgdl, idf of the terms asked for, of (term, df) of all terms."""
    stats = docs.select(F.size(tokens(F.col(text))).cast("long").alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    idf = df.crossJoin(F.broadcast(stats))  # one row of statistics
    idf = idf.withColumn("raw", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    mean = idf.agg(F.avg("raw").alias("mean_idf"))
    idf = idf.join(asked.select("term").distinct(), "term", "left_semi").crossJoin(F.broadcast(mean))
    return idf.select("term", "avgdl", F.when(F.col("raw") < 0, 0.25 * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))


def bm25(docs: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str) -> DataFrame:
    """query_id, candidate_id, score: BM25 with k1 1.5 and b 0.75; a negative idf becomes a quarter of the mean idf (TK2).

    Queries' distinct terms filter the postings before anything else is joined, so the corpus side shrinks to
    the terms asked for; document counts come from one aggregate over lengths.
    """
    asked = queries.select(F.col(query_key).alias("query_id"), F.explode(F.array_distinct(tokens(F.col(query_text)))).alias("term"))
    corpus = postings(docs, key, text)
    idf = _idf(docs, text, corpus.groupBy("term").agg(F.count("*").alias("df")), asked)
    hits = corpus.join(idf, "term").join(asked, "term")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("query_id", "candidate_id").agg(F.sum(part).alias("score"))


def overlap(docs: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str) -> DataFrame:
    """query_id, candidate_id, score: distinct shared terms over the query's distinct terms."""
    asked = queries.select(F.col(query_key).alias("query_id"), F.array_distinct(tokens(F.col(query_text))).alias("t")).select("query_id", F.size("t").alias("n"), F.explode("t").alias("term"))
    terms = docs.select(F.col(key).alias("candidate_id"), F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
    return terms.join(asked, "term").groupBy("query_id", "candidate_id").agg((F.count("*") / F.first("n")).alias("score"))


class _Best:
    """Of (query, id, score) seen so far, those that may be among a query's k best by (score rounded, id)."""

    def __init__(self, queries: int, k: int, slack: float):
        self.k, self.slack, self.held, self.count = k, slack, [], 0
        self.floor = np.full(queries, -np.inf)

    def add(self, scores: np.ndarray, hit: np.ndarray, ids: np.ndarray) -> None:
        row, query = np.nonzero(hit & (scores >= self.floor))
        self.held.append((query, ids[row], scores[row, query]))
        self.count += len(row)
        if self.count > 500_000:
            self.prune()

    def prune(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, i, s = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        at = np.arange(len(q))
        new = np.concatenate([[True], q[1:] != q[:-1]])[: len(q)]
        begin = np.maximum.accumulate(np.where(new, at, 0))
        tied = np.maximum.accumulate(np.where(new | np.concatenate([[True], s[1:] != s[:-1]])[: len(q)], at, 0))
        full = at - begin == self.k - 1
        self.floor[q[full]] = s[full] - self.slack
        keep = (s >= self.floor[q]) & (at - tied < self.k)  # k of the same score with lesser ids come first
        self.held, self.count = [(q[keep], i[keep], s[keep])], 0
        return self.held[0]


def lexical_top(docs: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str, k: int, slack: float = 2e-9) -> DataFrame:
    """branch (bm25, overlap), query_id, candidate_id, score: at least each query's k best rows of ``bm25`` and ``overlap``.

    Each task scores its documents against all queries and gives on only what may be among the k best, scores within
    ``slack`` of the k-th included, so what is shuffled does not depend on how many documents share a term. The terms asked for
    (at most ``ASKED``) go to all tasks; for more, or ids that are null or not unique, all scores come by joins.
    """
    asked = queries.select(F.col(query_key).alias("query_id"), F.array_distinct(tokens(F.col(query_text))).alias("t"))
    n = asked.agg(F.count("*").alias("rows"), F.count_distinct("query_id").alias("ids"), F.coalesce(F.sum(F.size("t")), F.lit(0)).alias("terms")).first()
    shared = docs.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n")).where("n > 1 OR id IS NULL")
    if n.rows != n.ids or n.terms > ASKED or not shared.isEmpty():
        both = {"bm25": bm25, "overlap": overlap}
        a, b = (f(docs, key, text, queries, query_key, query_text).select(F.lit(name).alias("branch"), "query_id", "candidate_id", "score") for name, f in both.items())
        return a.unionByName(b)
    df = docs.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    known = _idf(docs, text, df, asked.select(F.explode("t").alias("term"))).orderBy("term").toArrow()
    vocabulary, idf, avgdl = known.column("term").combine_chunks(), np.asarray(known.column("idf")), np.asarray(known.column("avgdl"))[:1]
    table = asked.toArrow()
    query_ids, lists = table.column("query_id").combine_chunks(), table.column("t").combine_chunks()
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
    term = pc.index_in(lists.flatten(), value_set=vocabulary)
    in_corpus = term.is_valid().to_numpy(zero_copy_only=False)
    term, query = np.asarray(term.fill_null(-1))[in_corpus], np.repeat(np.arange(len(sizes)), sizes)[in_corpus]
    query = query[np.argsort(term, kind="stable")]  # term by term
    askers = np.bincount(term, minlength=len(vocabulary))
    first = np.cumsum(askers) - askers
    n_queries = len(sizes)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {"bm25": _Best(n_queries, k, slack), "overlap": _Best(n_queries, k, slack)}
        for b in batches:
            ids, cells = np.asarray(b.column(0).to_pylist()), b.column(1)
            dl = np.asarray(pc.fill_null(pc.list_value_length(cells), 0)).astype(np.int64)
            at = pc.index_in(cells.flatten(), value_set=vocabulary)
            hit = at.is_valid().to_numpy(zero_copy_only=False)
            cell, tf = np.unique(np.repeat(np.arange(len(dl)), dl)[hit] * len(vocabulary) + np.asarray(at.fill_null(-1))[hit], return_counts=True)
            if not len(cell):
                continue
            row, t = cell // len(vocabulary), cell % len(vocabulary)
            part = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[row] / avgdl))
            work = np.cumsum(np.bincount(row, weights=askers[t], minlength=len(dl)))
            lo = 0
            while lo < len(dl):  # rows whose scores, and what is summed to them, stay within a fixed size
                most = np.searchsorted(work, (work[lo - 1] if lo else 0) + CELLS, "right")
                hi = int(min(max(most, lo + 1), lo + max(1, CELLS // n_queries), len(dl)))
                own = slice(*np.searchsorted(row, [lo, hi]))
                g = askers[t[own]]
                where = np.repeat((row[own] - lo) * n_queries, g) + query[np.repeat(first[t[own]] - np.cumsum(g) + g, g) + np.arange(g.sum())]
                shape = (hi - lo, n_queries)
                count = np.bincount(where, minlength=shape[0] * n_queries).reshape(shape)
                total = np.bincount(where, weights=np.repeat(part[own], g), minlength=shape[0] * n_queries).reshape(shape)
                best["bm25"].add(total, count > 0, ids[lo:hi])
                best["overlap"].add(count / sizes.clip(1), count > 0, ids[lo:hi])
                lo = hi
        for name, x in best.items():
            if x.held:
                q, i, s = x.prune()
                for lo in range(0, len(q), 10_000):
                    own = slice(lo, lo + 10_000)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(q[own]), pa.string()), query_ids.take(pa.array(q[own])), pa.array(i[own].tolist(), id_type), pa.array(s[own])], ["branch", "query_id", "candidate_id", "score"])

    cells = docs.select(F.col(key).alias("candidate_id"), tokens(F.col(text)).alias("t"))
    id_type = cells.select("candidate_id").limit(0).toArrow().schema.field(0).type
    kinds = T.StructType([T.StructField("branch", T.StringType()), T.StructField("query_id", queries.schema[query_key].dataType), T.StructField("candidate_id", docs.schema[key].dataType), T.StructField("score", T.DoubleType())])
    return cells.mapInArrow(score, kinds)


def _block_top(queries: pa.Table, items: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, item row and score of each query's k best items of a block; a query never meets its own id.

    The product of the matrices only chooses rows: what comes within its rounding of the k-th is scored again in
    the order of the elements, so equal vectors get equal scores and ties go by id.
    """
    q_ids, i_ids = (np.asarray(x.column("id").to_pylist(), dtype=object) for x in (queries, items))
    order = np.argsort(i_ids, kind="stable")
    place: dict = {}
    for n, x in enumerate(i_ids[order]):
        place.setdefault(x, []).append(n)
    q, v = (np.stack(x.column("v").to_numpy()).astype(np.float64) for x in (queries, items))
    v = v[order]
    slack = 1e-12 * np.linalg.norm(q, axis=1) * (np.linalg.norm(v, axis=1).max() + 1)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for lo in range(0, len(q), 256):
        for n, near in enumerate(q[lo : lo + 256] @ v.T, lo):
            near[place.get(q_ids[n], [])] = -np.inf
            least = np.partition(near, -k)[-k] - slack[n] if len(near) > k else -np.inf
            at = np.nonzero((near >= least) & (near > -np.inf))[0]
            score = np.zeros(len(at))
            for x, y in zip(q[n], v[at].T, strict=True):
                score += x * y
            best = np.argsort(-score, kind="stable")[:k]
            out.append((np.full(len(best), n), order[at[best]], score[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def dense(queries: DataFrame, items: DataFrame, k: int, floor: float) -> DataFrame:
    """query_id, candidate_id, score, rank: exact top-k by dot product, then score >= floor (TK1).

    ``queries`` (query_id, q) and ``items`` (candidate_id, v) of finite vectors meet block by block, about
    ``QUERY_BLOCK`` by ``ITEM_BLOCK`` in a task, and only k rows a query leave a block; no pair becomes a row.
    """
    def usable(x: DataFrame, key: str, vector: str) -> DataFrame:
        v = x.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
        return v.where("id IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))").withColumn("dim", F.size("v"))

    asked, known = usable(queries, "query_id", "q"), usable(items, "candidate_id", "v")
    q_blocks, i_blocks = max(1, -(-asked.count() // QUERY_BLOCK)), max(1, -(-known.count() // ITEM_BLOCK))

    def dealt(x: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        return x.select("dim", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other), "id", "v")

    kinds = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("candidate_id", items.schema["candidate_id"].dataType), T.StructField("score", T.DoubleType())])

    def scan(a: pa.Table, b: pa.Table) -> pa.Table:
        if a.num_rows and b.num_rows:
            i, j, score = _block_top(a, b, k)
            return pa.table([a.column("id").take(pa.array(i)), b.column("id").take(pa.array(j)), pa.array(score)], names=kinds.names)
        return pa.table([a.column("id").slice(0, 0), b.column("id").slice(0, 0), pa.array([], pa.float64())], names=kinds.names)

    left, right = dealt(asked, "qb", q_blocks, "ib", i_blocks), dealt(known, "ib", i_blocks, "qb", q_blocks)
    scored = left.groupBy("dim", "qb", "ib").cogroup(right.groupBy("dim", "qb", "ib")).applyInArrow(scan, kinds)
    return top_k(scored, k).where(F.col("score") >= floor)


def min_max(df: DataFrame, score: str = "score", *group: str) -> DataFrame:
    """normalized in [0, 1] within each group; 1 where the group has no spread (WN2)."""
    w = Window.partitionBy(*(group or ("query_id", "branch")))
    low, high = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn("normalized", F.when(high == low, 1.0).otherwise((F.col(score) - low) / (high - low)))


def candidate_key(evidence: str, candidate: str, document: str, chunk: str) -> Column:
    """The first non-empty of evidence id, candidate id, document:chunk, chunk (TK7)."""
    e, c, d, k = (F.nullif(F.col(x), F.lit("")) for x in (evidence, candidate, document, chunk))
    return F.coalesce(e, c, F.when(d.isNotNull() & k.isNotNull(), F.concat_ws(":", d, k)), k)


def best_in_branch(hits: DataFrame) -> DataFrame:
    """One hit a (query, branch, candidate): least rank, then greatest score (WN3)."""
    w = Window.partitionBy("query_id", "branch", "candidate_id").orderBy("rank", F.desc("score"))
    return hits.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def reciprocal_rank_fusion(hits: DataFrame, weights: dict[str, float], constant: float = 60.0) -> DataFrame:
    """query_id, candidate_id, rrf_score, branches: sum of weight / (constant + rank) over positive hits (TK5)."""
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    hits = best_in_branch(hits.where(F.col("score") > 0)).withColumn("weight", F.coalesce(weight[F.col("branch")], F.lit(1.0)))
    trace = F.struct("branch", "rank", "score", "weight", (F.col("weight") / (constant + F.col("rank"))).alias("contribution"))
    return hits.groupBy("query_id", "candidate_id").agg(F.sum(F.col("weight") / (constant + F.col("rank"))).alias("rrf_score"), F.array_sort(F.collect_list(trace)).alias("traces"))


def select_evidence(scored: DataFrame, floor: float, most: int) -> DataFrame:
    """query_id, candidate_id, probability, selected, reason: sigmoid of a logit, floor, cap (TK4)."""
    p = scored.withColumn("probability", F.when(F.col("logit") >= 0, 1 / (1 + F.exp(-F.col("logit")))).otherwise(F.exp("logit") / (1 + F.exp("logit"))))
    p = p.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("probability"), "candidate_id")))
    reason = F.when(F.col("probability") < floor, "below_floor").when(F.col("place") > most, "over_limit").otherwise("selected")
    return p.select("query_id", "candidate_id", "probability", (reason == "selected").alias("selected"), reason.alias("reason"))


def abstentions(selected: DataFrame) -> DataFrame:
    """The queries without any selected evidence (TK4, GR6)."""
    return selected.groupBy("query_id").agg(F.count_if("selected").alias("n")).where("n = 0").select("query_id", F.lit("no_candidate_above_floor").alias("reason"))


def prefix_budget(df: DataFrame, group: str, order: list[str], size: str, budget: float) -> DataFrame:
    """The longest prefix of each group whose total size stays within the budget (WN8)."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)


def membership(on: DataFrame, off: DataFrame) -> DataFrame:
    """Per query, what two selections share and gain over their union (ST1, ST2)."""
    a, b = on.select("query_id", "candidate_id", F.lit(1).alias("x")), off.select("query_id", "candidate_id", F.lit(1).alias("y"))
    u = a.join(b, ["query_id", "candidate_id"], "full")
    x, y = F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0))
    return u.groupBy("query_id").agg(F.count("*").alias("universe"), F.sum(x * y).alias("shared"), F.sum(x * (1 - y)).alias("gained"), F.sum((1 - x) * y).alias("lost"))
