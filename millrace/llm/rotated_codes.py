"""Nearest neighbours by inner product with randomly rotated one-bit codes.

Every vector is centred on the mean of a bounded sample, normalised, padded with zeros to ``PADDING`` times its
dimension, turned by one random rotation and kept as
the signs of its coordinates (packed bits) with two scalars: its residual's norm and the inner product of the
code with the rotated direction, which corrects the estimate. For a query, bits give an unbiased estimate of
every inner product together with an error bound of about ``EPSILON`` standard deviations. A row stays a
candidate only if its upper bound reaches the k-th largest lower bound; candidates are reranked by the exact
inner product in double precision, ties to the smaller vec_id.

All codes are scanned for the stated queries, block by block: queries and rows are dealt into blocks of bounded
size, each pair of blocks is one task, and only its k nearest a query leave it.

Cases: rows with a null id, a null, empty or zero vector, or null or non-finite components take no part, nor do
rows whose dimension is not the most common one; equal rows count once; different vectors under one id stay
separate candidates, of which none answers a query of that id (the smallest asks it); fewer than k candidates
are all returned; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import columns, cut

EPSILON = 2.2
#: Code bits per dimension: vectors are padded with zeros before the rotation, which shrinks the error.
PADDING = 16
QUERY_BLOCK, CODE_BLOCK = 2048, 16_384
SAMPLE = 4096
SEED = 20240521


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


class Coder:
    def __init__(self, centre: np.ndarray, dim: int):
        self.dim = max(512, PADDING * dim)
        self.centre, self.turn = centre, rotation(self.dim)[:dim]

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Packed signs, residual norm, code agreement, and inner product with the centre, of each row."""
        r = x - self.centre
        norm = np.linalg.norm(r, axis=1)
        o = (r / np.where(norm > 0, norm, 1)[:, None]) @ self.turn
        agree = np.abs(o).sum(axis=1) / np.sqrt(self.dim)
        return np.packbits(o > 0, axis=1), norm, np.where(agree > 0, agree, 1.0), x @ self.centre

    def bounds(self, q: np.ndarray, bits: np.ndarray, norm: np.ndarray, agree: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimates of <x, q> (queries x codes) and their error bounds: <x,q> = <x,c> + <x-c, q-c> + <c, q-c>."""
        t = (q - self.centre) @ self.turn
        signs = np.unpackbits(bits, axis=1, count=self.dim).astype(np.float32) * 2 - 1
        dot = (t.astype(np.float32) @ signs.T) / np.sqrt(self.dim)
        shift = (q - self.centre) @ self.centre
        estimate = base[None, :] + shift[:, None] + (norm / agree)[None, :] * dot
        spread = norm * np.sqrt(np.maximum(0, 1 - agree**2)) / agree / np.sqrt(max(1, self.dim - 1))
        return estimate, EPSILON * np.linalg.norm(t, axis=1)[:, None] * spread[None, :] + 1e-5 * (1 + np.abs(estimate))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)


def usable(vectors: DataFrame) -> DataFrame:
    """uid, vec_id, v (array of doubles): the rows that take part."""
    v = columns(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    v = v.where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)")
    return v.distinct().withColumn("uid", F.xxhash64("vec_id", "v"))


def search(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each row whose vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    sizes = rows.groupBy(F.size("v").alias("d")).count().collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = max(sizes, key=lambda r: (r["count"], -r["d"]))["d"]
    rows = cut(rows.where(F.size("v") == dim), "vectors")
    n = rows.count()
    # the centre is fitted on a bounded sample: the rows with the smallest hashes
    sample = rows.orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE).select("v").toPandas()["v"]
    coder = spark.sparkContext.broadcast(Coder(np.mean(np.stack(sample), axis=0), dim))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits, norm, agree, base = coder.value.codes(_matrix(b.column(2), dim))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x.tobytes() for x in bits], pa.binary()), pa.array(norm), pa.array(agree), pa.array(base)], ["uid", "vec_id", "v", "bits", "norm", "agree", "base"])

    codes = rows.select("uid", "vec_id", "v").mapInArrow(encode, "uid long, vec_id long, v array<double>, bits binary, norm double, agree double, base double")
    asked = cut(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min_by("v", "uid").alias("v")), "queries")
    q_blocks, c_blocks = max(1, -(-asked.count() // QUERY_BLOCK)), max(1, -(-n // CODE_BLOCK))
    empty = F.lit(None)
    left = asked.select(F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("cb"), F.col("vec_id").alias("uid"), "vec_id", "v", empty.cast("binary").alias("bits"), *[empty.cast("double").alias(c) for c in ("norm", "agree", "base")])
    right = codes.select(F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"), F.pmod(F.xxhash64("uid"), F.lit(c_blocks)).cast("int").alias("cb"), "uid", "vec_id", "v", "bits", "norm", "agree", "base")

    def scan(table: pa.Table) -> pa.Table:
        is_query = np.asarray(table.column("bits").combine_chunks().is_null())
        qs, cs = table.filter(pa.array(is_query)), table.filter(pa.array(~is_query))
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if qs.num_rows and cs.num_rows:
            q, x = (_matrix(t.column("v").combine_chunks(), dim) for t in (qs, cs))
            q_id, c_id, c_uid = (np.asarray(t.column(c)) for t, c in ((qs, "vec_id"), (cs, "vec_id"), (cs, "uid")))
            bits = np.frombuffer(b"".join(cs.column("bits").to_pylist()), np.uint8).reshape(len(x), -1)
            scalars = [np.asarray(cs.column(c)) for c in ("norm", "agree", "base")]
            for lo in range(0, len(q), 256):
                out.append(_rerank(coder.value, q[lo : lo + 256], q_id[lo : lo + 256], x, c_id, c_uid, bits, scalars, k))
        a = [np.concatenate(v) for v in zip(*out, strict=True)]
        return pa.table(dict(zip(("query_id", "vec_id", "uid", "score"), a, strict=True)))

    near = left.unionByName(right).groupBy("qb", "cb").applyInArrow(scan, "query_id long, vec_id long, uid long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "uid")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _rerank(coder: Coder, q: np.ndarray, q_id: np.ndarray, x: np.ndarray, c_id: np.ndarray, c_uid: np.ndarray, bits: np.ndarray, scalars: list, k: int) -> tuple:
    """The k nearest of this block's rows for each query: bounds from codes choose, exact products order."""
    i_all, j_all, high_all = [], [], []
    floor = np.full(len(q), -np.inf)
    best = np.zeros((len(q), 0))
    for lo in range(0, len(x), 4096):
        part = slice(lo, lo + 4096)
        estimate, error = coder.bounds(q, bits[part], *[s[part] for s in scalars])
        own = q_id[:, None] == c_id[None, part]
        low, high = np.where(own, -np.inf, estimate - error), np.where(own, -np.inf, estimate + error)
        best = np.concatenate([best, low], axis=1)
        if best.shape[1] > k:
            best = np.partition(best, -k, axis=1)[:, -k:]
        if best.shape[1] == k:
            floor = best.min(axis=1)
        i, j = np.nonzero((high >= floor[:, None]) & ~own)
        i_all.append(i)
        j_all.append(j + lo)
        high_all.append(high[i, j])
    i, j, high = np.concatenate(i_all), np.concatenate(j_all), np.concatenate(high_all)
    keep = high >= floor[i]
    i, j = i[keep], j[keep]
    score = np.zeros(len(i))
    for d in range(q.shape[1]):  # summed component by component, in order
        score += q[i, d] * x[j, d]
    order = np.lexsort((c_uid[j], c_id[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i, side="left")
    i, j, score = i[rank < k], j[rank < k], score[rank < k]
    return q_id[i], c_id[j], c_uid[j], score
