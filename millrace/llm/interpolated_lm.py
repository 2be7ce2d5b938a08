"""Language-model scores by deleted interpolation of bigram, unigram and uniform estimates.

p(w | v) = a(b) c(v,w)/c(v) + d(b) c(w)/N + e(b) / (V + 1), where b is the context's frequency bucket (the whole
part of log2 c(v)). Each bucket's weights come from expectation-maximisation on deleted counts: every training
token is scored with itself left out of all counts, so the whole corpus is its own held-out set. The maximisation
runs until no weight moves by more than ``STILL``, over the means of bins an eighth of an octave wide.

Counting and lookup never shuffle texts or single tokens. Texts are read once, into chunks of at most
``CHUNK_TOKENS`` tokens (a longer document goes on in the next chunk), which are written to the shared folder as
word numbers; all later steps read these chunks, so a retried task sees the same ones. A chunk sends each of its
distinct n-grams once, as sorted hash keys with local counts, to the bucket that owns the key range (so a common
n-gram is one entry a chunk, whatever its frequency), and gets the corpus counts back in the same order. There are
as many buckets as keep each below about ``BUCKET_TOKENS`` tokens, however large the corpus. Chunks then hold
everything their documents need: they give the sufficient statistics of the EM (a table bounded by buckets and
bins) and, with the learned weights, the scores; texts and counts are gathered by chunk for each of the two. Unigram
keys are 64-bit hashes; bigram keys have ``SPARE`` bits more than the number of tokens; a collision adds two counts.

Cases: null text is empty and has one token, the end; without training rows N = V = 0 and every token has
probability 1; null doc_id hashes as the empty text; repeated rows count and score each; a document of any length
is scored whole; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import columns, crc_mod, cut, mix64, partitions, settle

CHUNK_TOKENS, BUCKET_TOKENS, FOLDS = 1_000_000, 1_000_000, 10
#: Bits of a bigram's key beyond those that number the corpus's tokens: at any size one bigram in 2^SPARE shares its key.
SPARE = 20
#: The maximisation ends when no weight moves by more than this, or after so many rounds.
STILL, ROUNDS = 1e-9, 5000
START, END = b"\n<start>", b"\n<end>"
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())
PIECE = "chunk long, bucket int, kind string, payload binary"
TEXT = "chunk long, tokens long, payload binary"
PART = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def squeeze(x) -> bytes:
    """Any of our own structures, pickled and compressed."""
    raw = pickle.dumps(x)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueeze(raw: bytes):
    return pickle.loads(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True))


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def planes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of little-endian values, all lowest bytes first: like bytes together compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1)[:, :width].T).tobytes()


def unplanes(raw: bytes, width: int, kind: type) -> np.ndarray:
    out = np.zeros((len(raw) // width, np.dtype(kind).itemsize), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, -1).T
    return out.view(kind)[:, 0]


def pack_keys(keys: np.ndarray) -> tuple[int, bytes]:
    """Sorted unsigned keys as first differences in as few bytes each as the largest needs, compressed."""
    d = np.diff(keys, prepend=np.uint64(0))
    width = max(1, -(-int(d.max()).bit_length() // 8)) if len(d) else 1
    return width, squeeze(planes(d, width))


def unpack_keys(width: int, raw: bytes) -> np.ndarray:
    return np.cumsum(unplanes(unsqueeze(raw), width, np.uint64), dtype=np.uint64)


def pack_counts(c: np.ndarray) -> bytes:
    """Counts as one byte each, large ones apart, compressed."""
    large = np.nonzero(c >= 255)[0]
    return squeeze((np.minimum(c, 255).astype(np.uint8), large.astype(np.uint32), c[large].astype(np.int64)))


def unpack_counts(raw: bytes) -> np.ndarray:
    small, at, values = unsqueeze(raw)
    out = small.astype(np.int64)
    out[at] = values
    return out


class Chunk:
    """A run of documents, or of parts of long ones: local word numbers in order, each with the word before the first."""

    def __init__(self):
        self.words = _Vocabulary({START: 0, END: 1})
        self.uids: list[int] = []
        self.ids: list = []
        self.held: list[bool] = []
        self.before: list[int] = []
        self.tokens: list[np.ndarray] = []
        self.size = 0

    def add(self, uid: int, doc_id: int | None, held: bool, words: list[bytes], before: bytes) -> None:
        self.before.append(self.words[before])
        self.tokens.append(np.fromiter(map(self.words.__getitem__, words), np.uint32, len(words)))
        self.uids.append(uid)
        self.ids.append(doc_id)
        self.held.append(held)
        self.size += len(words)

    def finish(self) -> dict:
        digest = xxhash.xxh64_intdigest
        return {
            "hashes": np.fromiter(map(digest, self.words), np.uint64, len(self.words)),
            "uids": np.array(self.uids, np.int64),
            "ids": self.ids,
            "held": np.array(self.held, bool),
            "before": np.array(self.before, np.uint32),
            "lengths": np.array([len(t) for t in self.tokens], np.int64),
            "tokens": planes(np.concatenate(self.tokens), 3 if len(self.words) <= 1 << 24 else 4),
        }


class Grams:
    """The distinct bigrams of a chunk, from one sort of its bigram codes."""

    def __init__(self, c: dict):
        self.c = c
        c["tokens"] = unplanes(c["tokens"], len(c["tokens"]) // int(c["lengths"].sum()), np.uint32)
        cur = c["tokens"].astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(c["lengths"])[:-1]])
        prev = np.empty_like(cur)
        prev[1:] = cur[:-1]
        prev[self.starts] = c["before"]
        v = len(c["hashes"])
        codes = prev * v + cur
        del cur, prev
        self.order = np.argsort(codes)
        codes = codes[self.order]
        self.first = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1])
        self.counts = np.diff(self.first, append=len(codes))
        self.prev, self.cur = np.divmod(codes[self.first], v)

    def keys(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Orders and sorted keys of the words and of the distinct bigrams; alike before sending and on return."""
        h = self.c["hashes"]
        with np.errstate(over="ignore"):
            two = mix64(h[self.prev] * _P + mix64(h * _Q)[self.cur]) >> np.uint64(64 - bits)
        order1, order2 = np.argsort(h), np.argsort(two)
        return order1, h[order1], order2, two[order2]

    def training(self) -> tuple[np.ndarray, np.ndarray]:
        """Training counts of the words (as tokens) and of the distinct bigrams."""
        inside = np.repeat(~self.c["held"], self.c["lengths"])
        two = np.add.reduceat(inside[self.order].astype(np.int64), self.first)
        return np.bincount(self.c["tokens"][inside], minlength=len(self.c["hashes"])), two


def cuts(keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Where each bucket's key range begins in sorted keys."""
    edges = np.array([(b << bits) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _pieces(rows: list) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["chunk", "bucket", "kind", "payload"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as chunks of word numbers."""

    def flush(chunk: Chunk, number: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([chunk.size], pa.int64()), pa.array([squeeze(chunk.finish())], pa.binary())], ["chunk", "tokens", "payload"])

    number, chunk = TaskContext.get().partitionId() << 24, Chunk()
    for b in batches:
        for uid, doc_id, held, text in zip(*b.columns, strict=True):
            words = (text.as_py() or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
            words.append(END)
            at = 0
            while at < len(words):
                part = words[at : at + CHUNK_TOKENS - chunk.size] if at or len(words) > CHUNK_TOKENS else words
                chunk.add(uid.as_py(), doc_id.as_py(), held.as_py(), part, words[at - 1] if at else START)
                at += len(part)
                if chunk.size >= CHUNK_TOKENS:
                    yield flush(chunk, number)
                    number, chunk = number + 1, Chunk()
    if chunk.ids:
        yield flush(chunk, number)


def _send(buckets: int, size: int):
    """Each chunk's distinct n-grams with training counts, as pieces for the buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, payload in zip(*b.columns, strict=True):
                g = Grams(unsqueeze(payload.as_py()))
                one, two = g.training()
                order1, keys1, order2, keys2 = g.keys(size)
                del g
                for kind, keys, counts, bits in (("2", keys2, two[order2], size), ("1", keys1, one[order1], 64)):
                    at = cuts(keys, bits, buckets)
                    yield _pieces([(number.as_py(), i, kind, pickle.dumps((*pack_keys(keys[x:y]), pack_counts(counts[x:y])))) for i, (x, y) in enumerate(zip(at[:-1], at[1:], strict=True)) if y > x])

    return run


def _count(table: pa.Table) -> pa.Table:
    """All chunks' entries of one bucket: sum by key, answer each chunk in its own order; one more row has the statistics."""
    rows = []
    for kind in "12":
        some = table.filter(pc.equal(table.column("kind"), kind))
        if not some.num_rows:
            continue
        blobs = [pickle.loads(p) for p in some.column("payload").to_pylist()]
        keys = [unpack_keys(w, raw) for w, raw, _ in blobs]
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([unpack_counts(c) for _, _, c in blobs])).astype(np.int64)
        del blobs
        if kind == "1":
            rows.append((-1, 0, "sum", pickle.dumps((int(total.sum()), int((total > 0).sum())))))
        at = 0
        for chunk, bucket, k in zip(some.column("chunk").to_pylist(), some.column("bucket").to_pylist(), keys, strict=True):
            rows.append((chunk, bucket, kind, pack_counts(total[inverse[at : at + len(k)]])))
            at += len(k)
    return pa.Table.from_batches([_pieces(rows)])


def _counted(table: pa.Table, size: int) -> tuple[Grams, np.ndarray, np.ndarray]:
    """One chunk's text with the corpus counts of its words and distinct bigrams."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("kind", "bucket", "payload")), strict=True), key=lambda r: r[:2])
    g = Grams(unsqueeze(next(r[2] for r in rows if r[0] == "text")))
    order1, _, order2, _ = g.keys(size)
    counts = []
    for kind, order in (("1", order1), ("2", order2)):
        out = np.empty(len(order), np.int64)
        out[order] = np.concatenate([unpack_counts(r[2]) for r in rows if r[0] == kind])
        counts.append(out)
    one, two = counts
    one[0] = one[1]  # as many starts as ends
    return g, one, two


STATISTICS = "b long, i long, j long, w double, p2 double, p1 double"


def _learned(n: int, size: int):
    """A chunk's part of the EM's statistics."""

    def run(table: pa.Table) -> pa.Table:
        return pa.table(dict(zip([f.split()[0] for f in STATISTICS.split(", ")], _statistics(*_counted(table, size), n), strict=True)))

    return run


def _bin(p: np.ndarray) -> np.ndarray:
    out = np.full(len(p), -1, np.int64)
    out[p > 0] = np.floor(-8 * np.log2(p[p > 0])).astype(np.int64)
    return out


def _statistics(g: Grams, one: np.ndarray, two: np.ndarray, n: int) -> list[np.ndarray]:
    """Weights and sums of the deleted estimates by (context bucket, bigram bin, unigram bin)."""
    w = g.training()[1]
    k = w > 0
    w, c2, cp, cc = w[k], two[k], one[g.prev[k]], one[g.cur[k]]
    p2 = np.where(cp > 1, (c2 - 1) / np.maximum(cp - 1, 1), 0.0)
    p1 = (cc - 1) / max(n - 1, 1)
    key = (np.floor(np.log2(cp)).astype(np.int64) << 24) + ((_bin(p2) + 1) << 12) + _bin(p1) + 1
    u, inverse = np.unique(key, return_inverse=True)
    return [u >> 24, (u >> 12 & 4095) - 1, (u & 4095) - 1, *(np.bincount(inverse, weights=w * x, minlength=len(u)).astype(float) for x in (np.ones(len(w)), p2, p1))]


def learn(table: list, v: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of each context bucket by expectation-maximisation; row 0 also serves new contexts."""
    top = max((int(r[0]) for r in table), default=0)
    out = np.tile([0.0, 0.0, 1.0], (top + 1, 1))
    for b in range(top + 1):
        rows = np.array([r[3:] for r in table if r[0] == b], float).reshape(-1, 3)
        if not len(rows):
            if b:
                out[b] = out[b - 1]
            continue
        w = rows[:, 0]
        p = np.column_stack([rows[:, 1] / w, rows[:, 2] / w, np.full(len(w), 1 / (v + 1))])
        x = np.full(3, 1 / 3)
        for _ in range(rounds):
            mix = p * x
            new = (w[:, None] * mix / mix.sum(axis=1, keepdims=True)).sum(axis=0) / w.sum()
            moved, x = np.abs(new - x).max(), new
            if moved <= STILL:
                break
        out[b] = x
    return out


def _scored(n: int, v: int, weights: np.ndarray, size: int):
    """A chunk's documents, or parts of them, scored."""

    def run(table: pa.Table) -> pa.Table:
        g, one, two = _counted(table, size)
        cp, cc = one[g.prev], one[g.cur]
        bucket = np.minimum(np.floor(np.log2(np.maximum(cp, 1))).astype(np.int64), len(weights) - 1)
        x = weights[bucket]
        p = x[:, 0] * two / np.maximum(cp, 1) + x[:, 1] * cc / max(n, 1) + x[:, 2] / (v + 1)
        each = np.empty(len(g.order))
        each[g.order] = np.repeat(np.log10(p), g.counts)
        base = np.log10((one + 0.1) / (n + 0.1 * (v + 1)))
        tokens = g.c["tokens"]
        sums = [np.add.reduceat(a, g.starts) for a in ((one > 0)[tokens].astype(np.int64), base[tokens], each)]
        columns = [pa.array(g.c["uids"]), pa.array(g.c["ids"], pa.int64()), pa.array(g.c["held"]), pa.array(g.c["lengths"]), *map(pa.array, sums)]
        return pa.table(dict(zip([f.split()[0] for f in PART.split(", ")], columns, strict=True)))

    return run


def score(docs: DataFrame, folds: int = FOLDS) -> DataFrame:
    """SCORED of each row of (doc_id, text); rows of fold 0 are held out of all counts."""
    held = (crc_mod("doc_id", folds) == 0).alias("held")
    docs = columns(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), held, F.col("text").cast("string").alias("text"))
    # payloads are compressed already
    texts = cut(docs.mapInArrow(_read, TEXT), "texts", "none")
    total = texts.agg(F.sum("tokens")).first()[0] or 0
    buckets = max(2 * partitions(docs.sparkSession), -(-total // BUCKET_TOKENS))
    size = min(64, int(total).bit_length() + SPARE)
    keys = texts.select("chunk", "payload").mapInArrow(_send(buckets, size), PIECE)
    counts = cut(keys.groupBy("bucket").applyInArrow(_count, PIECE), "counts", "none")
    sums = [pickle.loads(r[0]) for r in counts.where("chunk = -1").select("payload").collect()]  # a row a bucket
    settle(docs.sparkSession)
    n, v = sum(s[0] for s in sums), sum(s[1] for s in sums)
    own = texts.select("chunk", F.lit(-1).alias("bucket"), F.lit("text").alias("kind"), "payload")
    # gathered once for the statistics and once for the scores: what was gathered is as large as the tables, and not kept
    whole = own.unionAll(counts.where("chunk >= 0")).groupBy("chunk")
    table = whole.applyInArrow(_learned(n, size), STATISTICS).groupBy("b", "i", "j").agg(F.sum("w"), F.sum("p2"), F.sum("p1")).collect()  # at most buckets x bins x bins rows
    settle(docs.sparkSession)
    parts = whole.applyInArrow(_scored(n, v, learn(sorted(table), v), size), PART)
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    return parts.groupBy("uid", "doc_id", "held_out").agg(*sums).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
