"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

The network reads the lower-cased UTF-8 bytes of one word at a time (white space ends a word; words of more than
``WINDOW`` bytes are read in windows), forwards and backwards, and gives every byte position a distribution over
the languages. A document's probabilities are the mean over all positions of all its words with a letter. Because
the recurrent state lives within a word, a worker evaluates each distinct word once (bounded cache) and whole
texts cost little more than splitting them.

Training uses a bounded sample of labelled rows outside the held-out fold (``DOCS_PER_LANGUAGE`` documents a
language, at most ``MAX_DOCS`` in all), chosen by a hash of doc_id, so it is the same at every run. All words of
their whole texts are learned from, in as many rounds as give at least ``LEAST_WORDS`` word visits, one at least.
doc_id, source and lang are not inputs of a prediction.

Cases: null text, or text without a letter, is ``und`` with score 0; without any labelled training row all is
``und``; one learned language gives it score 1; repeated rows are predicted each; null doc_id hashes as the
empty text; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import columns, crc_mod, give_back

DOCS_PER_LANGUAGE, MAX_DOCS = 400, 20_000
WINDOW, HIDDEN, BATCH, RATE = 32, 16, 256, 0.01
LEAST_WORDS, MOST_ROUNDS = 400_000, 3
CACHE = 100_000
#: Below this mean probability a document's language counts as not told.
MIN_SCORE = 0.3
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER.search(text)) or (not text.isascii() and any(map(str.isalpha, text)))


def windows(word: str) -> list[bytes]:
    raw = word.encode("utf-8", "surrogatepass")
    return [raw[i : i + WINDOW] for i in range(0, len(raw), WINDOW)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class BiGRU:
    """Parameters of both directions and the output layer; all batches hold words of one length."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7):
        r = np.random.default_rng(seed)
        h, self.labels, self.h = hidden, labels, hidden
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p[d + "x"] = r.normal(0, 0.3, (256, 3 * h))  # input weights: one row a byte
            self.p[d + "u"] = r.normal(0, 1 / np.sqrt(h), (h, 3 * h))
        self.p["o"] = r.normal(0, 1 / np.sqrt(h), (2 * h, len(labels)))
        self.p["c"] = np.zeros(len(labels))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _direction(self, d: str, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States (time, batch, hidden) in the order of x's columns, and what the backward pass needs."""
        h, table, u = self.h, self.p[d + "x"], self.p[d + "u"]
        n, t = x.shape
        state, out, kept = np.zeros((n, h), np.float32), np.empty((t, n, h), np.float32), []
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            a, b = table[x[:, i]], state @ u
            zr = _sigmoid(a[:, : 2 * h] + b[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            c = np.tanh(a[:, 2 * h :] + r * b[:, 2 * h :])
            new = c + z * (state - c)
            if keep:
                kept.append((i, state, z, r, c, b[:, 2 * h :]))
            out[i] = state = new
        return out, kept

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (batch, time, labels)."""
        both = np.concatenate([self._direction(d, x, False)[0] for d in "fb"], axis=2)
        s = both @ self.p["o"] + self.p["c"]
        s = np.exp(s - s.max(axis=2, keepdims=True))
        return (s / s.sum(axis=2, keepdims=True)).transpose(1, 0, 2)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions and its gradient, by backpropagation through time."""
        h, (n, t) = self.h, x.shape
        runs = {d: self._direction(d, x, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        s = both @ self.p["o"] + self.p["c"]
        s = np.exp(s - s.max(axis=2, keepdims=True))
        s /= s.sum(axis=2, keepdims=True)
        loss = float(-np.log(s[:, np.arange(n), y] + 1e-12).mean())
        s[:, np.arange(n), y] -= 1
        s /= n * t
        g = {"o": both.reshape(n * t, -1).T @ s.reshape(n * t, -1), "c": s.sum((0, 1))}
        back = s @ self.p["o"].T
        for j, d in enumerate("fb"):
            u = self.p[d + "u"]
            gx, gu = np.zeros_like(self.p[d + "x"]), np.zeros_like(u)
            later = np.zeros((n, h), np.float32)
            for i, state, z, r, c, b in reversed(runs[d][1]):
                e = later + back[i, :, j * h : (j + 1) * h]
                ec = e * (1 - z) * (1 - c * c)
                ez = e * (state - c) * z * (1 - z)
                er = ec * b * r * (1 - r)
                into = np.concatenate([ez, er, ec], axis=1)
                rec = np.concatenate([ez, er, ec * r], axis=1)
                np.add.at(gx, x[:, i], into)
                gu += state.T @ rec
                later = e * z + rec @ u.T
            g[d + "x"], g[d + "u"] = gx, gu
        return loss, g

    def fit(self, words: list[tuple[bytes, int]], epochs: int | None = None, seed: int = 11) -> None:
        """Adam over batches of equal length in a fixed random order."""
        epochs = epochs or min(MOST_ROUNDS, -(-LEAST_WORDS // max(1, len(words))))
        r = np.random.default_rng(seed)
        by_length: dict[int, list] = defaultdict(list)
        for w, y in words:
            by_length[len(w)].append((w, y))
        sets = {k: (np.frombuffer(b"".join(w for w, _ in v), np.uint8).reshape(-1, k), np.array([y for _, y in v])) for k, v in sorted(by_length.items())}
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step, total = 0, epochs * sum(-(-len(y) // BATCH) for _, y in sets.values())
        for _ in range(epochs):
            order = []
            for k, (x, _) in sets.items():
                shuffled = r.permutation(len(x))
                order += [(k, shuffled[i : i + BATCH]) for i in range(0, len(x), BATCH)]
            for i in r.permutation(len(order)):
                k, rows = order[i]
                _, g = self.gradients(sets[k][0][rows], sets[k][1][rows])
                step += 1
                rate = RATE * (1 - step / (total + 1)) * min(1.0, len(rows) / 32)
                for name, d in g.items():
                    m[name] = 0.9 * m[name] + 0.1 * d
                    v[name] = 0.999 * v[name] + 0.001 * d * d
                    self.p[name] = (self.p[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


class Reader:
    """Pooled probabilities of whole texts; each distinct word is evaluated once while it stays cached."""

    def __init__(self, model: BiGRU):
        self.model, self.n = model, len(model.labels)
        self._clear()

    def _clear(self) -> None:
        self.row: dict[str, int] = {}
        self.sums = np.zeros((1024, self.n + 1), np.float32)

    def rest(self) -> None:
        """Between tasks a worker keeps only a small cache: it may next work for another stage."""
        if len(self.row) > CACHE // 4:
            self._clear()

    def _learn(self, new: list[str]) -> None:
        base = len(self.row)
        while len(self.sums) < base + len(new):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        self.sums[base : base + len(new)] = 0
        by_length: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
        for i, w in enumerate(new):
            self.row[w] = base + i
            if has_letter(w):
                for part in windows(w):
                    by_length[len(part)][0].append(part)
                    by_length[len(part)][1].append(base + i)
        for k, (parts, rows) in by_length.items():
            for lo in range(0, len(parts), 2048):
                x = np.frombuffer(b"".join(parts[lo : lo + 2048]), np.uint8).reshape(-1, k)
                p = self.model.positions(x).sum(axis=1)
                np.add.at(self.sums, rows[lo : lo + 2048], np.concatenate([p, np.full((len(p), 1), k, np.float32)], axis=1))

    def texts(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if len(self.row) > CACHE:
            self._clear()
        words = [(t or "").lower().split() for t in texts]
        new = dict.fromkeys(w for ws in words for w in ws if w not in self.row)
        if new:
            self._learn(list(new))
        labels, scores = [], []
        for t, ws in zip(texts, words, strict=True):
            total = self.sums[np.fromiter(map(self.row.__getitem__, ws), np.int64, len(ws))].sum(axis=0, dtype=np.float64) if ws else np.zeros(self.n + 1)
            if total[-1] > 0 and has_letter(t):
                p = total[:-1] / total[-1]
                k = int(p.argmax())
                labels.append(self.model.labels[k])
                scores.append(min(1.0, float(p[k])))
            else:
                labels.append("und")
                scores.append(0.0)
        return labels, scores


_readers: dict[str, Reader] = {}


def _reader(key: str, model: BiGRU) -> Reader:
    """The worker's reader of a model, kept from task to task."""
    if key not in _readers:
        _readers.clear()
        _readers[key] = Reader(model)
    return _readers[key]


def _send(docs: DataFrame, model: BiGRU) -> tuple:
    key = hashlib.sha256(repr(model.labels).encode() + b"".join(v.tobytes() for _, v in sorted(model.p.items()))).hexdigest()
    return key, docs.sparkSession.sparkContext.broadcast(model)


def train(docs: DataFrame, folds: int = 5) -> BiGRU | None:
    """A model of the lang values of labelled rows outside fold 0, or None if there are none."""
    rows = columns(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod("doc_id", folds) != 0))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    most = max(1, min(DOCS_PER_LANGUAGE, MAX_DOCS // len(counts)))
    # the rows of each language with the smallest hashes, about ``most`` of them
    place = (F.xxhash64("doc_id", F.lit("sample")).bitwiseAND((1 << 53) - 1) / float(1 << 53)).alias("u")
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, most / n)))])
    sample = rows.where(place < share[F.col("lang")]).select("lang", "text").collect()  # a bounded number of rows
    labels = sorted(counts)
    at = {k: i for i, k in enumerate(labels)}
    words = [(part, at[r["lang"]]) for r in sample for w in r["text"].lower().split() if has_letter(w) for part in windows(w)]
    words.sort()
    model = BiGRU(labels)
    model.fit(words)
    del sample, words
    gc.collect()
    return model


def predict(docs: DataFrame, model: BiGRU | None, folds: int = 5) -> DataFrame:
    """SCHEMA of each row of (doc_id, text); no shuffle, the model (some 100 KB) is broadcast."""
    held = (crc_mod("doc_id", folds) == 0).alias("held_out")
    docs = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), held, F.col("text").cast("string").alias("text"))
    if model is None:
        return docs.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    key, sent = _send(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(key, sent.value)
        for b in batches:
            labels: list[str] = []
            scores: list[float] = []
            for lo in range(0, b.num_rows, 256):
                some = reader.texts(b.column(2).slice(lo, 256).to_pylist())
                labels += some[0]
                scores += some[1]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])
        reader.rest()
        give_back()

    return docs.mapInArrow(run, SCHEMA)


def keep_identified(docs: DataFrame, model: BiGRU | None, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows whose language the model can tell (not ``und``, score at least ``min_score``), lang set to it; same columns.

    Without a model nothing is rejected.
    """
    if model is None:
        return docs
    key, sent = _send(docs, model)
    at = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(key, sent.value)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                some = b.slice(lo, 256)
                labels, scores = reader.texts(some.column(at[0]).to_pylist())
                some = some.set_column(at[1], "lang", pa.array(labels, pa.string()))
                yield some.filter(pa.array([k != "und" and s >= min_score for k, s in zip(labels, scores, strict=True)], pa.bool_()))
        reader.rest()
        give_back()

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, train(docs))
