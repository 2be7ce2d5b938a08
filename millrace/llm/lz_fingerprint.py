"""Lempel-Ziv phrase fingerprints: dictionary phrases of a text, hashed, as a minimum-hash signature.

A text is parsed left to right into the shortest phrases not yet in its dictionary (the LZ78 rule; an
unfinished last phrase adds nothing). The phrase set's 64-bit hashes fall into ``BINS`` bins and each bin keeps
its minimum (one-permutation hashing); the fingerprint is four hex digits a bin, ``0000`` for an empty bin.
The likeness of two fingerprints is the share of equal bins among those filled in either: an estimate of the
Jaccard similarity of the phrase sets, hence of how well one text's dictionary compresses the other.

Cases: a null text is the empty text, whose fingerprint has all bins empty; two empty fingerprints have
likeness 1. Rows are ordered by doc_id, nulls first, ties by text (null as empty; by a hash of the text first where
one id, or none, fills several parts); a single row is its own next row. Repeated rows stay. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import columns, mix64, partitions

BINS = 64
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(58)
#: An odd multiplier of the position-free rolling hash, and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def parse(text: str, start: int, seen: set, limit: int, starts: list, ends: list) -> int:
    """Parse from ``start`` until a phrase would end beyond ``limit``; give the start of that phrase.

    The dictionary is closed under prefixes, so the search for the shortest new phrase may begin at the
    last phrase's length and go up or down from there.
    """
    i, k, n = start, 3, len(text)
    add, begin, end = seen.add, starts.append, ends.append
    while i < n:
        e = i + k
        p = text[i:e]
        if p in seen:
            while e < n:
                e += 1
                p = text[i:e]
                if p not in seen:
                    break
            else:
                return i
        else:
            if e > n:
                e = n
            q = text[i : e - 1]
            while q and q not in seen:
                p, e = q, e - 1
                q = text[i : e - 1]
        if e > limit:
            return i
        add(p)
        begin(i)
        end(e)
        k = e - i
        i = e
    return i


class Hasher:
    """Hashes of many phrases of one text at once, from prefix sums of its code points."""

    def __init__(self):
        self.down = np.ones(1, np.uint64)
        self.up = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        with np.errstate(over="ignore"):
            while len(self.down) < n:
                m = len(self.down)
                step_down, step_up = np.uint64(pow(_INVERSE, m, 1 << 64)), np.uint64(pow(_BASE, m, 1 << 64))
                self.down = np.concatenate([self.down, self.down * step_down])
                self.up = np.concatenate([self.up, self.up * step_up])

    def phrases(self, text: str, starts: list, ends: list) -> np.ndarray:
        if not starts:
            return np.zeros(0, np.uint64)
        n = len(text)
        self._grow(n + 1)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        total = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(points * self.down[:n], out=total[1:])
            i, e = np.array(starts), np.array(ends)
            return mix64((total[e] - total[i]) * self.up[i])


def signature(hashes: np.ndarray) -> np.ndarray:
    """BINS 16-bit values; 0 marks an empty bin."""
    out = np.zeros(BINS, np.uint16)
    if len(hashes):
        h = np.sort(hashes)
        at = np.searchsorted(h, _EDGES)
        bins = (h[np.minimum(at, len(h) - 1)] >> np.uint64(58)).astype(np.int64)
        full = (at < len(h)) & (bins == np.arange(BINS))
        low = (h[at[full]] & np.uint64(0xFFFF)).astype(np.uint16)
        out[full] = np.maximum(low, 1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    either = (a > 0) | (b > 0)
    n = int(either.sum())
    return float(((a == b) & either).sum()) / n if n else 1.0


def as_text(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def fingerprint(text: str | None, hasher: Hasher | None = None) -> np.ndarray:
    text = text or ""
    starts: list = []
    ends: list = []
    parse(text, 0, set(), len(text), starts, ends)
    return signature((hasher or Hasher()).phrases(text, starts, ends))


def with_edited(text: str, following: str, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, str]:
    """Signatures of the text and of its edited text, and the edited text; the shared beginning is parsed once."""
    n = len(text)
    keep = n - n // 2
    edited = text[:keep] + following[: n // 2]
    starts: list = []
    ends: list = []
    seen: set = set()
    at = parse(text, 0, seen, keep, starts, ends)
    own, own_starts, own_ends = seen.copy(), starts[:], ends[:]
    parse(text, at, own, n, own_starts, own_ends)
    parse(edited, at, seen, len(edited), starts, ends)
    return signature(hasher.phrases(text, own_starts, own_ends)), signature(hasher.phrases(edited, starts, ends)), edited


#: Where rows without an id stand in the order of ids.
_NO_ID = int(np.iinfo(np.int64).min)
_SALT_BITS = 53
_DEALT = "part int, ghost byte, doc_id long, salt long, text string"


def _bounds(quantiles: list[int], null_parts: int) -> list[tuple[int, int]]:
    """First (id, salt) of each part but the first. An id that fills several quantiles, or the missing one, is
    divided evenly by its salt, a hash of the text."""
    out = [(_NO_ID, (j << _SALT_BITS) // null_parts) for j in range(1, null_parts)]
    for c, m in sorted(Counter(quantiles).items()):
        out += [(c, (j << _SALT_BITS) // m) for j in range(m)]
    return sorted(set(out))


def _deal(bounds: list[tuple[int, int]], before: dict):
    """Give rows of (doc_id, salt, text) their part; a part's first row also goes, marked, to the part before."""
    ids, salts = (np.array(x, np.int64) for x in (zip(*bounds, strict=True) if bounds else ((), ())))
    divided = [v for v, m in Counter(ids.tolist()).items() if m > 1 or v == _NO_ID]
    names = [f.split()[0] for f in _DEALT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            value = b.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            salt = b.column(1).to_numpy(zero_copy_only=False)
            part = np.searchsorted(ids, value, side="right")
            for v in divided:
                mine = value == v
                part[mine] = np.searchsorted(ids, v) + np.searchsorted(salts[ids == v], salt[mine], side="right")
            for lo in range(0, max(1, b.num_rows), 512):
                own, some = part[lo : lo + 512].astype(np.int32), b.slice(lo, 512)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.zeros(len(own), np.int8)), *some.columns], names)
                firsts: dict[int, tuple] = {}
                for j, key in enumerate(zip(own.tolist(), value[lo : lo + 512].tolist(), salt[lo : lo + 512].tolist(), strict=True)):
                    if key[0] in before and before[key[0]][0] == key[1:]:
                        text = some.column(2)[j].as_py()
                        row = (value[lo + j] != _NO_ID or some.column(0)[j].is_valid, text is not None, text or "", j)
                        firsts[key[0]] = min(firsts.get(key[0], row), row)
                if firsts:
                    some = some.take(pa.array([row[-1] for row in firsts.values()]))
                    to = np.array([before[p][1] for p in firsts], np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(np.ones(len(to), np.int8)), *some.columns], names)

    return run


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by part, ghost, doc_id, text: each row's next row is the one after it."""
    hasher = Hasher()
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    held = None  # part, doc_id, text
    waiting = None  # the row before, complete but for near_next, and its signature
    out: list = []

    def finish(part, doc_id, text, following, last):
        nonlocal waiting
        sig, edited_sig, edited = with_edited(text, following, hasher)
        row = [doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_text(sig), as_text(edited_sig), likeness(sig, edited_sig), None]
        if waiting is not None:
            waiting[0][6] = likeness(waiting[1], sig)
            out.append(waiting[0])
        if last:
            row[6] = likeness(sig, fingerprint(following, hasher))
            out.append(row)
            waiting = None
        else:
            waiting = (row, sig)

    for b in batches:
        for part, ghost, doc_id, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held is not None:
                if held[0] == part:
                    finish(*held, text or "", bool(ghost))
                elif waiting is not None:  # cannot happen while every part ends with a ghost
                    raise RuntimeError("a part has no following row")
            held = None if ghost else (part, doc_id, text or "")
        if len(out) >= 500:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
            out = []
    if held is not None:
        raise RuntimeError("a part has no following row")
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """SCHEMA of each row of (doc_id, text).

    One shuffle of the texts: rows are dealt by ranges of doc_id whose bounds come from a quantile sketch of
    the ids (bounded by the number of parts), and a part's first row is also sent to the part before. An id that
    many rows share, or lack, is dealt over as many parts as it fills, by a hash of the text; only rows equal in
    id and text stay together.
    """
    docs = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n = partitions(docs.sparkSession)
    parts = parts or 8 * n
    quantiles = docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else []
    rows, named = docs.agg(F.count("*"), F.count("doc_id")).first()
    bounds = _bounds([int(c) for c in quantiles], -(-(rows - named) * parts // max(1, rows)))
    divided = [v for v, m in Counter(v for v, _ in bounds).items() if m > 1 or v == _NO_ID]
    place = F.coalesce("doc_id", F.lit(_NO_ID))
    salt = F.when(place.isin(divided), F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND((1 << _SALT_BITS) - 1)).otherwise(F.lit(0)) if divided else F.lit(0)
    salted = docs.select("doc_id", salt.cast("long").alias("salt"), "text")
    lows = salted.select("doc_id", "salt", F.lit(None).cast("string").alias("text")).mapInArrow(_deal(bounds, {}), _DEALT)
    firsts = sorted((r[0], tuple(r[1])) for r in lows.groupBy("part").agg(F.min(F.struct(place.alias("id"), "salt"))).collect())
    before = {p: (low, firsts[i - 1][0]) for i, (p, low) in enumerate(firsts)}
    dealt = salted.mapInArrow(_deal(bounds, before), _DEALT).repartitionById(n, F.pmod("part", F.lit(n)))
    return dealt.sortWithinPartitions("part", "ghost", "doc_id", "salt", "text").select("part", "ghost", "doc_id", "text").mapInArrow(_walk, SCHEMA)
