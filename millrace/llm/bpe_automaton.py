"""Byte-pair encoding by a tokenization automaton, and decoding by its arc labels.

The automaton reads tokens: an arc labelled b leads to b's state, from which the tokens that may follow b leave.
It begins as one state with an arc for every base token. Merges are compiled into it in rank order, each as a
gadget: the merge of u and v into x puts an arc x wherever u may be followed by v, leading where v's arcs lead,
and gives u's arcs a new state, a copy of the old one without its arc v, so that u and v can no longer stand side
by side. All arcs of one label lead to one state throughout, so the automaton stays deterministic and gains at most
one state a merge.

A state's table lists the labels that are cut from it; all others leave it. Labels are numbered along the trees of
left parts, latest merges first: a cut at rank k takes from a state the label v and the labels that later gadgets
would have put there because of it, and these have consecutive numbers. So each gadget adds one interval, a state's
table is a short sorted list of intervals, and an arc is one binary search in it.

A word is encoded by running the automaton over it: each position is reached by the one label whose arc leaves the
state of the position where it begins. Decoding looks up each id's label and emits the labels in order.

Texts are split at special tokens, then at white space; each distinct chunk is normalised, cut by the
pre-tokenizer's pattern and run through the automaton once per worker (bounded cache).

Cases: a null text is empty: no ids, empty decoding. Special tokens' strings in a text are those tokens.
Repeated rows stay; an empty table gives an empty result; extra columns are not read. Words of any length are
encoded whole in time linear in their length.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import columns

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Cached chunks and words of a worker; beyond this the cache starts anew.
CACHE = 250_000
#: The white space of the tokenizer's pattern engine (Unicode White_Space).
_SPACE = "\t\n\x0b\x0c\r\x20\x85\xa0  -     　"
_SPLIT = regex.compile(f"[{_SPACE}]+")
#: Characters at which str.split() would also split.
_ODD = regex.compile("[\x1c-\x1f]")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself if printable, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Automaton:
    """``state``: where each label's arcs lead; ``place``: its number; a state's cut intervals are rows
    ``first[state]`` to ``first[state + 1]`` of ``starts`` and ``stops``."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = ""):
        rules = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        self.place, until = _numbers(vocab.values(), rules)
        cuts: list[list[tuple[int, int]]] = [[]]
        state = dict.fromkeys(vocab.values(), 0)
        made = {x for _, _, x in rules}
        for k, (u, v, x) in enumerate(rules):
            if u in made or v in made or x not in made:
                raise ValueError("merges must build each token once, after its parts")
            made.discard(x)
            state[x] = state[v]
            cuts.append([*cuts[state[u]], (self.place[v], until(v, k))])
            state[u] = len(cuts) - 1
        # only states that some arc still leads to
        used = {s: i for i, s in enumerate(dict.fromkeys(state.values()))}
        tables = [_joined(cuts[s]) for s in used]
        self.state = {t: used[s] for t, s in state.items()}
        self.first = array("q", np.cumsum([0, *map(len, tables)]).tolist())
        self.starts = array("i", chain.from_iterable((a for a, _ in t) for t in tables))
        self.stops = array("i", chain.from_iterable((b for _, b in t) for t in tables))
        bare = [t for t in vocab if not (end and t.endswith(end))]
        self.inner = {t: vocab[t] for t in bare}
        self.final = {t[: -len(end)]: vocab[t] for t in vocab if end and t.endswith(end)} if end else self.inner
        self.longest = max(map(len, [*self.inner, *self.final]), default=1)

    def arc(self, state: int, label: int) -> bool:
        """Whether an arc with this label leaves the state."""
        low, place = self.first[state], self.place[label]
        i = bisect_right(self.starts, place, low, self.first[state + 1]) - 1
        return i < low or self.stops[i] <= place

    def encode(self, word: str) -> list[int]:
        """Labels of the only path that spells ``word``."""
        n, arc, state_of = len(word), self.arc, self.state
        label = [-1] * (n + 1)
        since = [0] * (n + 1)
        inner, final, longest = self.inner.get, self.final.get, self.longest
        for i in range(1, n + 1):
            find = inner if i < n else final
            # only one arc can end here, so the order of trying is free: the last token one longer, then new ones
            j = last = since[i - 1]
            low = max(0, i - longest)
            while True:
                here = find(word[j:i])
                if here is not None and (not j or (label[j] >= 0 and arc(state_of[label[j]], here))):
                    label[i], since[i] = here, j
                    break
                if j == last:
                    last, j = -1, i
                j -= 1
                if j < low:
                    if i == n:
                        raise ValueError(f"no path spells {word!r}")
                    break
        out = []
        while n:
            out.append(label[n])
            n = since[n]
        return out[::-1]


def _numbers(tokens, rules: list[tuple[int, int, int]]):
    """Each token's number, parents before children in the trees of left parts and later merges before earlier ones;
    and, for a token and a rank, where the numbers of it and of what later merges make from it end."""
    kids: dict[int, list[tuple[int, int]]] = {}
    for k, (u, _, x) in enumerate(rules):
        kids.setdefault(u, []).append((k, x))
    made = {x for _, _, x in rules}
    place: dict[int, int] = {}
    stop: dict[int, int] = {}
    stack = [(t, False) for t in tokens if t not in made]
    while stack:
        t, done = stack.pop()
        if done:
            stop[t] = len(place)
            continue
        place[t] = len(place)
        stack.append((t, True))
        stack += [(x, False) for _, x in kids.get(t, ())]  # the last pushed, the latest merge, is numbered first

    def until(token: int, rank: int) -> int:
        older = kids.get(token, [])
        i = bisect_left(older, (rank,))
        return place[older[i - 1][1]] if i else stop[token]

    return place, until


def _joined(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Encoder:
    """A tokenizer file's text pipeline around the automaton: NFC, white space, lower case, pattern, byte letters."""

    def __init__(self, spec: dict):
        model = spec["model"]
        if [x["type"] for x in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"] or spec["decoder"] or model["type"] != "BPE":
            raise ValueError("this tokenizer file's pipeline is not supported")
        self.automaton = Automaton(model["vocab"], [tuple(m) for m in model["merges"]], model["end_of_word_suffix"] or "")
        self.raw = {i: i.to_bytes(4, "little") for i in model["vocab"].values()}
        self.label = {i: t for t, i in model["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.marks = [t[:2] for t in self.special]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern.replace(r"[^\s", f"[^{_SPACE}"))
        self.letters = byte_letters()
        self.words: dict[str, bytes] = {}
        self.chunks = _Chunks(self)

    def word(self, piece: str) -> bytes:
        found = self.words.get(piece)
        if found is None:
            if len(self.words) >= CACHE:
                self.words.clear()
            ids = self.automaton.encode("".join(map(self.letters.__getitem__, piece.encode("utf-8", "surrogatepass"))))
            found = self.words[piece] = b"".join(map(self.raw.__getitem__, ids))
        return found

    def chunk(self, text: str) -> bytes:
        """Ids (little-endian, 4 bytes each) of text without white space and special tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        else:
            text = text.lower()
        return b"".join(map(self.word, self.pieces.findall(text)))

    def _plain(self, text: str) -> bytes:
        chunks = [c for c in _SPLIT.split(text) if c] if _ODD.search(text) else text.split()
        if len(self.chunks) > CACHE:
            self.chunks.clear()
        return b"".join(map(self.chunks.__getitem__, chunks))

    def encode(self, text: str) -> bytes:
        """All ids as bytes."""
        if not any(m in text for m in self.marks):
            return self._plain(text)
        return b"".join(self.special[p].to_bytes(4, "little") if p in self.special else self._plain(p) for p in self.cut.split(text) if p)

    def decode(self, ids: bytes) -> str:
        """The ids' labels, joined as a tokenizer without decoder joins them."""
        return " ".join(map(self.label.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Chunks(dict):
    """chunk -> ids; long ones are not kept."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, chunk: str) -> bytes:
        found = self.encoder.chunk(chunk)
        if len(chunk) < 200:
            self[chunk] = found
        return found


_encoders: dict[str, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """The worker's encoder for a tokenizer file's content, compiled once."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(json.loads(spec))
    return _encoders[key]


def encode_decode(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """SCHEMA of each row of (doc_id, text). No shuffle; the tokenizer file's text (a few MB) is broadcast."""
    docs = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(spec.value)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for text in b.column(1):
                ids = e.encode(text.as_py() or "")
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(e.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.mapInArrow(run, SCHEMA)
