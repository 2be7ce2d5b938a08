"""Personal data: fixed base rules, then bootstrapped contextual extraction of identifiers they miss.

One pass over the texts finds the base spans and every other identifier-like token, each with its patterns: the
last word before it with the marks between (``token = "``), the last two words, and its own shape (``+9 (999)
999-9999``). Base spans are seeds; so are long hexadecimal strings, of the added kind ``secret``, which are not base
spans and count only where a pattern vouches for them. Patterns and instances make a bipartite graph. Spark scores
it for ``ROUNDS`` rounds: a pattern's confidence in a kind is the score its instances carry for that kind over the
weight of all its identifier-like tokens (plus ``SMOOTHING``, so few sightings never suffice); a loose candidate's
score is the noisy-or of its patterns' confidences. Candidates whose best pattern reaches ``CONFIDENT`` in the end
become spans of their kind.

Loose candidates: addresses with a spelt-out or bracketed at/dot, dotted quads with bracketed or spaced dots,
card numbers with other separators that pass Luhn, phone numbers without a plus sign, phone numbers that a base
match swallowed together with what follows, and strings of 16 or more letters and digits (secrets).

Texts are scanned in linear time; patterns and instances of any length count whole (long ones as their hash).

Cases: null text is empty; a document without spans has zero counts, an empty span list and the hash of the
empty string; a candidate that overlaps a base span or an earlier candidate is dropped; repeated rows are judged one
by one (equal values share a node of the graph); an empty table gives an empty result; extra columns are not read.
Offsets are code points, ends exclusive; ties in the order of spans go by end.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import columns, cut

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
ROUNDS = 3
SMOOTHING = 3.0
CONFIDENT = 0.8

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile("[0-9]")
# A match may only begin where a run of digits begins, because every match ends where one ends.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_LOOSE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?[\[({](?:at|AT|@)[\])}]\s?[A-Za-z0-9-]{1,63}(?:(?:\.|\s?[\[({](?:dot|DOT|\.)[\])}]\s?)[A-Za-z0-9-]{1,63}){1,8}"),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\]|\x20\.\x20)[0-9]{1,3}){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[._/\x20-]{1,2}[0-9]{2,7}){2,4}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+(.])(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[\x20./-]{1,2}[0-9]{2,5}){1,4}(?![0-9])"),
}
_HEX = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Fa-f]*[0-9])(?=[0-9]*[A-Fa-f])[0-9A-Fa-f]{32,}+(?![A-Za-z0-9+/_-])")
_KEY = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{16,}+")
# only from the beginning of a run without white space, so that a run is read once
_OTHER = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
_WORD = re.compile(r"[^\W\d_]+")
_DIGITS, _LETTERS = re.compile("[0-9]"), re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind, then start."""
    out = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if len(m[0]) >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        for m in _PHONE.finditer(text) if "+" in text else ():
            if 9 <= len(_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


class _Taken:
    """Disjoint spans in order; overlap by binary search."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def free(self, s: int, e: int) -> bool:
        i = bisect_right(self.starts, s)
        return not (i and self.ends[i - 1] > s) and not (i < len(self.starts) and self.starts[i] < e)

    def add(self, s: int, e: int) -> None:
        i = bisect_right(self.starts, s)
        self.starts.insert(i, s)
        self.ends.insert(i, e)


def _short(x: str) -> str:
    """Any string as one of at most 100 characters; a longer one as its hash."""
    return x if len(x) <= 100 else hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()


def shape(value: str) -> str:
    """Digits as 9, runs of letters as a."""
    return _LETTERS.sub("a", _DIGITS.sub("9", value))


def _patterns(text: str, words: list[tuple[int, int]], firsts: list[int], s: int, e: int) -> list[str]:
    """The last word before ``s`` with the marks between, the last two words, and the value's shape."""
    i = bisect_right(firsts, s)
    while i and words[i - 1][1] > s:
        i -= 1
    before = [text[words[i - k][0] : s] for k in (1, 2) if i >= k]
    return list(dict.fromkeys([*(_short(" ".join(x.lower().split())) for x in before), _short("shape " + shape(text[s:e]))]))


def _swallowed(text: str) -> Iterator[tuple[int, int]]:
    """The longest beginning, up to a blank, of each dropped phone match that has as many digits as a phone number."""
    for m in _PHONE.finditer(text):
        if len(_digits(m[0])) > 15:
            best, seen, at = 0, 0, m.start()
            for part in m[0].split(" "):
                seen += len(_digits(part))
                at += len(part) + 1
                if seen > 15:
                    break
                if seen >= 9 and part[-1:].isdigit():
                    best = at - 1
            if best:
                yield m.start(), best


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, role) of all identifier-like tokens; role is seed, strict (a seed that is no base span),
    loose or other (kind '')."""
    out = [(k, s, e, "seed") for k, s, e in base]
    if not (_DIGIT.search(text) or "@" in text or "[" in text or "(" in text or "{" in text):
        return out
    taken = _Taken([(s, e) for _, s, e in base])

    def take(kind: str, s: int, e: int, role: str) -> None:
        if taken.free(s, e):
            out.append((kind, s, e, role))
            taken.add(s, e)

    for m in _HEX.finditer(text):
        take("secret", *m.span(), "strict")
    if "+" in text:
        for s, e in _swallowed(text):
            take("phone", s, e, "loose")
    for kind in KINDS:
        if kind != "email" or "@" in text or "at" in text or "AT" in text:
            for m in _LOOSE[kind].finditer(text):
                d = _digits(m[0])
                fits = {"email": True, "ip": all(int(x) <= 255 for x in re.findall("[0-9]+", m[0])), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 7 <= len(d) <= 15}[kind]
                if fits:
                    take(kind, *m.span(), "loose")
    for m in _KEY.finditer(text):
        take("secret", *m.span(), "loose")
    for m in _OTHER.finditer(text):
        if taken.free(*m.span()):
            out.append(("", *m.span(), "other"))
    return out


def render(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (ALL_KINDS.index(x[0]), x[1], x[2])))


FOUND = "uid long, doc_id long, h long, n_email long, n_ip long, n_card long, n_phone long, base string, seen array<struct<kind:string,start:int,stop:int,role:string,instance:string,patterns:array<string>>>"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("role", pa.string()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))
    for b in batches:
        counts: list[list[int]] = [[], [], [], []]
        bases, seen = [], []
        for cell in b.column(2):
            text = cell.as_py() or ""
            base = base_spans(text)
            for i, k in enumerate(KINDS):
                counts[i].append(sum(x[0] == k for x in base))
            bases.append(render(base))
            found = candidates(text, base)
            words = [m.span() for m in _WORD.finditer(text)] if found else []
            firsts = [w[0] for w in words]
            rows = []
            for k, s, e, role in found:
                value = _short(f"{k}:{' '.join(text[s:e].lower().split())}") if role != "other" else ""
                rows.append({"kind": k, "start": s, "stop": e, "role": role, "instance": value, "patterns": _patterns(text, words, firsts, s, e)})
            seen.append(rows)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), *(pa.array(c, pa.int64()) for c in counts), pa.array(bases, pa.string()), pa.array(seen, kind)], ["uid", "doc_id", "h", "n_email", "n_ip", "n_card", "n_phone", "base", "seen"])


def _confidences(edges: DataFrame) -> DataFrame:
    """pattern, kind, confidence: scores passed over the pattern-instance graph."""
    # weights of other and loose tokens count against a pattern; seeds count for it
    total = edges.groupBy("pattern").agg(F.sum("w").alias("total"))
    seeds = edges.where("role IN ('seed', 'strict')").groupBy("pattern", "kind").agg(F.sum("w").alias("seeds"), F.count("*").alias("kinds"))
    # a pattern must have been induced by seeds of at least two different values
    patterns = cut(seeds.where("kinds >= 2").join(total, "pattern").select("pattern", "kind", F.col("seeds").cast("double").alias("seeds"), "total"), "patterns")
    scored = patterns.withColumn("confidence", F.col("seeds") / (F.col("total") + SMOOTHING))
    loose = cut(edges.where("role = 'loose'").join(patterns.select("pattern", "kind"), ["pattern", "kind"], "left_semi").select("pattern", "kind", "instance", "w"), "loose")
    for _ in range(ROUNDS):
        joined = loose.join(scored.select("pattern", "kind", "confidence"), ["pattern", "kind"])
        value = joined.groupBy("kind", "instance").agg((1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))).alias("score"))
        gained = loose.join(value, ["kind", "instance"]).groupBy("pattern", "kind").agg(F.sum(F.col("w") * F.col("score")).alias("gained"))
        scored = cut(patterns.join(gained, ["pattern", "kind"], "left").withColumn("confidence", (F.col("seeds") + F.coalesce("gained", F.lit(0.0))) / (F.col("total") + SMOOTHING)).drop("gained"), "scored")
    return scored.select("pattern", "kind", "confidence")


def _extract(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per row: counts, base spans and a hash of the text, by uid; and the added spans of a uid, sorted by kind and start."""
    docs = columns(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    found = cut(docs.mapInArrow(_find, FOUND), "found")
    seen = found.select("uid", F.explode("seen").alias("s")).select("uid", "s.*")
    edges = seen.select("kind", "role", F.when(F.col("role") != "other", F.col("instance")).alias("instance"), F.explode("patterns").alias("pattern"))
    edges = cut(edges.groupBy("kind", "role", "instance", "pattern").agg(F.count("*").alias("w")), "edges")
    sure = _confidences(edges).where(F.col("confidence") >= CONFIDENT).select("pattern", "kind")
    loose = seen.where("role IN ('loose', 'strict')").select("uid", "kind", "start", "stop", F.explode("patterns").alias("pattern"))
    new = loose.join(sure, ["pattern", "kind"], "left_semi").select("uid", "kind", "start", "stop").distinct()
    return found.drop("seen"), new.groupBy("uid").agg(F.collect_list(F.struct(_order(F.col("kind")).alias("o"), "start", "stop", "kind")).alias("new"))


def _order(kind: F.Column) -> F.Column:
    return F.array_position(F.array(*[F.lit(k) for k in ALL_KINDS]), kind)


def _text(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, added of each row of (doc_id, text)."""
    found, new = _extract(docs)
    parts = F.transform(F.filter(F.split("base", ","), lambda x: x != ""), lambda x: F.split(x, ":"))
    base = F.transform(parts, lambda x: F.struct(_order(x[0]).alias("o"), x[1].cast("int").alias("start"), x[2].cast("int").alias("stop"), x[0].alias("kind")))
    every = F.when(F.col("new").isNull(), base).otherwise(F.concat(base, "new"))
    return found.join(new, "uid", "left").select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), _text(every).alias("spans"), F.coalesce(F.size("new"), F.lit(0)).cast("long").alias("added"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span, base or added, masked by its kind, and n_chars to match; same columns.

    Base spans are found again where the text is; only documents with added spans (few) are joined, by doc_id and text hash.
    """
    found, new = _extract(docs)
    added = cut(found.join(new, "uid").select("doc_id", "h", _text(F.col("new")).alias("__new")).distinct(), "added")
    hashed = docs.withColumn("__h", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    small = added.count() <= 100_000
    key = F.col("__a").eqNullSafe(F.col("doc_id").cast("long")) & (F.col("__b") == F.col("__h"))
    added = added.select(F.col("doc_id").alias("__a"), F.col("h").alias("__b"), "__new")
    joined = hashed.join(F.broadcast(added) if small else added, key, "left").select(*docs.columns, "__new")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, last = names.index("text"), names.index("n_chars"), len(names)
        for b in batches:
            texts, sizes = [], []
            for cell, size, more in zip(b.column(at), b.column(n), b.column(last), strict=True):
                text = cell.as_py()
                spans = render(base_spans(text)) if text else ""
                masked = mask(text, ",".join(filter(None, (spans, more.as_py())))) if text and (spans or more.is_valid) else text
                texts.append(masked)
                sizes.append(len(masked) if masked is not text else size.as_py())
            some = b.select(names).set_column(at, "text", pa.array(texts, pa.string()))
            yield some.set_column(n, "n_chars", pa.array(sizes, pa.int64()))

    return joined.mapInArrow(run, docs.schema)


def mask(text: str, spans: str) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans merge into the first one's."""
    marks = sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in spans.split(",") if x))
    out, at = [], 0
    for s, e, k in marks:
        if s >= at:
            out += [text[at:s], f"<{k}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])
