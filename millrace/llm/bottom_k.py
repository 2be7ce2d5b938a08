"""Near-duplicate documents by bottom-k sketches from one hash function, verified by exact Jaccard similarity.

One pass hashes each document's set of five-word shingles with a single 64-bit hash and keeps the ``K`` smallest
values, the set's size and a 128-bit hash of the whole set. Documents with equal sets become one class, so copies
never meet as pairs. Retained values make inverted lists. Two classes with similarity of at least ``SIMILARITY``
share at least ``required`` retained values (all but about 1e-8 of such pairs), so, values being ordered from rare
to common, each class is listed only under its rarest ``retained - required + 1`` values: passages that many
documents share drop out of the lists of all but near copies.

Lists never emit all their pairs. In ``STARS`` rounds each list names a pivot, the member with most shared values
(later, of those outside the list's largest component), and each class is paired with the most central of its
lists' pivots only: a round makes at most one pair a class, whatever the groups. The union sketch (the K smallest
values of both) estimates each pair's similarity and filters those out of reach; what is left is verified on full
sets; links join into components. A list whose members all are in one component is done. For lists that still hold
several components a last, complete round pairs the members outside a list's largest component with all members of
other components, after setting aside the classes that too few of the others' shingles reach to be linked with
anything in the list. Long lists are cut into blocks of about ``BLOCK`` members, and only members outside the
largest component go to every block, so a hot list is spread over tasks. So no link between different texts that
would join components is lost, and hot groups do not cost their square.

Cases: A-Z are lower-cased; words are runs without ASCII white space; with fewer than five words the whole
sequence is the one shingle; without words (or null text) the set is empty and linked with nothing. Rows are
nodes: repeated rows link to each other and share the smallest doc_id; rows that share a doc_id but not the text are
judged each by its own text; a row with null doc_id takes part, and has a null component_id (and is kept) only if
nothing it reaches has an id. An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import columns, cut, give_back, mix64

WORDS, SIMILARITY, K, STARS = 5, 75, 64, 2
#: Values of a sketch in the last round, cut from the full sets.
WIDE = 256
#: Members of a list that meet in one block of the last round.
BLOCK = 256
#: Full sets of at most this many candidate documents are found by a broadcast of ids (8 bytes each); beyond it, by a shuffle.
BROADCAST_IDS = 1_000_000
_MULTIPLIERS = [np.uint64(pow(0x9E3779B97F4A7C15, i + 1, 1 << 64)) for i in range(WORDS)]
_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles."""
    digest = xxhash.xxh64_intdigest
    for text in texts:
        words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
        n = len(words)
        if n < WORDS:
            one = [digest(b" ".join(words), 1 + n)] if n else []
            yield np.array(one, np.uint64).view(np.int64)
            continue
        w = np.fromiter(map(digest, words), np.uint64, n)
        with np.errstate(over="ignore"):
            h = w[: n - WORDS + 1] * _MULTIPLIERS[0]
            for i in range(1, WORDS):
                h += w[i : n - WORDS + 1 + i] * _MULTIPLIERS[i]
            yield np.unique(mix64(h).view(np.int64))


def set_hash(values: np.ndarray) -> tuple[int, int]:
    """Two order-free 64-bit hashes of a set."""
    u = values.view(np.uint64)
    with np.errstate(over="ignore"):
        a, b = mix64(u ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64), mix64(u + np.uint64(0x0123456789ABCDEF)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, h1, h2, parts = [], [], [], []
        for lo in range(0, b.num_rows, 256):
            for s in shingle_sets(b.column(3).slice(lo, 256).to_pylist()):
                n.append(len(s))
                x, y = set_hash(s)
                h1.append(x)
                h2.append(y)
                parts.append(s[:K].copy())
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
        flat = np.concatenate([*parts, np.zeros(0, np.int64)])
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["uid", "doc_id", "th", "n", "h1", "h2", "sketch"])
    give_back()


def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 64):
            sets = list(shingle_sets(b.column(0).slice(lo, 64).to_pylist()))
            keys = [(len(s), *set_hash(s)) for s in sets]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*keys, strict=True)), values], ["n", "h1", "h2", "values"])
    give_back()


def required(n: F.Column) -> F.Column:
    """Retained values that a set of n shingles shares with any set as similar as asked."""
    return F.when(n >= K, F.lit(int(K * 0.44))).otherwise(F.least(F.lit(int(K * 0.44)), F.ceil(n * SIMILARITY / 100))).cast("int")


def postings(classes: DataFrame) -> DataFrame:
    """value, c, n, shared: each class under its rarest retained values that others share, and how many those are in all."""
    own = classes.select("c", "n", F.explode("sketch").alias("value"))
    shared = own.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    listed = own.join(shared.hint("shuffle_hash"), "value")
    by_class = Window.partitionBy("c")
    listed = listed.withColumn("shared", F.count("*").over(by_class)).withColumn("rank", F.row_number().over(by_class.orderBy("df", "value")))
    return listed.where(F.col("rank") <= F.col("shared") - required(F.col("n")) + 1).select("value", "c", "n", "shared")


def components(links: DataFrame) -> DataFrame:
    """c, comp: the smallest node each node of (a, b) reaches, by least labels and pointer jumping."""
    both = cut(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("c")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("c", "b"), "b").groupBy(F.col("a").alias("c")).agg(F.min("comp").alias("low"))
        new = labels.join(seen, "c").select("c", F.col("comp").alias("old"), F.least("comp", "low").alias("comp"))
        jump = labels.select(F.col("c").alias("comp"), F.col("comp").alias("further"))
        new = cut(new.join(jump, "comp", "left").select("c", "old", F.least("comp", F.coalesce("further", "comp")).alias("comp")), "labels")
        labels = new.select("c", "comp")
        if new.where("comp <> old").isEmpty():
            return labels


class Verifier:
    """Which candidate pairs of classes are links: union-sketch estimate first, then exact similarity of full sets."""

    def __init__(self, docs: DataFrame, classes: DataFrame):
        self.docs, self.classes = docs, classes

    def estimate(self, pairs: DataFrame) -> DataFrame:
        s = self.classes.select("c", "sketch")
        p = pairs.join(s.select(F.col("c").alias("a"), F.col("sketch").alias("sa")), "a").join(s.select(F.col("c").alias("b"), F.col("sketch").alias("sb")), "b")
        return p.where(_estimate("sa", "sb", K)).select("a", "b")

    def prepare(self, members: DataFrame) -> None:
        """Read the full sets of all listed classes (c) once: c, values."""
        keys = cut(members.join(self.classes.select("c", "doc_id", "n", "h1", "h2"), "c"), "members")
        ids = keys.select(F.col("doc_id").alias("id")).distinct()
        if keys.count() <= BROADCAST_IDS:
            ids = F.broadcast(ids)
        texts = self.docs.join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select("text")
        full = texts.mapInArrow(_full, "n long, h1 long, h2 long, values array<long>")
        self.full = cut(full.join(keys, ["n", "h1", "h2"]).groupBy("c").agg(F.first("values").alias("values")), "sets")

    def common(self, members: DataFrame) -> DataFrame:
        """c, common: how many of a class's shingles any other of these classes has; no overlap can be larger."""
        own = self.full.join(members, "c", "left_semi").select("c", F.explode("values").alias("value"))
        shared = own.groupBy("value").agg(F.count("*").alias("df")).where("df > 1").select("value")
        return own.join(shared, "value").groupBy("c").agg(F.count("*").alias("common"))

    def links(self, pairs: DataFrame) -> DataFrame:
        """a, b, shared of the pairs that are links."""
        near = cut(self.estimate(pairs), "near")
        if near.isEmpty():
            return near.select("a", "b", F.lit(0).alias("shared"))
        s = self.full
        p = near.join(s.select(F.col("c").alias("b"), F.col("values").alias("vb")), "b").join(s.select(F.col("c").alias("a"), F.col("values").alias("va")), "a")
        p = p.select("a", "b", (F.size("va") + F.size("vb")).alias("total"), F.size(F.array_intersect("va", "vb")).alias("shared"))
        return cut(p.where(100 * F.col("shared") >= SIMILARITY * (F.col("total") - F.col("shared"))).select("a", "b", "shared"), "links")


def _central() -> F.Column:
    """Order of a list's members: the one with most shared values first (a group's origin rather than a copy far from it)."""
    return F.struct("shared", (-F.col("c")).alias("c"), "n", "comp")


def _within(x: str, y: str) -> F.Column:
    return F.least(x, y) * 100 >= F.greatest(x, y) * SIMILARITY


def _linkable(listed: DataFrame, verifier: Verifier) -> DataFrame:
    """The rows of open lists that can still be linked: similarity s needs an overlap of s / (1 + s) of both sizes,
    and a class's overlap with any other is at most its ``common``. Setting some aside lowers the others' ``common``,
    hence two passes. Nothing that could be a link is lost."""
    for _ in range(2):
        common = verifier.common(listed.select("c").distinct())
        least = listed.groupBy("value").agg(F.min("n").alias("least"))
        other = F.greatest(F.col("least"), F.ceil(F.col("n") * SIMILARITY / 100))
        able = listed.join(common, "c").join(least, "value").where((100 + SIMILARITY) * F.col("common") >= SIMILARITY * (F.col("n") + other))
        listed = cut(able.select("value", "c", "n", "comp"), "linkable")
    mixed = listed.groupBy("value").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("value")
    return listed.join(mixed, "value", "left_semi")


def _remaining_pairs(listed: DataFrame, verifier: Verifier) -> DataFrame:
    """a, b: all pairs of different components that share a list and whose sketches allow a link.

    One of the two is outside the list's largest component, so only those go to all blocks of a list. A pair meets
    in every list it shares but is made in the first of them only, and only if the union of its ``WIDE`` smallest
    values passes the estimate; so what is made is near the number of links, not of meetings.
    """
    rest = cut(_linkable(listed, verifier), "rest")
    sizes = rest.groupBy("value", "comp").agg(F.count("*").alias("m"))
    sizes = sizes.groupBy("value").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.ceil(F.sum("m") / BLOCK).cast("int").alias("blocks"))
    own = rest.groupBy("c").agg(F.collect_list("value").alias("lists"))  # at most K values
    own = own.join(verifier.full.select("c", F.slice("values", 1, WIDE).alias("wide")), "c")
    rest = cut(rest.join(sizes, "value").join(own, "c"), "wide")
    right = rest.withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")).drop("blocks")
    right = right.select(*[F.col(x).alias(f"{x}2") for x in ("value", "block", "c", "n", "comp", "main", "lists", "wide")])
    left = rest.where("comp <> main").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("value", "block", "c", "n", "comp", "lists", "wide")
    once = F.array_min(F.array_intersect("lists", "lists2")) == F.col("value")
    meets = (F.col("comp") != F.col("comp2")) & ((F.col("comp2") == F.col("main2")) | (F.col("c") < F.col("c2"))) & _within("n", "n2")
    near = F.when(meets, F.when(once, _estimate("wide", "wide2", WIDE))).otherwise(False)
    met = left.join(right, (F.col("value") == F.col("value2")) & (F.col("block") == F.col("block2")) & near)
    return met.select(F.least("c", "c2").alias("a"), F.greatest("c", "c2").alias("b"))


def _estimate(x: str, y: str, k: int) -> F.Column:
    """Whether the union sketch of two sketches leaves a link possible."""
    union = F.slice(F.array_sort(F.array_union(x, y)), 1, k)
    size = F.size(union)
    reach = SIMILARITY / 100 - 6.5 * F.sqrt(F.lit(SIMILARITY * (100 - SIMILARITY)) / 10_000 / size)
    # sketches of fewer than k values are whole sets, whose similarity is known
    reach = F.when(F.size(F.array_union(x, y)) < k, F.lit(SIMILARITY / 100)).otherwise(reach)
    return F.size(F.array_intersect(F.array_intersect(x, y), union)) / size >= reach


def _star_pairs(at: DataFrame, open_: DataFrame, first: bool) -> DataFrame:
    """a, b: each class of an open list with the most central pivot of its lists, if of another component."""
    apart = at
    if not first:  # a pivot among those that are not with the list's most central member yet
        apart = at.join(open_.select("value", "main"), "value").where("comp <> main")
    pivots = apart.groupBy("value").agg(F.max(_central()).alias("p"), F.count("*").alias("m")).where("m > 1" if first else "m > 0")
    met = at.join(pivots.select("value", "p"), "value").where((F.col("comp") != F.col("p.comp")) & _within("n", "p.n"))
    best = met.groupBy("c").agg(F.max("p").alias("p")).select("c", (-F.col("p.c")).alias("p"))
    return best.select(F.least("c", "p").alias("a"), F.greatest("c", "p").alias("b")).distinct()


def link_classes(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """c, comp of every class that is linked with another."""
    lists = cut(postings(classes), "lists")
    verifier = Verifier(docs, classes)
    verifier.prepare(lists.select("c").distinct())
    links = tested = comps = None
    for turn in range(STARS + 1):
        at = lists.withColumn("comp", F.col("c")) if comps is None else cut(lists.join(comps, "c", "left").withColumn("comp", F.coalesce("comp", "c")), "at")
        open_ = at.groupBy("value").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max_by("comp", _central()).alias("main")).where("low <> high")
        if turn < STARS:
            met = _star_pairs(at, open_, not turn)
        else:
            met = _remaining_pairs(at.join(open_.select("value"), "value").select("value", "c", "n", "comp"), verifier)
        if tested is not None:
            met = met.join(tested, ["a", "b"], "left_anti")
        met = cut(met, "pairs")
        if met.isEmpty() and comps is not None:
            continue
        tested = met if tested is None else tested.unionAll(met)
        new = verifier.links(met).select("a", "b")
        links = new if links is None else links.unionAll(new)
        comps = components(links)
    return comps


def _labelled(docs: DataFrame) -> DataFrame:
    """Of each row: doc_id, th (hash of the text), n, component_id, class_id, and the head of its component:
    null for empty sets, else the doc_id (hid) and text hash (hth) of the row that stands for it, ids before null."""
    docs = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashed = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    rows = cut(hashed.mapInArrow(_sketch, "uid long, doc_id long, th long, n long, h1 long, h2 long, sketch array<long>"), "sketches")
    key = ["n", "h1", "h2"]
    head = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    classes = cut(rows.where("n > 0").groupBy(*key).agg(F.min("uid").alias("c"), F.min(head).alias("head"), F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch")), "classes")
    comps = link_classes(docs, classes)
    named = classes.select(*key, "c", F.col("doc_id").alias("class_id"), "head").join(comps, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    least = named.groupBy("comp").agg(F.min("class_id").alias("component_id"), F.min("head").alias("head"))
    named = cut(named.drop("head").join(least, "comp").select(*key, "class_id", "component_id", F.col("head.doc_id").alias("hid"), F.col("head.th").alias("hth")), "named")
    return rows.drop("sketch").join(named, key, "left")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id of each row of (doc_id, text).

    class_id is the smallest doc_id with the same shingle set (null for empty sets).
    """
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return _labelled(docs).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "class_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows that stay: one of each component, that with the smallest doc_id (nulls last), then the smallest
    hash of its text; same columns. Rows without words are linked with nothing and all stay."""
    found = _labelled(docs).select("doc_id", "th", "n", "hid", "hth")
    found = cut(found.withColumn("stays", (F.col("n") == 0) | (F.col("doc_id").eqNullSafe(F.col("hid")) & (F.col("th") == F.col("hth")))), "kept")
    gone = found.where("NOT stays").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col("__th"))
    out = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, same, "left_anti")
    again = found.where("stays AND n > 0").groupBy(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).count().where("count > 1").drop("count")
    if again.isEmpty():
        return out
    return out.join(again, same, "left_anti").unionAll(out.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))
