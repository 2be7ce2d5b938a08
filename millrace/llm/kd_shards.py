"""Sharding by a k-d tree: split at distributed weighted medians along the widest metadata dimension.

Law ``bytes``: shards hold near-equal bytes. The tree's points are units with a weight in bytes: all copies of
one text are one unit (so they stay in one shard), unless together they exceed ``ATOM`` of a shard, when each
row is its own unit and the copies spread. Dimensions are log size, language, source (labels by a hash of the
whole value, so equal ones stay together and different ones part) and first doc_id. A node
that must become k shards is split along its widest dimension, relative to the table's own width, at the
weighted quantile floor(k/2)/k, until every leaf is one shard, which is when it reaches the target bytes.

A quantile is found by radix descent on 62-bit keys (dimension, then a hash that orders ties): each pass sums
weights over 4096 bins a node, so the driver sees at most shards x 4096 sums and never a row. The finished
tree is a nested CASE expression; texts are read once and never shuffled.

Cases: null text counts 16 bytes and crc32 0; null metadata sorts first; repeated rows are copies; an empty
table gives an empty result; with fewer units than shards some shards stay empty; extra columns are not read.
Size is UTF-8 bytes + 16. Slots run gapless from 0 in each shard, ordered by a hash bucket, then doc_id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import columns, cut, partitions

#: Share of a shard's target bytes up to which copies of a text stay together.
ATOM = 0.01
#: A quantile may miss by this share of a shard's target bytes.
TOLERANCE = 0.001
DIMS = ("size", "lang", "source", "doc_id")
_DIM_BITS, _HASH_BITS, _DIGIT = 22, 40, 12


@dataclass
class Node:
    first: int
    shards: int
    dim: int = 0
    split: int = 0
    left: Node | None = None
    right: Node | None = None


def _number(text: Column) -> Column:
    """A string's place on its axis: a hash of the whole value, so that different values differ; null comes first."""
    return F.when(text.isNull(), F.lit(0.0)).otherwise((F.xxhash64(text).bitwiseAND((1 << 52) - 1) + 1).cast("double"))


def _place(node: Node) -> Column:
    """The first shard number of the node that a unit falls into."""
    if node.left is None:
        return F.lit(node.first)
    return F.when(F.col(f"k{node.dim}") < node.split, _place(node.left)).otherwise(_place(node.right))


def _leaves(node: Node) -> list[Node]:
    return [node] if node.left is None else _leaves(node.left) + _leaves(node.right)


def _keys(df: DataFrame, low: list, high: list) -> DataFrame:
    top = (1 << _DIM_BITS) - 1
    for i, (a, b) in enumerate(zip(low, high, strict=True)):
        q = F.floor((F.col(f"d{i}") - a) / ((b - a) or 1.0) * top).cast("long")
        df = df.withColumn(f"k{i}", F.shiftleft(q, _HASH_BITS) + F.col("tie"))
    return df


def _grow(units: DataFrame, shards: int, total: int) -> Node:
    """The tree, level by level; two kinds of small aggregates a level go to the driver."""
    root, slack = Node(0, shards), TOLERANCE * total / shards
    while open_ := [n for n in _leaves(root) if n.shards > 1]:
        placed = units.withColumn("node", _place(root))
        spans = {r["node"]: r for r in placed.groupBy("node").agg(F.sum("w").alias("w"), *[(F.max(f"k{i}") - F.min(f"k{i}")).alias(f"s{i}") for i in range(len(DIMS))]).collect()}
        for n in open_:
            r = spans.get(n.first)
            n.dim = max(range(len(DIMS)), key=lambda i: (r[f"s{i}"], -i)) if r else 0
        # per node: weight wanted on the left, weight left of the prefix, the prefix and its bits
        state = {n.first: [spans[n.first]["w"] * (n.shards // 2) / n.shards, 0, 0, 0] for n in open_ if n.first in spans}
        done: dict[int, int] = {}
        key = F.col(f"k{open_[0].dim}")
        for n in open_[1:]:
            key = F.when(F.col("node") == n.first, F.col(f"k{n.dim}")).otherwise(key)
        placed = placed.where(F.col("node").isin([n.first for n in open_])).select("node", key.alias("key"), "w")
        bits = _DIM_BITS + _HASH_BITS
        while state:
            used = next(iter(state.values()))[3]
            step = min(_DIGIT, bits - used)
            rest = bits - used - step
            inside = placed
            if used:
                match = F.lit(False)
                for f, s in state.items():
                    match = match | ((F.col("node") == f) & (F.shiftright("key", bits - used) == s[2]))
                inside = inside.where(match)
            digit = F.shiftright("key", rest).bitwiseAND((1 << step) - 1)
            sums: dict[int, list] = {}
            for f, d, w, c in inside.groupBy("node", digit.alias("digit")).agg(F.sum("w"), F.count("*")).collect():
                sums.setdefault(f, []).append((d, w, c))
            for f in list(state):
                want, before, prefix, _ = state[f]
                for d, w, c in sorted(sums[f]):
                    if before + w >= want:
                        break
                    before += w
                else:
                    before -= w
                here = prefix << step | d
                if c == 1 or w <= slack or rest == 0:
                    done[f] = (here + (before + w - want < want - before)) << rest
                    del state[f]
                else:
                    state[f] = [want, before, here, used + step]
        for n in open_:
            n.split = done.get(n.first, 0)
            half = n.shards // 2
            n.left, n.right = Node(n.first, half), Node(n.first + half, n.shards - half)
    return root


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row of (doc_id, text, lang, source)."""
    docs = columns(docs, "doc_id", "text", "lang", "source")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = cut(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(raw) + 16).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            F.xxhash64(raw).alias("h"),
            F.col("lang").cast("string").alias("lang"),
            F.col("source").cast("string").alias("source"),
        ),
        "rows",
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    group = ["h", "text_crc32", "size"]
    groups = cut(
        rows.groupBy(*group).agg(
            F.sum("size").alias("w"),
            F.count("*").alias("n"),
            F.log2(F.first("size").cast("double")).alias("d0"),
            _number(F.min("lang")).alias("d1"),
            _number(F.min("source")).alias("d2"),
            F.coalesce(F.min("doc_id"), F.lit(0)).cast("double").alias("d3"),
        ),
        "groups",
    )
    dims = [f"d{i}" for i in range(len(DIMS))]
    large = F.col("w") > ATOM * total / shards
    # at most shards / ATOM groups can be this large
    split = F.broadcast(groups.where(large & (F.col("n") > 1)).select(*group, *dims))
    whole = groups.where(~(large & (F.col("n") > 1)))
    mask = (1 << _HASH_BITS) - 1
    loose = rows.join(split, group).withColumn("tie", F.xxhash64("h", "doc_id").bitwiseAND(mask))
    tied = whole.withColumn("tie", F.col("h").bitwiseAND(mask))
    r = groups.agg(*[F.min(d) for d in dims], *[F.max(d) for d in dims]).first()
    low, high = [x or 0.0 for x in r[: len(dims)]], [x or 0.0 for x in r[len(dims) :]]
    loose, tied = _keys(loose, low, high), _keys(tied, low, high)
    keys = [f"k{i}" for i in range(len(DIMS))]
    units = tied.select("w", *keys).unionAll(loose.select(F.col("size").alias("w"), *keys))
    units = cut(units, "units")
    tree = _grow(units, shards, total)
    place = _place(tree).cast("int").alias("shard")
    own = rows.join(tied.select(*group, place), group).select("doc_id", "size", "text_crc32", "h", "shard")
    out = own.unionAll(loose.select("doc_id", "size", "text_crc32", "h", place))
    buckets = max(64, 4 * partitions(docs.sparkSession))
    out = cut(out.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h"), F.lit(buckets)).cast("int")), "placed")
    counts = out.groupBy("shard", "bucket").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("start"))  # shards x buckets rows
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "h"))
    return (
        out.withColumn("rank", rank)
        .join(F.broadcast(starts), ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
