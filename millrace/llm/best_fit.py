"""Variable-capacity best-fit packing: documents into sequences of several permitted lengths.

Longest pieces first, each into the open bin with the least room that still takes it; when none does, a bin is
opened at the capacity of least cost per unit it can hope to fill, and at the end each bin is downsized to the
smallest permitted capacity that holds its contents. The permitted lengths are optimised jointly: the plan is
made once for each set of them that keeps the largest and the cheapest finished plan wins (a bin costs its
capacity plus ``OVERHEAD``).

The plan needs only how many pieces there are of each length, so it is made exactly, for all rows, on the
driver from a histogram of at most ``max(capacities)`` counts: bins that look alike move together as ranges of
bin numbers. Pieces are then ranked within their length (salted by a hash bucket, so a common length is spread
over tasks) and look up their range; texts are never shuffled.

A document's length is its code points (not tokens) plus one end mark; one longer than the largest capacity is cut into
pieces of that capacity and a rest, whole text included.

Cases: null or empty text has length 1; repeated rows are packed each; null doc_id is kept; ties are ordered
by hash bucket, doc_id, piece; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import columns, cut, partitions

CAPACITIES = (2048, 4096, 8192, 16384)
OVERHEAD = 32
SCHEMA = "doc_id long, piece int, start long, length int, bin_id long, bin_offset int, bin_used int, bin_capacity int"


class Plan:
    """events: (length, first rank, first bin, offset), each up to the next first rank; bins: (first bin, used, capacity)."""

    def __init__(self, counts: dict[int, int], capacities: tuple[int, ...], permitted: tuple[int, ...]):
        self.events: list[tuple[int, int, int, int]] = []
        room: dict[int, list[list[int]]] = {}  # room left -> [first bin, bins, used]
        rooms: list[int] = []
        closed: list[tuple[int, int, int]] = []
        made = 0
        mass = sum(k * n for k, n in counts.items())

        def put(left: int, first: int, n: int, used: int) -> None:
            if left == 0:
                closed.append((first, n, used))
            elif left in room:
                room[left].append([first, n, used])
            else:
                room[left] = [[first, n, used]]
                insort(rooms, left)

        for length in sorted(counts, reverse=True):
            rank, todo = 0, counts[length]
            while todo:
                i = bisect_left(rooms, length)
                if i < len(rooms):
                    left = rooms[i]
                    first, n, used = group = room[left][-1]
                    k = min(n, todo)
                    if k == n:
                        room[left].pop()
                        if not room[left]:
                            del room[left], rooms[i]
                    else:
                        group[0], group[1] = first + k, n - k
                else:
                    after = mass - length
                    capacity = min((c for c in permitted if c >= length), key=lambda c: ((c + OVERHEAD) / (length + min(c - length, after)), c))
                    fill = capacity // length
                    # whole bins at once, while the mass left cannot change the choice; else one bin at a time
                    many = min(todo // fill, (mass - capacities[-1]) // (fill * length))
                    if many < 1:
                        put(capacity, made, 1, 0)
                        made += 1
                        continue
                    for j in range(fill):
                        self.events.append((length, rank + j * many, made, j * length))
                    put(capacity - fill * length, made, many, fill * length)
                    rank, todo, mass, made = rank + many * fill, todo - many * fill, mass - many * fill * length, made + many
                    continue
                self.events.append((length, rank, first, used))
                put(left - length, first, k, used + length)
                rank, todo, mass = rank + k, todo - k, mass - k * length
        for groups in room.values():
            closed += [tuple(g) for g in groups]
        self.bins = sorted((first, used, next(c for c in capacities if c >= used)) for first, n, used in closed)
        self.cost = sum(n * (next(c for c in capacities if c >= used) + OVERHEAD) for _, n, used in closed if used)
        self.made = made


def plan(counts: dict[int, int], capacities: tuple[int, ...] = CAPACITIES) -> Plan:
    """The cheapest plan over all sets of permitted lengths that keep the largest, so that all pieces fit."""
    *smaller, largest = capacities
    sets = [(*some, largest) for k in range(len(smaller), -1, -1) for some in combinations(smaller, k)]
    return min((Plan(counts, capacities, s) for s in sets), key=lambda p: p.cost)


def pieces(docs: DataFrame, largest: int) -> DataFrame:
    """doc_id, piece, start, length: every document cut at the largest capacity."""
    docs = columns(docs, "doc_id", "text")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))) + 1).cast("long").alias("n"))
    docs = docs.select("doc_id", "n", F.explode(F.expr(f"sequence(0L, (n - 1) div {largest})")).alias("p"))
    return docs.select("doc_id", F.col("p").cast("int").alias("piece"), (F.col("p") * largest).alias("start"), F.least(F.lit(largest), F.col("n") - F.col("p") * largest).cast("int").alias("length"))


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """SCHEMA of every piece of (doc_id, text)."""
    capacities = tuple(sorted(set(capacities)))
    spark = docs.sparkSession
    buckets = max(64, 4 * partitions(spark))
    all_pieces = cut(pieces(docs, capacities[-1]).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int")), "pieces")
    counts = cut(all_pieces.groupBy("length", "bucket").count(), "counts")
    best = plan({r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("count")).collect()}, capacities)
    table = spark.sparkContext.broadcast(
        (
            np.array([(e[0] << 44) + e[1] for e in sorted(best.events)], np.int64),
            np.array(sorted(best.events), np.int64).reshape(-1, 4),
            np.array(best.bins, np.int64).reshape(-1, 3),
        )
    )
    before = F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1
    ranked = all_pieces.withColumn("rank", rank).join(starts, ["length", "bucket"]).select("doc_id", "piece", "start", "length", (F.col("before") + F.col("rank")).alias("rank"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, events, bins = table.value
        for b in batches:
            length, rank = b.column(3).to_numpy().astype(np.int64), b.column(4).to_numpy()
            e = events[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
            bin_id = e[:, 2] + rank - e[:, 1]
            g = bins[np.searchsorted(bins[:, 0], bin_id, side="right") - 1]
            arrays = [*b.columns[:4], pa.array(bin_id), *(pa.array(x.astype(np.int32)) for x in (e[:, 3], g[:, 1], g[:, 2]))]
            yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in SCHEMA.split(", ")])

    return ranked.mapInArrow(look, SCHEMA)
