"""Typed multigraphs as one edge table (source_id, type, target_id): adjacency, expansion, degree, lineage (GR1-GR8, AG24-AG27, CA1)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import checkpoint_dir

GOLDEN_ANGLE = 2.399963229728653


def adjacency(edges: DataFrame, nodes: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """src, relation, dst both ways; only edges of allowed types between known nodes (GR2)."""
    known = edges.where(~F.col("type").isin(list(excluded))) if excluded else edges
    for end in ("source_id", "target_id"):
        known = known.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    known = known.select(F.col("source_id").alias("src"), F.col("type").alias("relation"), F.col("target_id").alias("dst"))
    return known.unionAll(known.select(F.col("dst").alias("src"), F.concat(F.lit("reverse:"), "relation").alias("relation"), F.col("src").alias("dst"))).distinct()


def expand(seeds: DataFrame, near: DataFrame, hops: int) -> DataFrame:
    """query_id, node, hop, nodes, relations: all simple paths of at most ``hops`` edges from each seed (GR3).

    Unrolled joins: the number of hops is a small setting, and each hop is one equi-join on the path's end.
    """
    at = seeds.select("query_id", F.col("node"), F.lit(0).alias("hop"), F.array("node").alias("nodes"), F.array().cast("array<string>").alias("relations"))
    out = [at]
    for h in range(1, hops + 1):
        step = at.join(near, at["node"] == near["src"]).where(~F.array_contains("nodes", F.col("dst")))
        at = step.select("query_id", F.col("dst").alias("node"), F.lit(h).alias("hop"), F.array_append("nodes", F.col("dst")).alias("nodes"), F.array_append("relations", F.col("relation")).alias("relations"))
        out.append(at)
    return reduce(DataFrame.unionAll, out)


def reach(paths: DataFrame, decay: float) -> DataFrame:
    """query_id, node, hop, score, n_paths: the shortest hop and its decay (GR5)."""
    return paths.groupBy("query_id", "node").agg(F.min("hop").alias("hop"), F.pow(F.lit(decay), F.min("hop")).alias("score"), F.countDistinct("nodes", "relations").alias("n_paths"))


def component(value: Column, weight: float) -> Column:
    """GR4."""
    return F.struct(value.alias("value"), F.lit(weight).alias("weight"), (value * weight).alias("contribution"))


def degree(edges: DataFrame, src: str = "source_id", dst: str = "target_id") -> DataFrame:
    """id, degree: edges that touch a node at either end (AG24)."""
    return edges.select(F.explode(F.array(src, dst)).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def claim_chain(claims: DataFrame, entity: str, claim: str) -> DataFrame:
    """Consecutive claims of an entity as edges (WN9)."""
    following = F.lead(claim).over(Window.partitionBy(entity).orderBy(claim))
    return claims.select(entity, F.col(claim).alias("source"), following.alias("target")).where("target IS NOT NULL")


def sunflower(df: DataFrame, group: str, order: str, spacing: float) -> DataFrame:
    """x, y of each row: the i-th of its group at angle i * golden angle, radius spacing * sqrt(i + 0.5) (GR7)."""
    i = (F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1).cast("double")
    r = spacing * F.sqrt(i + 0.5)
    return df.withColumn("x", r * F.cos(i * GOLDEN_ANGLE)).withColumn("y", r * F.sin(i * GOLDEN_ANGLE))


def entity_size(n: Column) -> Column:
    """AG26."""
    return F.least(F.lit(16.0), 3 + 2.2 * F.log2(n + 1))


def label_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, root: least node reachable over undirected (a, b), by least labels with pointer jumping (CA1's merges).

    Goes on until a round changes nothing (a number of rounds about the logarithm of the longest path); each round is materialised by checkpoint().
    """
    checkpoint_dir(nodes.sparkSession)
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    labels = nodes.select("id", F.col("id").alias("root"))
    while True:
        low = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("low"))
        new = labels.join(low, "id", "left").select("id", F.col("root").alias("old"), F.least("root", F.coalesce("low", "root")).alias("root"))
        jump = labels.select(F.col("id").alias("root"), F.col("root").alias("further"))
        new = new.join(jump, "root", "left").select("id", "old", F.least("root", F.coalesce("further", "root")).alias("root")).checkpoint()
        labels = new.select("id", "root")
        if new.where("old <> root").isEmpty():
            return labels


def one_to_one(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """The pairs whose left end has one right end and the other way round (CA1's acronym guard)."""
    pairs = pairs.select(left, right).distinct()
    for a in (left, right):
        single = pairs.groupBy(a).agg(F.count("*").alias("__n")).where("__n = 1").select(a)
        pairs = pairs.join(single, a, "left_semi")
    return pairs


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an unknown end (AG27)."""
    ids = nodes.select("id")
    return edges.join(ids, edges["source_id"] == ids["id"], "left_anti").unionAll(edges.join(ids, edges["target_id"] == ids["id"], "left_anti")).distinct()
