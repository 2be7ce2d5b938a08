"""The lineage graph for a viewer: documents, chunks, entities and how they hang together (GR7, GR8, ST5, AG27)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.graph import degree, entity_size, sunflower


def build(mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of (document, chunk, entity): nodes with kind, degree, position and size; distinct typed edges."""

    def node(kind: str, column: str) -> DataFrame:
        return mentions.where(F.col(column).isNotNull()).select(F.concat_ws(":", F.lit(kind), F.col(column)).alias("id"), F.lit(kind).alias("kind"), F.col(column).alias("label")).distinct()

    def edge(a: str, b: str, kind: str) -> DataFrame:
        known = mentions.where(F.col(a).isNotNull() & F.col(b).isNotNull())
        return known.select(F.concat_ws(":", F.lit(a), F.col(a)).alias("source"), F.concat_ws(":", F.lit(b), F.col(b)).alias("target"), F.lit(kind).alias("kind")).distinct()

    edges = edge("document", "chunk", "contains").unionAll(edge("chunk", "entity", "mentions"))
    nodes = node("document", "document").unionAll(node("chunk", "chunk")).unionAll(node("entity", "entity"))
    nodes = nodes.join(degree(edges, "source", "target"), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    nodes = sunflower(nodes, "kind", "id", 12.0).withColumn("size", entity_size(F.col("degree")))
    return nodes, edges


def select(nodes: DataFrame, kinds: list[str] | None = None, least_degree: int = 0, search: str = "", most: int = 30) -> DataFrame:
    """The viewer's filters: kind, degree, substring search (at most ``most`` hits, the feature's own limit) (GR8)."""
    d = nodes.where(F.col("degree") >= least_degree)
    if kinds is not None:
        d = d.where(F.col("kind").isin(kinds))
    if search:
        d = d.where(F.contains(F.lower("label"), F.lit(search.lower()))).orderBy(F.desc("degree"), "id").limit(most)
    return d


def neighbourhood(edges: DataFrame, start: str, hops: int) -> DataFrame:
    """id of every node at most ``hops`` edges from ``start`` (GR8)."""
    both = edges.select(F.col("source").alias("s"), F.col("target").alias("d")).unionAll(edges.select("target", "source"))
    seen = edges.sparkSession.createDataFrame([(start,)], "id string")
    for _ in range(hops):
        seen = seen.unionAll(both.join(seen, both["s"] == seen["id"]).select("d")).distinct()
    return seen
