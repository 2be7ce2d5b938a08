"""Evidence from a claim graph around retrieval seeds: ten weighted components per evidence chunk (GR3-GR6, TK3, JN6, WN2)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.graph import adjacency, expand
from millrace.operators.retrieval import min_max, ranked


@dataclass
class Settings:
    """Weights are free; the names are the components, in order."""

    weights: dict[str, float] = field(default_factory=lambda: {k: 1.0 for k in ("query_entity", "predicate", "polarity", "modality", "stance", "review_state", "authority", "extraction_confidence", "seed_score", "hop_decay")})
    review_scores: dict[str, float] = field(default_factory=lambda: {"accepted": 1.0, "reviewed": 0.5})
    hop_decay: float = 0.7
    max_hops: int = 2
    least_dense: float = 0.25
    least_score: float = 0.0

    def __post_init__(self):
        if not 0 <= self.max_hops <= 8 or not 0 < self.hop_decay <= 1:
            raise ValueError("max_hops must be 0..8 and hop_decay in (0, 1]")


def located(seeds: DataFrame, evidence: DataFrame) -> DataFrame:
    """Seeds with their evidence id: a stated id must exist; only without one do (document, chunk) decide (JN6)."""
    known = evidence.select(F.col("evidence_chunk_id").alias("__e"))
    stated = seeds.where("evidence_chunk_id IS NOT NULL").join(known, F.col("evidence_chunk_id") == F.col("__e")).drop("__e")
    by_place = evidence.select("document_uid", "chunk_id", F.col("evidence_chunk_id").alias("__e"))
    placed = seeds.where("evidence_chunk_id IS NULL").join(by_place, ["document_uid", "chunk_id"]).withColumn("evidence_chunk_id", F.col("__e"))
    return stated.unionByName(placed.select(stated.columns))


def graph_hits(seeds: DataFrame, signatures: DataFrame, tables: dict[str, DataFrame], s: Settings) -> DataFrame:
    """query_id, candidate_id, hop, score, rank, n_paths, components for all queries at once.

    Seeds need a positive score (dense ones at least ``least_dense``); scores are normalised per query and branch.
    A seed itself (hop 0) needs a claim that matches an asked entity or predicate; farther evidence needs none.
    """
    evidence, claims = tables["EvidenceChunk"], tables["Claim"]
    nodes = evidence.select(F.col("evidence_chunk_id").alias("id")).unionAll(claims.select("claim_id")).unionAll(tables["Entity"].select("entity_id")).distinct()
    near = adjacency(tables["edges"], nodes, ("from_document",))
    kept = seeds.where((F.col("raw_score") > 0) & ((F.col("branch") != "dense") | (F.col("raw_score") >= s.least_dense)))
    kept = min_max(located(kept, evidence), "raw_score", "query_id", "branch")
    best = kept.groupBy("query_id", F.col("evidence_chunk_id").alias("node")).agg(F.max("normalized").alias("seed_score"))
    paths = expand(best.select("query_id", "node"), near, s.max_hops).distinct()
    found = paths.join(evidence.select(F.col("evidence_chunk_id").alias("node"), "authority_score", "status"), "node")
    found = found.groupBy("query_id", "node").agg(F.min("hop").alias("hop"), F.count("*").alias("n_paths"), F.first("authority_score").alias("authority"), F.first("status").alias("state"))
    at = near.where(~F.startswith("relation", F.lit("reverse:"))).join(evidence.select(F.col("evidence_chunk_id").alias("src")), "src", "left_semi").join(claims, F.col("dst") == F.col("claim_id"))
    at = at.unionByName(near.where("relation = 'evidenced_by'").join(claims, F.col("src") == F.col("claim_id")).withColumn("src", F.col("dst")).select(at.columns))
    at = at.select(F.col("src").alias("node"), "claim_id", "subject_entity_id", "object_entity_id", "predicate", "polarity", "modality", "stance", "model_confidence").distinct()
    c = found.select("query_id", "node").join(at, "node").join(signatures, "query_id")

    def any_(x):
        return F.max(F.coalesce(x, F.lit(False)).cast("double"))

    matched = c.groupBy("query_id", "node").agg(
        any_(F.array_contains("entity_ids", F.col("subject_entity_id")) | F.coalesce(F.array_contains("entity_ids", F.col("object_entity_id")), F.lit(False))).alias("query_entity"),
        any_(F.array_contains("predicates", F.col("predicate"))).alias("predicate"),
        any_(F.array_contains("polarities", F.col("polarity"))).alias("polarity"),
        any_(F.array_contains("modalities", F.col("modality"))).alias("modality"),
        any_(F.array_contains("stances", F.col("stance"))).alias("stance"),
        F.max("model_confidence").alias("extraction_confidence"),
        F.count("*").alias("claims"),
    )
    j = found.join(matched, ["query_id", "node"], "left").join(best, ["query_id", "node"], "left").na.fill(0)
    state = F.create_map(*[F.lit(x) for kv in s.review_scores.items() for x in kv])
    j = j.withColumn("review_state", F.coalesce(state[F.col("state")], F.lit(s.review_scores.get("unknown", 0.0))))
    j = j.withColumn("authority", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("authority", F.lit(0.0))))).withColumn("hop_decay", F.pow(F.lit(s.hop_decay), F.col("hop")))
    j = j.where((F.col("hop") > 0) | ((F.col("claims") > 0) & ((F.col("query_entity") > 0) | (F.col("predicate") > 0))))
    parts = [F.struct(F.lit(k).alias("name"), F.col(k).alias("value"), F.lit(w).alias("weight"), (F.col(k) * w).alias("contribution")) for k, w in s.weights.items()]
    j = j.withColumn("components", F.array(*parts)).withColumn("score", F.aggregate("components", F.lit(0.0), lambda a, x: a + x["contribution"]))
    j = j.where(F.col("score") > max(0.0, s.least_score)).withColumnRenamed("node", "candidate_id")
    return ranked(j).select("query_id", "candidate_id", "hop", "score", "rank", "n_paths", "components")
