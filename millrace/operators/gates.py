"""Summaries and quality gates (AG8, AG9, AG11, AG12, AG16, AG17, AG19-AG21, AG25, AG28, AG29, FL3, FL4, FL24, ST3, SC11, GV1, GV2)."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import language_match, optional_text


def scorable(df: DataFrame, reference: str) -> DataFrame:
    """``reference_available``: rows without a reference stay for generation, but are not scored (FL3)."""
    return df.withColumn("reference_available", optional_text(F.col(reference)).isNotNull())


def required(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows with an id and a text; ``.0`` endings of ids are cut (FL4)."""
    d = df.withColumn(key, F.regexp_replace(optional_text(F.col(key).cast("string")), r"\.0$", ""))
    return d.where(F.col(key).isNotNull() & optional_text(F.col(text)).isNotNull())


def language_summary(df: DataFrame, language: str, detected: str) -> DataFrame:
    """language, n, detected counts as a map, match_rate over rows where both are known (AG8)."""
    n = df.groupBy(language, F.coalesce(F.col(detected), F.lit("unknown")).alias("__d")).agg(F.count("*").alias("__n"))
    maps = n.groupBy(language).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__d", "__n")))).alias("detected_counts"))
    rates = df.groupBy(language).agg(F.count("*").alias("n"), F.avg(language_match(F.col(language), F.col(detected)).cast("double")).alias("match_rate"))
    return rates.join(maps, language)


def reference_audit(long: DataFrame) -> DataFrame:
    """metric, n_input, n_scorable, coverage of (metric, status) (AG9); exclusion reasons come from ``frequency``."""
    ok = F.col("status") == "scored"
    return long.groupBy("metric").agg(F.count("*").alias("n_input"), F.count_if(ok).alias("n_scorable"), F.avg(ok.cast("double")).alias("coverage"))


def variant_quality(df: DataFrame, variant: str, key: str, accepted: Column) -> DataFrame:
    """variant, n_rows, n_ids, n_accepted, rate (AG11)."""
    d = df.groupBy(variant).agg(F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_ids"), F.count_if(accepted).alias("n_accepted"))
    return d.withColumn("rate", F.col("n_accepted") / F.greatest(F.lit(1), "n_rows"))


def chunk_counts(registry: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """key, n_chunks, indexable for every registered document (AG12)."""
    n = chunks.groupBy(key).agg(F.count("*").alias("n_chunks"))
    return registry.select(key).join(n, key, "left").select(key, F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.col("n_chunks").isNotNull().alias("indexable"))


def consistency(df: DataFrame, language: str, holds: Column) -> DataFrame:
    """Totals and rates by language, and over all (language null) (AG16)."""
    return df.rollup(language).agg(F.count("*").alias("n"), F.count_if(holds).alias("n_consistent"), F.avg(holds.cast("double")).alias("rate"))


def frequency(df: DataFrame, *by: str) -> DataFrame:
    """AG17."""
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def rate_gate(df: DataFrame, holds: Column, least: float) -> DataFrame:
    """n, n_accepted, rate, passed (AG19, AG28)."""
    return df.agg(F.count("*").alias("n"), F.count_if(holds).alias("n_accepted"), F.avg(holds.cast("double")).alias("rate")).withColumn("passed", F.coalesce(F.col("rate") >= least, F.lit(False)))


def availability_gate(documents: DataFrame, healthy: Column, least: int, coverage: float) -> DataFrame:
    """AG21: enough healthy documents, and a large enough share."""
    d = documents.agg(F.count("*").alias("n"), F.count_if(healthy).alias("healthy"))
    share = F.coalesce(F.try_divide("healthy", "n"), F.lit(0.0))
    return d.withColumn("coverage", share).withColumn("passed", (F.col("healthy") >= least) & (share >= coverage))


def mode_label(df: DataFrame, key: str, label: str, order: str) -> DataFrame:
    """The most frequent label per key, the first seen on ties (AG25)."""
    n = df.groupBy(key, label).agg(F.count("*").alias("__n"), F.min(order).alias("__o"))
    return n.groupBy(key).agg(F.max_by(label, F.struct("__n", -F.col("__o"))).alias(label))


def per_label(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """label, support, correct, precision, recall from one confusion table (AG29)."""
    c = df.groupBy(gold, predicted).agg(F.count("*").alias("n"))
    g = c.groupBy(F.col(gold).alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(gold) == F.col(predicted), F.col("n")).otherwise(0)).alias("correct"))
    p = c.groupBy(F.col(predicted).alias("label")).agg(F.sum("n").alias("said"))
    j = g.join(p, "label", "full").na.fill(0)
    return j.select("label", "support", "correct", F.coalesce(F.try_divide("correct", "said"), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide("correct", "support"), F.lit(0.0)).alias("recall"))


def set_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, side: what one side has and the other lacks; empty means equal sets (ST3, SC11)."""
    left = a.select(key).distinct().join(b.select(key), key, "left_anti").withColumn("side", F.lit("left"))
    return left.unionAll(b.select(key).distinct().join(a.select(key), key, "left_anti").withColumn("side", F.lit("right")))


def cache_mismatches(expected: DataFrame, cached: DataFrame, key: str, digest: str) -> DataFrame:
    """key, reason: what keeps a cache from being reused (FL24); empty means reuse."""
    j = expected.select(key, F.col(digest).alias("__a")).join(cached.select(key, F.col(digest).alias("__b")), key, "full")
    reason = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "unexpected").when(F.col("__a") != F.col("__b"), "changed")
    return j.select(key, reason.alias("reason")).where("reason IS NOT NULL")


def identities(config: dict, split: list[str], shard: int, shards: int) -> dict[str, str]:
    """Hashes of a run: the configuration's, the split's (which a shard does not change) and the run's (GV1)."""

    def digest(x) -> str:
        return hashlib.sha256(json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()

    base = {k: v for k, v in config.items() if k not in ("run_name", "shard_index", "shard_count")}
    parts = {"config": digest(base), "split": digest(sorted(split))}
    return parts | {"run": digest([parts, shard, shards])}


def shard_run_name(base: str, shard: int, shards: int) -> str:
    """GV2."""
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", base) or not 0 <= shard < shards:
        raise ValueError("a run name needs plain characters and a shard below the count")
    return f"{base}__shard-{shard}-of-{shards}" if shards > 1 else base
