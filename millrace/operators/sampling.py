"""Splits, shards, schedules and stratified samples in hash order (WN5, WN6, WN11, SM1-SM3, AG13, AG22, JN10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.ids import stable_id


def stratified_split(df: DataFrame, key: str, strata: list[str], seed: str) -> DataFrame:
    """split: within each stratum, in order of the stable id of (key, seed), 7 of 10 train, 2 dev, 1 test (WN5)."""
    place = F.row_number().over(Window.partitionBy(*strata).orderBy(stable_id(key, F.lit(seed)), key)) - 1
    m = place % 10
    return df.withColumn("split", F.when(m < 7, "train").when(m < 9, "dev").otherwise("test"))


def stride_shard(df: DataFrame, order: str, shards: int) -> DataFrame:
    """shard: position in order, modulo the number of shards (WN6).

    Positions come from a per-range rank plus the range's start, so no single task ranks the table.
    """
    n = 64
    ranges = df.select(order).approxQuantile(order, [i / n for i in range(1, n)], 0.002)
    cuts = sorted(set(ranges))
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(order))) if cuts else F.lit(0)
    d = df.withColumn("__p", part)
    starts = d.groupBy("__p").agg(F.count("*").alias("__n")).withColumn("__s", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("__p").orderBy(order)) - 1
    d = d.withColumn("__r", rank).join(F.broadcast(starts.select("__p", "__s")), "__p")
    return d.withColumn("shard", ((F.col("__s") + F.col("__r")) % shards).cast("int")).drop("__p", "__r", "__s")


def round_robin(df: DataFrame, key: str, stratum: str, most: int, seed: str) -> DataFrame:
    """The first ``most`` rows when strata take turns, each in hash order (SM2, SM3)."""
    r = df.withColumn("round", F.row_number().over(Window.partitionBy(stratum).orderBy(stable_id(key, F.lit(seed)), key)))
    return r.orderBy("round", stratum).limit(most)


def quota_schedule(spark, total: int, **values: list[str]) -> DataFrame:
    """request_id and one value of each attribute, dealt by modular assignment (SM1)."""
    d = spark.range(total).withColumnRenamed("id", "i")
    step = 1
    for name, options in values.items():
        d = d.withColumn(name, F.element_at(F.array(*[F.lit(o) for o in options]), (F.floor(F.col("i") / step) % len(options) + 1).cast("int")))
        step *= len(options)
    return d.select(F.format_string("REQ%06d", F.col("i") + 1).alias("request_id"), *values)


def quota_audit(seen: DataFrame, planned: DataFrame, *by: str) -> DataFrame:
    """by, observed, expected, holds (AG13)."""
    a = seen.groupBy(*by).agg(F.count("*").alias("observed"))
    b = planned.groupBy(*by).agg(F.count("*").alias("expected"))
    o, e = F.coalesce("observed", F.lit(0)), F.coalesce("expected", F.lit(0))
    return a.join(b, list(by), "full").select(*by, o.alias("observed"), e.alias("expected"), (o == e).alias("holds"))


def pending(schedule: DataFrame, accepted: DataFrame, key: str = "request_id") -> DataFrame:
    """JN10."""
    return schedule.join(accepted.select(key), key, "left_anti")


def retry_counts(schedule: DataFrame, events: DataFrame) -> DataFrame:
    """request_id, retries: single and batch events exploded and counted, zero where none (AG22)."""
    ids = events.select(F.explode(F.coalesce(F.when(F.col("request_id").isNotNull(), F.array("request_id")), "request_ids")).alias("request_id"))
    n = ids.groupBy("request_id").agg(F.count("*").alias("retries"))
    return schedule.select("request_id").join(n, "request_id", "left").select("request_id", F.coalesce("retries", F.lit(0)).alias("retries"))


def over_budget(retries: DataFrame, most: int) -> DataFrame:
    """AG23."""
    return retries.where(F.col("retries") > most)


def sequential_id(prefix: str, digits: int, *order: Column | str) -> Column:
    """``prefix`` and a zero-padded row number in order (WN11)."""
    return F.format_string(f"{prefix}%0{digits}d", F.row_number().over(Window.orderBy(*order)))
