"""Sinks: idempotent keyed append, manifest-last publishing, JSON text cells, workbook views (SK1-SK9, SR2, SR3)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def text_cells(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text (SK1); Parquet itself needs no such step."""
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "struct", "map")]
    return df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns])


def new_rows(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The incoming rows to append: unseen keys; an equal repeat is dropped, a different row under a known key is an error (SK5)."""
    body = [c for c in incoming.columns if c != key]
    digest = F.sha2(F.to_json(F.struct(*sorted(body)), {"ignoreNullFields": "false"}), 256)
    fresh = incoming.withColumn("__h", digest)
    w = Window.partitionBy(key)
    fresh = fresh.withColumn("__k", F.size(F.collect_set("__h").over(w))).withColumn("__n", F.row_number().over(w.orderBy("__h")))
    old = existing.select(F.col(key), F.sha2(F.to_json(F.struct(*sorted(body)), {"ignoreNullFields": "false"}), 256).alias("__old"))
    j = fresh.join(old, key, "left")
    conflict = (F.col("__k") > 1) | (F.col("__old").isNotNull() & (F.col("__old") != F.col("__h")))
    fail = F.raise_error(F.concat(F.lit("conflicting row for key "), F.col(key).cast("string"))).cast("boolean")
    # one expression decides and fails, so that no optimised filter can skip the failure
    return j.where(F.when(conflict, fail).otherwise(F.col("__old").isNull() & (F.col("__n") == 1))).select(incoming.columns)


def publish(spark: SparkSession, path: str, manifest: dict, **tables: DataFrame) -> None:
    """Write every table, then the manifest, which marks the set as complete (SK2, SK3, SK6)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/manifest.json")
    fs = target.getFileSystem(conf)
    fs.delete(target, False)
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    temp = jvm.org.apache.hadoop.fs.Path(f"{path}/.manifest.json.tmp")
    out = fs.create(temp, True)
    out.write(bytearray(json.dumps({**manifest, "tables": sorted(tables)}, sort_keys=True, indent=2).encode()))
    out.close()
    if not fs.rename(temp, target):
        raise OSError(f"could not publish {path}")


def variant_columns(df: DataFrame, key: str, variant: str, value: str, variants: list[str]) -> DataFrame:
    """One row per key, one column per variant (SK8)."""
    return df.groupBy(key).pivot(variant, variants).agg(F.first(value, ignorenulls=True))


def blind(df: DataFrame, *order: str) -> tuple[DataFrame, DataFrame]:
    """(sheet, key): rows under blind ids R0001.. and the table that resolves them (SK9); a sample is bounded."""
    rows = df.withColumn("blind_id", F.format_string("R%04d", F.row_number().over(Window.orderBy(*order))))
    return rows.drop(*order), rows.select("blind_id", *order)


def violations(rows: DataFrame, schedule: DataFrame, key: str) -> DataFrame:
    """key, reason: unknown and repeated keys of a checkpoint (SR2, JN14)."""
    unknown = rows.join(schedule.select(key), key, "left_anti").select(key, F.lit("unknown_key").alias("reason"))
    again = rows.groupBy(key).count().where("count > 1").select(key, F.lit("duplicate_key").alias("reason"))
    return unknown.unionAll(again)
