"""File sources: directory walk with content hashes, JSON arrays, JSON lines with crash recovery (SC1, SC2, SC4, SC5, SC10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Document types by suffix.
TYPES = {"pdf": "pdf", "html": "html", "htm": "html"}


def walk(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(files, audit): relative_path, content_sha256, document_type of supported files; path and reason of the others (SC1)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    uri = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    base = F.lit("/" + root.split("://")[-1].strip("/") + "/")
    rel = F.when(F.startswith(uri, base), F.substr(uri, F.length(base) + 1)).otherwise(uri)
    name = F.substring_index(rel, "/", -1)
    suffix = F.lower(F.substring_index(name, ".", -1))
    table = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    reason = F.when(F.startswith(name, F.lit(".")) | (F.lower(name) == "thumbs.db"), "hidden").when(table[suffix].isNull(), "unsupported")
    d = raw.select(rel.alias("relative_path"), "content", table[suffix].alias("document_type"), reason.alias("reason"))
    files = d.where("reason IS NULL").select("relative_path", F.sha2("content", 256).alias("content_sha256"), "document_type")
    return files, d.where("reason IS NOT NULL").select("relative_path", "reason")


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON array file; a missing file is an empty table (SC2)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def json_lines(lines: DataFrame, schema: str, order: str = "ord", line: str = "value") -> tuple[DataFrame, DataFrame]:
    """(rows, quarantined) of ordered lines: a malformed last line is set aside, one before it is an error (SC4, SC5)."""
    parsed = lines.where(F.trim(line) != "").withColumn("__v", F.try_parse_json(line))
    last = parsed.agg(F.max(order).alias("__last"))
    parsed = parsed.crossJoin(F.broadcast(last)).withColumn("__bad", F.col("__v").isNull())
    inner = F.col("__bad") & (F.col(order) < F.col("__last"))
    fail = F.raise_error(F.concat(F.lit("corrupt line "), F.col(order).cast("string"))).cast("boolean")
    # one expression decides and fails, so that no optimised filter can skip the failure
    rows = parsed.where(F.when(inner, fail).otherwise(~F.col("__bad"))).select(order, F.from_json(line, schema).alias("r")).select(order, "r.*")
    return rows, parsed.where(F.when(inner, fail).otherwise(F.col("__bad"))).select(order, line)


def hashed_fallback(declared: DataFrame, files: DataFrame) -> DataFrame:
    """Fallback paths whose file has the declared hash (SC10)."""
    return declared.join(files, (declared["fallback_path"] == files["relative_path"]) & (declared["fallback_sha256"] == files["content_sha256"]), "left_semi")


def nli_rows(raw: DataFrame) -> DataFrame:
    """id, premise, hypothesis, label of (id, sentence1, sentence2, label), label in 0..2, ids unique (SC9)."""
    ok = F.col("label").cast("int").isin(0, 1, 2)
    d = raw.where(ok).select("id", F.col("sentence1").alias("premise"), F.col("sentence2").alias("hypothesis"), F.col("label").cast("int").alias("label"))
    n = F.count("*").over(Window.partitionBy("id"))
    return d.withColumn("__n", F.when(n > 1, F.raise_error("duplicate id").cast("long")).otherwise(n)).where("__n = 1").drop("__n")


def row_set_hash(df: DataFrame, *columns: str) -> Column:
    """Order-free content digest pieces of a row set (ID5): aggregate with sum over the result."""
    return F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}))
