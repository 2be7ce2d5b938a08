"""Source registry and entity catalog (AG1-AG5, JN1, JN2, CA1, CA2, TK6, DD5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.ids import catalog_entity_id, stable_id
from millrace.functions.text import acronym_key, basename, initials, normalized, path_key, tokens
from millrace.operators.graph import label_components, one_to_one


def overlay_match(files: DataFrame, records: DataFrame) -> DataFrame:
    """relative_path, ord, matched_by: a file meets a record by hash, by path (equal or suffix), or by a file name
    that is unique on both sides (JN1, JN2).

    The suffix match is an equi-join on the file name first, so no pair of other names is ever compared.
    """
    f = files.select("relative_path", "content_sha256", path_key(F.col("relative_path")).alias("fp"), basename(F.col("relative_path")).alias("name"))
    r = records.select("ord", F.lower(F.col("sha256")).alias("sha"), path_key(F.col("path")).alias("rp"), basename(F.col("path")).alias("name"))
    by_hash = f.join(r, f["content_sha256"] == r["sha"]).select("relative_path", "ord", F.lit("hash").alias("matched_by"))
    same = f.join(r, "name")
    by_path = same.where((F.col("fp") == F.col("rp")) | F.endswith("fp", F.concat(F.lit("/"), "rp"))).select("relative_path", "ord", F.lit("path").alias("matched_by"))
    done = by_hash.unionAll(by_path)
    one_file = f.groupBy("name").agg(F.count("*").alias("n")).where("n = 1").select("name")
    one_record = r.groupBy("name").agg(F.count("*").alias("n")).where("n = 1").select("name")
    by_name = same.join(one_file, "name", "left_semi").join(one_record, "name", "left_semi").select("relative_path", "ord")
    by_name = by_name.join(done.select("relative_path"), "relative_path", "left_anti").join(done.select("ord"), "ord", "left_anti")
    order = F.when(F.col("matched_by") == "hash", 0).when(F.col("matched_by") == "path", 1).otherwise(2)
    every = done.unionByName(by_name.withColumn("matched_by", F.lit("basename")))
    return every.groupBy("relative_path", "ord").agg(F.min_by("matched_by", order).alias("matched_by"))


def content_registry(files: DataFrame) -> DataFrame:
    """One row per content hash: uid, first path, all paths, number of copies (AG1)."""
    g = files.groupBy("content_sha256").agg(F.array_sort(F.collect_set("relative_path")).alias("relative_paths"), F.count("*").alias("copies"))
    return g.select(F.concat(F.lit("DOC:"), F.substring("content_sha256", 1, 20)).alias("document_uid"), F.col("relative_paths")[0].alias("relative_path"), "relative_paths", "content_sha256", "copies")


def merged_metadata(records: DataFrame, key: str, reserved: tuple[str, ...] = ()) -> DataFrame:
    """key, name, values: distinct values of each metadata name in first-seen order (AG2); one value stays a list of one."""
    e = records.select(key, "ord", F.explode("extra").alias("name", "value")).where(~F.col("name").isin(list(reserved)) if reserved else F.lit(True))
    first = e.groupBy(key, "name", "value").agg(F.min("ord").alias("ord"))
    return first.groupBy(key, "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"]).alias("values"))


def by_priority(df: DataFrame, key: str, label: str, priority: dict[str, int]) -> DataFrame:
    """The label of highest priority per key (AG3)."""
    table = F.create_map(*[F.lit(x) for kv in priority.items() for x in kv])
    return df.groupBy(key).agg(F.min_by(label, F.coalesce(table[F.col(label)], F.lit(1 << 30))).alias(label))


def entity_catalog(rows: DataFrame) -> DataFrame:
    """entity_id, canonical_name, aliases, entity_type, namespace, ambiguous of (namespace, entity_type, label) (CA1).

    Exact aliases of compatible types merge first (``unknown`` joins the only known type of its alias); then an
    acronym merges with an expansion only if each has exactly one partner among the merged entities.
    """
    n = rows.select("namespace", "entity_type", F.trim("label").alias("label"), normalized(F.col("label")).alias("alias")).where("alias <> ''").distinct()
    kinds = n.where("entity_type <> 'unknown'").groupBy("namespace", "alias").agg(F.countDistinct("entity_type").alias("k"), F.min("entity_type").alias("only"))
    n = n.join(kinds, ["namespace", "alias"], "left")
    n = n.withColumn("kind", F.when((F.col("entity_type") == "unknown") & (F.col("k") == 1), F.col("only")).otherwise(F.col("entity_type")))
    node = stable_id("namespace", "kind", "alias")
    nodes = n.withColumn("id", node)
    keys = nodes.select("id", "namespace", "kind", "alias", acronym_key(F.col("label")).alias("acronym"), F.size(tokens(F.col("alias"))).alias("words"), initials(F.col("alias")).alias("initials")).distinct()
    short = keys.where("acronym IS NOT NULL").select("namespace", "acronym", F.col("id").alias("a"), F.col("kind").alias("ka"))
    long = keys.where("words >= 2").select("namespace", F.col("initials").alias("acronym"), F.col("id").alias("b"), F.col("kind").alias("kb"))
    pairs = short.join(long, ["namespace", "acronym"]).where("ka = kb OR ka = 'unknown' OR kb = 'unknown'")
    edges = one_to_one(pairs, "a", "b")
    roots = label_components(keys.select("id").distinct(), edges)
    best = F.struct(F.size(tokens(F.col("alias"))), F.length("label"), F.col("label"))
    out = nodes.join(roots, "id").groupBy("root", "namespace").agg(
        F.max_by("label", best).alias("canonical_name"),
        F.array_sort(F.collect_set("alias")).alias("aliases"),
        F.array_sort(F.collect_set(F.when(F.col("kind") != "unknown", F.col("kind")))).alias("kinds"),
    )
    out = out.select(catalog_entity_id("namespace", "root").alias("entity_id"), "canonical_name", "aliases", F.coalesce(F.get("kinds", F.lit(0)), F.lit("unknown")).alias("entity_type"), "namespace")
    shared = out.select("entity_id", "namespace", F.explode("aliases").alias("alias")).groupBy("namespace", "alias").agg(F.countDistinct("entity_id").alias("n")).where("n > 1").select("namespace", "alias")
    clash = out.select("entity_id", "namespace", F.explode("aliases").alias("alias")).join(shared, ["namespace", "alias"], "left_semi").select("entity_id").distinct()
    return out.join(clash.withColumn("ambiguous", F.lit(True)), "entity_id", "left").withColumn("ambiguous", F.coalesce("ambiguous", F.lit(False)))


def candidates(mentions: DataFrame, catalog: DataFrame, most: int = 10) -> DataFrame:
    """mention_id, rank, entity_id, canonical_name: entities with an alias equal to the mention, at most ``most`` (CA2, JN12, TK6)."""
    alias = catalog.select("entity_id", "canonical_name", "namespace", F.explode("aliases").alias("alias"))
    hit = mentions.select("mention_id", normalized(F.col("text")).alias("alias")).join(alias, "alias")
    order = Window.partitionBy("mention_id").orderBy(F.when(F.col("namespace") == "corpus", 0).otherwise(1), "canonical_name", "entity_id")
    return hit.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("mention_id", "rank", "entity_id", "canonical_name")
