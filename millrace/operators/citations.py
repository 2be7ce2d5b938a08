"""Claims, citations and their support (MT4, AG18, TX27, FL15, FL16, PB1-PB4, WN8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import citations, claim_text


def claim_records(sentences: DataFrame) -> DataFrame:
    """response_id, claim_index, claim, claim_text, evidence_ids, is_factual of (response_id, start, text) (MT4)."""
    ids = citations(F.col("text"))
    index = F.row_number().over(Window.partitionBy("response_id").orderBy("start")) - 1
    return sentences.select("response_id", index.alias("claim_index"), F.col("text").alias("claim"), claim_text(F.col("text")).alias("claim_text"), ids.alias("evidence_ids"), (F.size(ids) > 0).alias("is_factual"))


def resolve(claims: DataFrame, ledger: DataFrame) -> DataFrame:
    """claims with known_ids and unknown_ids against the response's ledger (TX27, FL15)."""
    have = ledger.groupBy("response_id").agg(F.collect_set("evidence_id").alias("__have"))
    j = claims.join(have, "response_id", "left").withColumn("__have", F.coalesce("__have", F.array().cast("array<string>")))
    d = F.array_distinct("evidence_ids")
    return j.select(*claims.columns, F.array_intersect(d, "__have").alias("known_ids"), F.array_except(d, "__have").alias("unknown_ids"))


def support(claims: DataFrame, scores: DataFrame, threshold: float) -> DataFrame:
    """Per response: factual, supported, necessary and over-citation counts, precision, recall, necessity (AG18).

    ``scores`` (response_id, claim_index, premise_ids, score) holds the entailment of joint, single and
    leave-one-out premise sets; sets are keyed by their sorted ids.
    """
    s = scores.select("response_id", "claim_index", F.array_join(F.array_sort("premise_ids"), ",").alias("key"), "score")
    c = claims.where("is_factual").withColumn("ids", F.array_sort("known_ids"))
    joint = c.select("response_id", "claim_index", F.array_join("ids", ",").alias("key")).join(s, ["response_id", "claim_index", "key"], "left").select("response_id", "claim_index", F.coalesce(F.col("score") >= threshold, F.lit(False)).alias("supported"))
    each = c.select("response_id", "claim_index", "ids", F.explode("ids").alias("id"))
    single = each.withColumn("key", F.col("id")).join(s.withColumnRenamed("score", "alone"), ["response_id", "claim_index", "key"], "left").drop("key")
    rest = F.array_join(F.array_remove("ids", F.col("id")), ",")
    each = single.withColumn("key", rest).join(s.withColumnRenamed("score", "without"), ["response_id", "claim_index", "key"], "left")
    each = each.join(joint, ["response_id", "claim_index"])
    alone = F.coalesce(F.col("alone") >= threshold, F.lit(False))
    without = F.coalesce(F.col("without") >= threshold, F.lit(False))
    cited = each.groupBy("response_id").agg(F.count("*").alias("citations"), F.count_if(F.col("supported") & (alone | ~without)).alias("necessary"), F.count_if(F.col("supported") & ~alone & without).alias("overcitations"))
    base = joint.groupBy("response_id").agg(F.count("*").alias("factual"), F.count_if("supported").alias("supported"))
    j = base.join(cited, "response_id", "left").na.fill(0, ["citations", "necessary", "overcitations"])
    return j.select("response_id", "factual", "supported", "necessary", "overcitations", F.try_divide("supported", "factual").alias("claim_recall"), F.try_divide("necessary", "citations").alias("citation_precision"))


def ledger(evidence: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """group, evidence_id (E1..), text, digest in order (PB3)."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return evidence.select(group, F.concat(F.lit("E"), place).alias("evidence_id"), place.alias("place"), F.col(text).alias("displayed_text"), F.sha2(F.col(text), 256).alias("displayed_text_sha256"))


def ledger_violations(entries: DataFrame) -> DataFrame:
    """Entries whose span, digest or source slice does not hold (FL16)."""
    s, e = F.col("span_start"), F.col("span_end")
    reason = (
        F.when((s < 0) | (e <= s) | (e > F.length("source_text")), "offsets")
        .when(F.sha2("displayed_text", 256) != F.col("displayed_text_sha256"), "digest")
        .when(F.substr(F.col("source_text"), s + 1, e - s) != F.col("displayed_text"), "slice")
    )
    return entries.withColumn("reason", reason).where("reason IS NOT NULL")


def render(entries: DataFrame, group: str) -> DataFrame:
    """group, block: the ledger as one text in order (PB4); a ledger is bounded by its prompt."""
    line = F.concat(F.lit("["), "evidence_id", F.lit("] "), "displayed_text")
    rows = entries.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("l"))
    return rows.select(group, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("block"))


def fit_prompt(sizes: DataFrame, group: str, budget: int) -> DataFrame:
    """group, payload, evidence_count: the first payload that fits, with as much evidence as it can take (PB1, PB2).

    ``sizes`` (group, payload, base, place, size): token counts; place 0 stands for no evidence. Nothing is truncated.
    """
    w = Window.partitionBy(group, "payload").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    fit = sizes.withColumn("total", F.col("base") + F.sum("size").over(w)).where(F.col("total") <= budget)
    return fit.groupBy(group).agg(F.min(F.struct(F.col("payload"), (-F.col("place")).alias("k"), "total")).alias("b")).select(group, "b.payload", (-F.col("b.k")).alias("evidence_count"), "b.total")
