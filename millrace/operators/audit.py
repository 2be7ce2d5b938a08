"""Filters that explain themselves (FL1-FL8, AG6): a decision column, and what follows from it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Audit:
    """One pass decides; kept, dropped, manifest and counts are views of it."""

    decided: DataFrame
    name: str

    @property
    def kept(self) -> DataFrame:
        return self.decided.where("kept").drop("kept", "reason")

    @property
    def dropped(self) -> DataFrame:
        return self.decided.where("NOT kept").drop("kept")

    def manifest(self, key: str) -> DataFrame:
        return self.decided.select(F.lit(self.name).alias("filter"), F.col(key), "kept", "reason")

    def counts(self) -> DataFrame:
        return self.decided.where("NOT kept").groupBy("reason").agg(F.count("*").alias("n"))

    def rollup(self) -> DataFrame:
        """filter, n_in, n_kept, n_dropped: one row (FL6)."""
        return self.decided.agg(F.lit(self.name).alias("filter"), F.count("*").alias("n_in"), F.count_if("kept").alias("n_kept"), F.count_if(~F.col("kept")).alias("n_dropped"))


def filter_audit(df: DataFrame, name: str, *rules: tuple[str, Column]) -> Audit:
    """Rows are dropped by the first rule (reason, drop condition) that holds; a null condition does not hold (FL1)."""
    reason = F.lit(None).cast("string")
    for why, drop in reversed(rules):
        reason = F.when(drop, F.lit(why)).otherwise(reason)
    return Audit(df.withColumn("reason", reason).withColumn("kept", F.col("reason").isNull()), name)


def by_category(df: DataFrame, column: Column, allowed: list[str], name: str = "category") -> Audit:
    """FL2: normalised membership."""
    return filter_audit(df, name, ("category_not_allowed", ~F.coalesce(F.lower(F.trim(column)).isin(allowed), F.lit(False))))


def rule_reasons(df: DataFrame, rules: DataFrame, key: str, text: str) -> DataFrame:
    """key, reasons: every rule of (rule_id, kind, mode, pattern, reason) that a text breaks, sorted (FL18-FL21).

    kind is regex or marker; mode is veto (must not occur) or require (must occur). The rule table is a bounded
    configuration: it is folded into one expression per rule, so nothing is joined.
    """
    checks = []
    for r in rules.collect():
        hit = F.regexp_like(F.col(text), F.lit(r["pattern"])) if r["kind"] == "regex" else F.contains(F.lower(F.col(text)), F.lit(r["pattern"].lower()))
        checks.append(F.when(hit if r["mode"] == "veto" else ~hit, F.lit(r["reason"])))
    reasons = F.array_sort(F.array_distinct(F.array_compact(F.array(*checks)))) if checks else F.array().cast("array<string>")
    return df.select(key, reasons.alias("reasons"))


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """The key groups that occur more than once (AG10); empty means unique."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def reason_counts(df: DataFrame, reasons: str = "reasons") -> DataFrame:
    """reason, n over an array column (AG6)."""
    return df.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def span_violations(df: DataFrame, text: str, start: str, end: str, surface: str) -> Column:
    """Reasons why a mention's span does not hold (FL8), as a sorted array."""
    s, e = F.col(start), F.col(end)
    return F.array_sort(
        F.array_compact(
            F.array(
                F.when(s.isNull() | e.isNull() | (s < 0) | (e <= s) | (e > F.length(text)), F.lit("invalid_span")),
                F.when(F.substr(F.col(text), s + 1, e - s) != F.col(surface), F.lit("span_text_mismatch")),
            )
        )
    )
