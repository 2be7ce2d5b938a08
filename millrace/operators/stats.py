"""Evaluation statistics (MT1-MT12, WN7, AG7-AG9, AG14, AG29, AG30, JN7, JN8)."""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import checkpoint_dir

TOLERANCE = 1e-12
#: The most differences whose sign assignments are all made, and how many of a larger group go to a task.
EXACT, SHARE = 16, 4096


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def metric_summary(long: DataFrame, *group: str) -> DataFrame:
    """group, n_scored, mean, n_rows over (status, value): only finite scored values count (AG7)."""
    ok = (F.col("status") == "scored") & finite(F.col("value"))
    return long.groupBy(*group).agg(F.count_if(ok).alias("n_scored"), F.avg(F.when(ok, F.col("value"))).alias("mean"), F.count("*").alias("n_rows"))


def count_map(df: DataFrame, group: list[str], key: str, name: str) -> DataFrame:
    """Per group a map from key to count, keys sorted (AG7, AG9)."""
    n = df.groupBy(*group, key).agg(F.count("*").alias("__n"))
    return n.groupBy(*group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "__n")))).alias(name))


def length_summary(df: DataFrame, value: str, *group: str) -> DataFrame:
    """n, min, max, mean, p25, median, p75 with linear interpolation (AG14)."""
    p = [F.percentile(value, q) for q in (0.25, 0.5, 0.75)]
    return df.groupBy(*group).agg(F.count(value).alias("n"), F.min(value).alias("min_len"), F.max(value).alias("max_len"), F.avg(value).alias("mean_len"), p[0].alias("p25"), p[1].alias("median"), p[2].alias("p75"))


def paired(df: DataFrame, key: str, variant: str, value: str, a: str, b: str) -> DataFrame:
    """key, a, b: the values of two variants side by side (JN7, JN8); ids of both variants only."""
    wide = df.where(F.col(variant).isin(a, b)).groupBy(key).agg(F.max(F.when(F.col(variant) == a, F.col(value))).alias("a"), F.max(F.when(F.col(variant) == b, F.col(value))).alias("b"))
    return wide.where(finite(F.col("a")) & finite(F.col("b")))


def paired_summary(pairs: DataFrame) -> DataFrame:
    """n, mean_difference, win_rate, tie_rate, loss_rate with a tolerance for ties (MT5)."""
    d = F.col("a") - F.col("b")
    return pairs.agg(
        F.count("*").alias("n"),
        F.avg(d).alias("mean_difference"),
        F.avg((d > TOLERANCE).cast("double")).alias("win_rate"),
        F.avg((F.abs(d) <= TOLERANCE).cast("double")).alias("tie_rate"),
        F.avg((d < -TOLERANCE).cast("double")).alias("loss_rate"),
    )


def exact_sign_permutation(differences: DataFrame, group: str, value: str, tolerance: float = TOLERANCE) -> DataFrame:
    """group, n, p_value: all 2^n sign assignments of at most ``EXACT`` differences (MT5).

    The assignments are folded inside the row: no row per assignment is made.
    """
    d = differences.groupBy(group).agg(F.collect_list(value).alias("d"))
    d = d.where(F.size("d") <= EXACT).withColumn("n", F.size("d"))
    sums = F.aggregate("d", F.array(F.lit(0.0)), lambda s, x: F.concat(F.transform(s, lambda y: y + x), F.transform(s, lambda y: y - x)))
    seen = F.abs(F.aggregate("d", F.lit(0.0), lambda s, x: s + x))
    d = d.withColumn("sums", sums).withColumn("seen", seen)
    hits = F.size(F.filter("sums", lambda y: F.abs(y) >= F.col("seen") - tolerance))
    return d.select(group, "n", (hits / F.size("sums")).alias("p_value"))


def sign_permutation(differences: DataFrame, group: str, value: str, tolerance: float = TOLERANCE, permutations: int = 10_000, seed: int = 42) -> DataFrame:
    """group, n, p_value of every group: exact up to ``EXACT`` differences, seeded Monte Carlo beyond (MT5)."""
    n = differences.groupBy(group).agg(F.count(value).cast("int").alias("n"))
    sizes = n.withColumnRenamed(group, "__g")
    same = F.col(group).eqNullSafe(F.col("__g"))
    few = differences.join(sizes.where(F.col("n") <= EXACT), same, "left_semi")
    many = differences.where(F.col(value).isNotNull()).join(sizes.where(F.col("n") > EXACT), same).drop("__g")
    return exact_sign_permutation(few, group, value, tolerance).unionByName(_sampled_sign_permutation(many, group, value, tolerance, permutations, seed))


def _sampled_sign_permutation(many: DataFrame, group: str, value: str, tolerance: float, permutations: int, seed: int) -> DataFrame:
    """(c + 1) / (N + 1) over N sign assignments of each group of (group, n, value).

    The signs of c equal values sum to 2 Binomial(c, 1/2) - c, drawn from a hash of (group, value), so a rerun gives
    the same. A group's values are dealt over several tasks, each of which gives one array of N sums.
    """
    cells = many.groupBy(group, "n", F.col(value).cast("double").alias("x")).agg(F.count("*").alias("c"))
    bucket = F.pmod(F.xxhash64("x"), F.ceil(F.col("n") / SHARE))
    cells = cells.withColumn("key", F.xxhash64(group, "x", F.lit(seed))).repartition(F.col(group), bucket).select(group, "n", "x", "c", "key")
    of = many.schema[group].dataType
    partial = T.StructType([T.StructField(group, of), T.StructField("n", T.IntegerType()), T.StructField("seen", T.DoubleType()), T.StructField("sums", T.ArrayType(T.DoubleType()))])
    result = T.StructType([T.StructField(group, of), T.StructField("n", T.IntegerType()), T.StructField("p_value", T.DoubleType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def rows() -> pa.RecordBatch:
            out = [pa.array([k[i] for k in held], kind) for i, kind in ((0, kinds[0]), (1, pa.int32()))]
            sums = pa.array([v[1] for v in held.values()], pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([*out, pa.array([v[0] for v in held.values()], pa.float64()), sums], partial.names)

        for b in batches:
            kinds = b.schema.types
            for g, n, x, c, key in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
                if (g, n) not in held and len(held) == 64:
                    yield rows()
                    held.clear()
                at = held.setdefault((g, n), [0.0, np.zeros(permutations)])
                r = np.random.Generator(np.random.Philox(key % (1 << 64)))
                heads = np.unpackbits(np.frombuffer(r.bytes(-(-permutations // 8)), np.uint8))[:permutations].astype(np.float64) if c == 1 else r.binomial(c, 0.5, permutations)
                at[0] += c * x
                at[1] += (2 * heads - c) * x
        if held:
            yield rows()

    def judge(t: pa.Table) -> pa.Table:
        sums = np.zeros(permutations)
        for one in t.column("sums"):
            sums += one.values.to_numpy()
        hits = int((np.abs(sums) >= abs(sum(t.column("seen").to_pylist())) - tolerance).sum())
        return pa.table([t.column(group).slice(0, 1), t.column("n").slice(0, 1), pa.array([(hits + 1) / (permutations + 1)])], names=result.names)

    return cells.mapInArrow(add, partial).groupBy(group).applyInArrow(judge, result)


def monte_carlo_sign_permutation(values: list[float], permutations: int = 10_000, seed: int = 42) -> float:
    """(c + 1) / (N + 1) over seeded sign flips; for samples too large for the exact test (MT5, MT11)."""
    r = random.Random(seed)
    seen = abs(sum(values))
    hits = sum(abs(sum(v if r.random() < 0.5 else -v for v in values)) >= seen - TOLERANCE for _ in range(permutations))
    return (hits + 1) / (permutations + 1)


def benjamini_hochberg(df: DataFrame, p: str, *order: str) -> DataFrame:
    """q_value: least p * m / rank from this rank on, at most 1; null p stays out of the family (WN7).

    Tests are kept in ranges of (p, order). Ranks and least values run within a range; one row a range carries them on,
    so no task sees the family and no frame is computed anew for each row.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    tests = df.where(F.col(p).isNotNull()).repartitionByRange(ranges, p, *order).withColumn("__b", F.spark_partition_id()).checkpoint()
    earlier = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = tests.groupBy("__b").agg(F.count("*").alias("__n"))
    starts = starts.select("__b", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__s"), F.sum("__n").over(Window.partitionBy()).alias("__m"))
    place = F.row_number().over(Window.partitionBy("__b").orderBy(p, *order))
    raw = tests.withColumn("__r", place).join(F.broadcast(starts), "__b").withColumn("__r", F.col("__r") + F.col("__s"))
    raw = raw.withColumn("__raw", F.col(p) * F.col("__m") / F.col("__r"))
    later = Window.orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    low = raw.groupBy("__b").agg(F.min("__raw").alias("__low")).select("__b", F.min("__low").over(later).alias("__low"))
    own = F.min("__raw").over(Window.partitionBy("__b").orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, 0))
    q = raw.withColumn("__own", own).join(F.broadcast(low), "__b").withColumn("q_value", F.least(F.lit(1.0), "__own", "__low"))
    return q.select(*df.columns, "q_value").unionByName(df.where(F.col(p).isNull()).withColumn("q_value", F.lit(None).cast("double")))


def bootstrap_mean_ci(df: DataFrame, value: str, resamples: int = 10_000, confidence: float = 0.95, seed: int = 1) -> DataFrame:
    """mean, low, high: percentile interval over Poisson resamples drawn in one pass (MT7; statistical, not bitwise, parity).

    The weights of n equal values sum to Poisson(n), drawn in the scan from a hash of the value, so a rerun gives the
    same; each task gives one row a resample.
    """
    cells = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("x")).agg(F.count("*").alias("n"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, total = np.zeros(resamples), np.zeros(resamples)
        for b in batches:
            for x, n, key in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                w = np.random.Generator(np.random.Philox(key % (1 << 64))).poisson(n, resamples)
                weight += w
                total += w * x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples)), pa.array(weight), pa.array(total)], ["i", "w", "t"])

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: not to be coalesced
    sums = cells.withColumn("key", F.xxhash64("x", F.lit(seed))).repartition(tasks, "x").mapInArrow(add, "i long, w double, t double")
    means = sums.groupBy("i").agg(F.try_divide(F.sum("t"), F.sum("w")).alias("m"))
    tail = (1 - confidence) / 2
    return means.agg(F.percentile("m", tail).alias("low"), F.percentile("m", 1 - tail).alias("high")).crossJoin(df.agg(F.avg(value).alias("mean")))


def weighted_kappa(ratings: DataFrame, a: str, b: str, power: int = 1) -> DataFrame:
    """n, kappa of two raters' columns over rows where both rated; weights |i-j|^power on category ranks (MT8)."""
    both = ratings.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    cells = both.groupBy("a", "b").agg(F.count("*").cast("double").alias("n"))
    ranks = cells.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    ranks = ranks.withColumn("r", F.dense_rank().over(Window.orderBy("v")))
    cells = cells.join(ranks.select(F.col("v").alias("a"), F.col("r").alias("i")), "a").join(ranks.select(F.col("v").alias("b"), F.col("r").alias("j")), "b")
    rows, cols = cells.groupBy("i").agg(F.sum("n").alias("x")), cells.groupBy("j").agg(F.sum("n").alias("y"))
    weight = F.pow(F.abs(F.col("i") - F.col("j")).cast("double"), F.lit(float(power)))
    seen = cells.agg(F.sum("n").alias("n"), F.sum(weight * F.col("n")).alias("seen"))
    chance = rows.crossJoin(cols).agg(F.sum(weight * F.col("x") * F.col("y")).alias("chance"))  # categories squared
    ratio = F.when(F.col("chance") == 0, 1.0).otherwise(1 - F.col("seen") * F.col("n") / F.col("chance"))
    return seen.crossJoin(chance).select(F.col("n").cast("long").alias("n"), ratio.alias("kappa"))


def ordinal_alpha(ratings: DataFrame, unit: str, rater: str, score: str) -> DataFrame:
    """n_units, alpha: Krippendorff's alpha with squared distance of category ranks (MT9)."""
    r = ratings.where(F.col(score).isNotNull())
    r = r.join(r.select(score).distinct().withColumn("rank", F.dense_rank().over(Window.orderBy(score)).cast("double")), score)
    u = r.groupBy(unit).agg(F.count("*").cast("double").alias("m"), F.sum("rank").alias("s"), F.sum(F.col("rank") * F.col("rank")).alias("q")).where("m > 1")
    # sum over ordered pairs of (x - y)^2 is 2 (m q - s^2), so no pairs are made
    totals = u.agg(F.count("*").alias("n_units"), F.sum(2 * (F.col("m") * F.col("q") - F.col("s") * F.col("s")) / (F.col("m") - 1)).alias("seen"), F.sum("m").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    chance = 2 * (F.col("n") * F.col("q") - F.col("s") * F.col("s"))
    return totals.select("n_units", F.when(chance == 0, 1.0).otherwise(1 - F.col("seen") * (F.col("n") - 1) / chance).alias("alpha"))


def metric_family(long: DataFrame, key: str, variant: str, metrics: list[str], comparisons: list[tuple[str, str]], lower: list[str] | None = None, permutations: int = 10_000, seed: int = 42) -> DataFrame:
    """comparison, metric, direction, n, mean_difference, win_rate, tie_rate, loss_rate, status, p_value, q_value (MT6).

    One row a declared comparison and metric, tested or not: ``long`` has a row per (key, variant) with a column per
    metric. A ``<metric>_status`` column, if there, decides: only ``scored`` counts. Where a lower value is better the
    sides are swapped. Every p-value takes part in one family of corrections; no pairs make it null. Only the grid of
    tests, never the rows, is in one task.
    """
    lower = lower or []

    def cell(m: str) -> Column:
        value = F.col(m).cast("double")
        has_status = f"{m}_status" in long.columns
        scored = F.when(F.col(f"{m}_status").isNull() | (F.col(f"{m}_status") == "scored"), value) if has_status else value
        return F.struct(F.lit(m).alias("metric"), F.lit(-1.0 if m in lower else 1.0).alias("sign"), scored.alias("v"))

    each = long.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(variant).alias("__variant"), F.explode(F.array(*map(cell, metrics))).alias("x"))
    each = each.select("id", "__variant", "x.*")
    sides = F.explode(F.array(*[F.struct(F.lit(f"{a}_vs_{b}").alias("comparison"), F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in comparisons]))
    each = each.withColumn("c", sides).where(F.col("__variant").isin(F.col("c.a"), F.col("c.b")))
    pair = each.groupBy("c.comparison", "metric", "id").agg(
        F.max("sign").alias("sign"),
        F.max(F.when(F.col("__variant") == F.col("c.a"), F.col("v"))).alias("a"),
        F.max(F.when(F.col("__variant") == F.col("c.b"), F.col("v"))).alias("b"),
    )
    pair = pair.where(finite(F.col("a")) & finite(F.col("b"))).withColumn("d", (F.col("a") - F.col("b")) * F.col("sign"))
    pair = pair.select(F.concat_ws("\x1f", "comparison", "metric").alias("test"), "d")
    d = F.col("d")
    summary = pair.groupBy("test").agg(
        F.avg(d).alias("mean_difference"),
        F.avg((d > TOLERANCE).cast("double")).alias("win_rate"),
        F.avg((F.abs(d) <= TOLERANCE).cast("double")).alias("tie_rate"),
        F.avg((d < -TOLERANCE).cast("double")).alias("loss_rate"),
    )
    tests = summary.join(sign_permutation(pair, "test", "d", TOLERANCE, permutations, seed), "test")
    grid = [(f"{a}_vs_{b}", m, "lower" if m in lower else "higher") for a, b in comparisons for m in metrics]
    grid = long.sparkSession.createDataFrame(grid, "comparison string, metric string, direction string")
    out = grid.join(tests, F.concat_ws("\x1f", "comparison", "metric") == F.col("test"), "left").drop("test")
    out = out.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("status", F.when(F.col("n") == 0, "insufficient_pairs").otherwise("scored"))
    return benjamini_hochberg(out, "p_value", "comparison", "metric")


def agreement_report(ratings: DataFrame, unit: str, rater: str, score: str) -> DataFrame:
    """One row: distinct_raters, unit_count, overlap_count, observed_cells, expected_cells, missingness_count, alpha,
    status and kappa, a map from ``a_vs_b`` to quadratically weighted kappa (null without common units) (MT10).

    A null score is a missing cell. The same rater twice in one unit, a null rater, or fewer than two raters is an
    error, raised when the rows are computed. Units with the same scores by the same raters are counted as one pattern
    before pairs of raters are made, so their number does not grow with the units.
    """
    r = ratings.select(F.col(unit).alias("u"), F.when(F.col(rater).isNull(), F.raise_error(F.lit("annotation row must contain rater"))).otherwise(F.col(rater).cast("string")).alias("r"), F.col(score).alias("s"))
    cells = r.groupBy("u", "r").agg(F.max("s").alias("s"), F.count("*").alias("k"))
    cells = cells.select("u", "r", F.when(F.col("k") > 1, F.raise_error(F.lit("duplicate annotation"))).otherwise(F.col("s")).alias("s"))
    units = cells.groupBy("u").agg(F.array_sort(F.collect_list(F.when(F.col("s").isNotNull(), F.struct("r", "s")))).alias("row"))
    patterns = units.groupBy("row").agg(F.count("*").alias("k"))
    counts = patterns.agg(F.sum("k").alias("unit_count"), F.sum(F.when(F.size("row") > 1, F.col("k")).otherwise(0)).alias("overlap_count"), F.sum(F.size("row") * F.col("k")).alias("observed_cells"))
    names = r.agg(F.array_sort(F.collect_set("r")).alias("names"))

    met = F.flatten(F.transform("row", lambda x, i: F.transform(F.slice("row", i + 2, F.size("row")), lambda y: F.struct(x["r"].alias("ra"), y["r"].alias("rb"), x["s"].alias("a"), y["s"].alias("b")))))
    cross = patterns.where(F.size("row") > 1).select("k", F.explode(met).alias("m")).groupBy("m.ra", "m.rb", "m.a", "m.b").agg(F.sum("k").cast("double").alias("n"))
    pair = ["ra", "rb"]
    ranks = cross.select(*pair, F.explode(F.array("a", "b")).alias("v")).distinct().withColumn("i", F.dense_rank().over(Window.partitionBy(*pair).orderBy("v")))
    cross = cross.join(ranks.withColumnsRenamed({"v": "a"}), [*pair, "a"]).join(ranks.withColumnsRenamed({"v": "b", "i": "j"}), [*pair, "b"])
    apart = F.pow((F.col("i") - F.col("j")).cast("double"), F.lit(2.0))
    seen = cross.groupBy(*pair).agg(F.sum("n").alias("n"), F.sum(apart * F.col("n")).alias("seen"))
    x, y = cross.groupBy(*pair, "i").agg(F.sum("n").alias("x")), cross.groupBy(*pair, "j").agg(F.sum("n").alias("y"))
    chance = x.join(y, pair).groupBy(*pair).agg(F.sum(apart * F.col("x") * F.col("y")).alias("chance"))  # categories squared
    kappa = F.when(F.col("chance") == 0, 1.0).otherwise(1 - F.col("seen") * F.col("n") / F.col("chance"))
    kappas = seen.join(chance, pair).agg(F.map_from_entries(F.collect_list(F.struct(F.concat("ra", F.lit("_vs_"), "rb"), kappa))).alias("known"))

    pairs = F.flatten(F.transform("names", lambda p, i: F.transform(F.slice("names", i + 2, F.size("names")), lambda q: F.concat(p, F.lit("_vs_"), q))))
    one = counts.crossJoin(names).crossJoin(kappas).crossJoin(ordinal_alpha(cells, "u", "r", "s").select("alpha"))  # one row each
    few = F.when(F.size("names") < 2, F.raise_error(F.lit("at least two distinct raters are required"))).otherwise(F.size("names"))
    one = one.withColumn("distinct_raters", few).withColumn("expected_cells", F.col("unit_count") * F.col("distinct_raters"))
    return one.select(
        "distinct_raters", "unit_count", "overlap_count", "observed_cells", "expected_cells",
        (F.col("expected_cells") - F.col("observed_cells")).alias("missingness_count"), "alpha",
        F.when(F.col("overlap_count") > 0, "scored").otherwise("insufficient_overlap").alias("status"),
        F.map_from_entries(F.transform(pairs, lambda p: F.struct(p, F.try_element_at("known", p)))).alias("kappa"),
    )


def binary_metrics(df: DataFrame, gold: Column, predicted: Column, *group: str) -> DataFrame:
    """support, precision, recall, f1; 0 where undefined (AG30)."""
    t = df.groupBy(*group).agg(F.count_if(gold & predicted).alias("tp"), F.count_if(~gold & predicted).alias("fp"), F.count_if(gold & ~predicted).alias("fn"))
    p = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0))
    r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    f = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return t.select(*group, (F.col("tp") + F.col("fn")).alias("support"), p.alias("precision"), r.alias("recall"), f.alias("f1"))


def threshold_grid(df: DataFrame, gold: str, score: str, grid: list[float]) -> DataFrame:
    """threshold, support, precision, recall, f1 for each threshold of a fixed grid (MT12): one pass over the rows."""
    each = df.select(F.col(gold).alias("g"), F.col(score).alias("s"), F.explode(F.array(*[F.lit(t) for t in grid])).alias("threshold"))
    return binary_metrics(each, F.col("g"), F.col("s") >= F.col("threshold"), "threshold")


def best_threshold(grid: DataFrame, objective: str = "f1") -> DataFrame:
    """The greatest objective, the least threshold on ties (MT12)."""
    return grid.agg(F.max_by("threshold", F.struct(F.col(objective), -F.col("threshold"))).alias("threshold"), F.max(objective).alias(objective))


def chrf(reference: Column, hypothesis: Column, order: int = 6, beta: float = 2.0) -> Column:
    """Mean over n-gram orders of the F-beta of character n-grams, case-folded, without white space (MT1).

    Whole texts are counted in an Arrow function; null if either is missing.
    """

    def one(r: str, h: str) -> float:
        r, h = "".join(r.casefold().split()), "".join(h.casefold().split())
        scores = []
        for n in range(1, min(order, len(r), len(h)) + 1):
            a, b = (Counter(x[i : i + n] for i in range(len(x) - n + 1)) for x in (r, h))
            both = (a & b).total()
            p, q = both / (len(h) - n + 1), both / (len(r) - n + 1)
            scores.append((1 + beta**2) * p * q / (beta**2 * p + q) if both else 0.0)
        return sum(scores) / len(scores) if scores else 0.0

    @F.pandas_udf(T.DoubleType())
    def score(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
        return pd.Series([None if r is None or h is None else one(r, h) for r, h in zip(reference, hypothesis, strict=True)], dtype="float64")

    return score(reference, hypothesis)


@F.pandas_udf(T.DoubleType())
def rouge_l(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    """F1 of the longest common subsequence of word tokens (MT3); null if either is missing."""

    def lcs(a: list[str], b: list[str]) -> int:
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                row[j], last = (last + 1 if x == y else max(row[j], row[j - 1])), row[j]
        return row[-1]

    out = []
    for r, h in zip(reference, hypothesis, strict=True):
        if r is None or h is None:
            out.append(None)
            continue
        a, b = r.lower().split(), h.lower().split()
        n = lcs(a, b) if a and b else 0
        out.append(2 * n / (len(a) + len(b)) if n else 0.0)
    return pd.Series(out)
