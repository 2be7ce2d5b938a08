"""Evaluation of one response a row, with the provenance of language and status (MT2).

Detectors and scorers are the caller's column functions; one that is left out is unavailable. A scorer is given null
texts where its metric does not apply, so a model behind it never sees them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import language_label, metric_envelope, optional_text, script_bucket, script_match
from millrace.operators.stats import chrf

# Languages that are evaluated, and the metrics that are for English only.
SUPPORTED = ["en", "hi", "ta"]
ENGLISH_ONLY = ["rouge_l", "meteor", "detoxify"]

Detector = Callable[[Column], Column]
Scorer = Callable[[Column, Column], Column]


def _once(df: DataFrame) -> DataFrame:
    """The same rows; the optimiser does not move expressions across, so what many others use is generated once."""
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("__x")).select("__x.*")


def evaluate_records(records: DataFrame, id_: str, text: str, reference: str, response: str, language: str, detector: Detector | None = None, scorers: dict[str, Scorer] | None = None) -> DataFrame:
    """ID, languages, matches, reference_available and ``metrics``, a map of chrf, bertscore, rouge_l, meteor and
    detoxify to (value, status, reason); one row a record.

    Without an expected language the detected one of the text counts; one that differs from any detected language is a
    mismatch. ``scored`` values that are not finite become ``invalid_score``. A scorer takes (reference, hypothesis);
    it may not fail, an unusable score is null.
    """
    scorers = scorers or {}

    def detected(x: Column) -> Column:
        return F.when(optional_text(x).isNotNull(), language_label(detector(x))) if detector else F.lit(None).cast("string")

    r = records.select(F.coalesce(F.col(id_).cast("string"), F.lit("")).alias("ID"), F.col(text).alias("__t"), optional_text(F.col(reference)).alias("__r"), optional_text(F.col(response)).alias("__h"), language_label(F.col(language)).alias("expected_language"))
    r = _once(r).withColumns({"input_language": detected(F.col("__t")), "reference_language": detected(F.col("__r")), "output_language": detected(F.col("__h"))})
    r = _once(r.withColumn("language", F.coalesce("expected_language", "input_language")))
    lang = F.col("language")
    differs = F.lit(False)
    for c in ("input_language", "reference_language", "output_language"):
        differs = differs | F.coalesce(F.col(c) != lang, F.lit(False))
    status = F.when(lang.isNull(), "unavailable").when(~lang.isin(SUPPORTED), "unsupported_language").when(F.col("input_language").isNull(), "unavailable").when(differs, "mismatch").otherwise("scored")
    r = _once(r.withColumn("language_status", status))
    ref, hyp = F.col("__r"), F.col("__h")
    missing = F.when(ref.isNull(), F.lit("missing_reference")).when(hyp.isNull(), F.lit("missing_hypothesis"))
    missing_status = F.when(ref.isNull(), F.lit("excluded_missing_reference")).when(hyp.isNull(), F.lit("missing_hypothesis"))
    none = F.lit(None).cast("string")

    def judged(name: str, applies: Column, excluded: str, needs_both: bool = True) -> Column:
        mismatch = F.col("language_status") == "mismatch"
        applies = (F.col("language_status") == "scored") & applies
        lacks = missing.isNotNull() if needs_both else F.lit(False)
        out = F.when(mismatch, F.struct(F.lit("language_mismatch").alias("s"), F.lit("detected_language_mismatch").alias("r")))
        out = out.when(~applies, F.struct(F.lit("unsupported_language").alias("s"), F.lit(excluded).alias("r")))
        out = out.when(lacks, F.struct(missing_status.alias("s"), missing.alias("r")))
        if name not in scorers:
            return out.otherwise(F.struct(F.lit("unavailable").alias("s"), F.lit(f"{name}_scorer_unavailable").alias("r")))
        return out.otherwise(F.struct(F.lit("scored").alias("s"), none.alias("r")))

    both = missing.isNull()
    states = {
        "chrf": F.struct(F.when(both, "scored").otherwise(missing_status).alias("s"), missing.alias("r")),
        "bertscore": judged("bertscore", F.lit(True), "language_not_supported"),
        **{m: judged(m, lang == "en", "english_only_metric", m != "detoxify") for m in ENGLISH_ONLY},
    }
    # states and values are columns of their own, so that no expression is generated twice
    r = _once(r.withColumns({f"__s_{m}": x for m, x in states.items()}))

    def value(m: str) -> Column:
        if m == "chrf":
            return chrf(ref, hyp)
        scorer = scorers.get(m)
        asked = F.col(f"__s_{m}")["s"] == "scored"
        return F.when(asked, scorer(F.when(asked, ref), F.when(asked, hyp)).cast("double")) if scorer else F.lit(None).cast("double")

    r = r.withColumns({f"__v_{m}": value(m) for m in states})
    metrics = {m: metric_envelope(F.col(f"__v_{m}"), F.col(f"__s_{m}")["s"], F.col(f"__s_{m}")["r"]) for m in states}
    return r.select(
        "ID", "language", "language_status", "expected_language", "input_language", "reference_language", "output_language",
        (lang == F.col("output_language")).alias("language_match"),
        (lang == F.col("input_language")).alias("input_language_match"),
        (lang == F.col("reference_language")).alias("reference_language_match"),
        script_match(script_bucket(F.col("__t")), script_bucket(hyp)).alias("script_match"),
        ref.isNotNull().alias("reference_available"),
        F.create_map(*[x for m, v in metrics.items() for x in (F.lit(m), v)]).alias("metrics"),
    )
