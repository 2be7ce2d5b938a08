"""The corpus pipeline: language ID, near-duplicate removal, personal data, packing.

``STAGES`` are (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, written and
reread as the next one's docs. All but the last return the columns of ``documents``.

- language_id: documents whose language cannot be told go; lang becomes the predicted language.
- near_dedup: of each component of near duplicates the document with the smallest doc_id stays.
- personal_data: base and discovered spans are masked in the text; n_chars follows.
- packing: pieces of the documents in bins of permitted sequence lengths.

Every stage leaves an empty table empty and handles null texts, ids and labels as its operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import best_fit, bottom_k, language_id, personal_data
from millrace.llm.common import cut, small_batches
from millrace.session import importable


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    small_batches(spark)
    return language_id.keep_identified(docs, language_id.train(docs))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    small_batches(spark)
    return bottom_k.keep_one(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    small_batches(spark)
    return personal_data.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    small_batches(spark)
    return best_fit.pack(docs)


STAGES = [("language_id", identify), ("near_dedup", dedup), ("personal_data", redact), ("packing", pack)]

#: The stages train a network and iterate over graphs, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what lies between two stages is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, name)
    return docs
