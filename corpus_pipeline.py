"""A corpus pipeline: filter, deduplicate, decontaminate and pack `documents`.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame that is written as
Parquet and read again for the next. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sigloom.llm import decontaminate, langid, near_dup, packing, toxicity
from sigloom.llm.common import discard, read_table, written


#: A language that is told with less is not told.
LEAST_LANGUAGE_SCORE = 0.5


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score 0.5 or more for toxicity; learned from the labels outside the held-out fold."""
    return toxicity.keep_harmless(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose text has no letter, or in which no language outweighs all others together."""
    return langid.keep_known(docs, langid.fit(docs), least_score=LEAST_LANGUAGE_SCORE)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dup.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of a benchmark item."""
    return decontaminate.remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents' tokens in sequences of at most 4096."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", harmless),
    ("language", known_language),
    ("near_duplicates", one_of_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: SQL cannot express the learned stages; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(*before)
        before = [docs]
    return docs
