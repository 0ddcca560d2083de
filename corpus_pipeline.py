"""A corpus pipeline of five stages, each by one operator of siltstone.llm.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of docs. What a stage decides, it decides on all that its predecessor
kept.

The classifying stages decide row by row, so that repeated or null identifiers don't matter; a null text counts as empty and
has no language, so that it goes with language ID at the latest. Of equal texts the exact stage keeps one row; of near copies
the row of smallest identifier stays (null after all others). Empty tables give empty results. Further columns of docs pass through all stages
but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import exact_dedup, language_id, near_dedup, packing, quality
from siltstone.llm.common import staged, table

#: A language decision with a smaller score rejects the document; four languages at equal votes have 0.25.
LEAST_LANGUAGE_SCORE = 0.3
#: Jaccard similarity of five-word shingles, in percent, from which documents are near copies.
NEAR_PERCENT = 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted_rows(docs, table(spark, sf_dir, "labels"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language."""
    return language_id.accepted_rows(docs, LEAST_LANGUAGE_SCORE)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The owner of each text."""
    return exact_dedup.kept_rows(docs).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near copies."""
    return near_dedup.kept_rows(docs, percent=NEAR_PERCENT)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.packed(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("language ID", known_language),
    ("exact dedup", without_copies),
    ("MinHash near-dedup", without_near_copies),
    ("packing", packed_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs


#: Classifiers and tokenizers are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None
