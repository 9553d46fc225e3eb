"""The corpus pipeline: quality filter, language filter, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame; all
but the last return the columns of documents. A stage's model is fitted on the rows that it is given.

Defined results: rows without an id take part in all stages, and one stays of a group of near-duplicates in which no
row has one; rows that repeat an id with different texts stay each; null and empty texts have no letter and go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievework.llm import langid, packing, quality, simhash
from sievework.llm.common import materialize, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose quality score is 0.7 or more; labels of sf_dir train the score."""
    beside = materialize(quality.beside_rows(docs), "statistics")
    return quality.keep_scored(beside, quality.train(beside, table(spark, sf_dir, "labels")))


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is determined: texts without letters and texts of no learned language go."""
    return langid.keep_identified(docs, langid.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates."""
    return simhash.keep_first(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents and their places in sequences."""
    return packing.pack_documents(docs, packing.default_tokenizer())


STAGES = [("quality_filter", quality_filter), ("language_filter", language_filter), ("near_dedup", near_dedup), ("pack", pack)]

#: The stages score texts with trained models and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
