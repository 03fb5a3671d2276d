"""From documents to tokens: toxicity, near duplicates, personal data, mixture, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame that is
written as Parquet and reread as the next one's docs. All but the last return the columns of documents. A null or
empty text passes the filters and ends without tokens; a row without a doc_id passes up to the mixture, in which it has
no place; rows that repeat a doc_id are separate rows throughout; columns that documents doesn't have are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import bpe, jaccard, mixing, pii, toxicity
from weftgraph.llm.common import materialise, table


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model doesn't take for toxic."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.keep_one(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts replaced by its kind."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture at target weights within the token budget, in mixed order."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their character offsets."""
    return bpe.encode(docs)


STAGES = [("toxicity", clean), ("near_duplicates", distinct), ("pii", private), ("mixture", mixed), ("bpe", tokens)]

#: No SQL says the trained model of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
