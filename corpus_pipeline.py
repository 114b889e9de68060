"""A corpus from documents to token ids: toxicity, near-duplicates, decontamination, mixing, token store.

Every stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and its decisions take effect. All
but the last return the columns of documents. Stages are written between each other, so a lost executor costs one stage.
No SQL expresses toxicity, confirmed near-duplicates or token ids; ORACLE_SQL is None, and tests/llm compares the
pipeline with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm.common import stage, table
from corvane.llm.decontaminate import drop_contaminated
from corvane.llm.mixing import mixed
from corvane.llm.near_dedup import one_of_each
from corvane.llm.token_store import store_tokens
from corvane.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, 80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return store_tokens(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("token_ids", token_ids)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
