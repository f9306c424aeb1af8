"""A corpus pipeline in five stages; each takes what the one before kept.

toxicity -> near-duplicates -> benchmark decontamination -> mixing -> token output. A stage's result is written as
Parquet and read again as the next one's documents, so a lost executor costs a re-read at most. Nulls, empty texts,
repeated rows and other columns are treated as the operators' docstrings say; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import budget_mix, decontaminate, near_dedup, token_pack, toxicity
from millrace.llm.common import delete, owned, shared_dir, small_batches, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    small_batches(spark)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; documents are near from a similarity of 0.8 on."""
    return near_dedup.keep_one(docs, threshold=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or a re-parameterised one, go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return budget_mix.apply(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed token files' index: doc_id, start, n_tokens, ids_crc32."""
    small_batches(spark)
    return token_pack.round_trip(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("decontaminate", drop_leaks), ("mix", mix_sources), ("tokens", write_tokens)]

#: Training, signatures and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/millrace/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        with owned(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)  # what a stage took in is not needed once its result is written
        before = path
    return docs
