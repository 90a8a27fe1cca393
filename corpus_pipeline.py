"""A training corpus from raw documents: five stages, each on all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame.  ``run`` writes what a
stage returns as Parquet in the shared folder, gives it to the next one, and removes it
when that one is written.  All but the last stage return the columns of ``documents``; the
last adds ``taken_words``.

In every stage columns keep their names and values whatever they are called, an empty table
gives an empty one, and texts are read whole.  What nulls and repeated rows do is said there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import decontaminate, mixing, quality_rules, simhash, toxicity
from palimpsest.llm.shared import checkpoint_dir, gone
from palimpsest.session import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep.

    Null and empty texts have no words and go; repeated rows are judged alike.
    """
    return quality_rules.kept(docs, table(spark, sf_dir, "labels"))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold.

    Null texts score as empty ones; repeated rows score alike; with labels of one class only,
    all are judged alike.
    """
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are 0.8 alike; none goes by its fingerprint alone.

    Null and blank texts are one group; of a group the smallest id stays, null ids last;
    of repeated rows one stays.
    """
    return simhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item.

    Null texts have no window and stay, as do repeated rows; an empty benchmark keeps all.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix of sources takes, with the words that it takes of each.

    Null is a source of its own, the last; texts without words are never taken; equal rows
    share alike.
    """
    return mixing.mixed_documents(docs)


STAGES = [("quality rules", quality), ("toxicity", toxic), ("near-duplicates", near_duplicates), ("decontamination", benchmark), ("mixing", mixture)]

#: Learned models decide in the first two stages, which SQL can't express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            gone(spark, f"{folder}/{k - 1}")
    return docs
