"""The training-data pipeline over `documents`: each stage applies one operator to all that the stage before kept.

Toxic documents go, then those that the quality policy rejects, then all but one of each near-duplicate class; what
is left is mixed to target weights (a document stands as often as the mix takes it) and packed into sequences.

Defined cases: a null doc_id, and one that several rows have, is a document like any other; it is never trained on, and where it is
one of a near-duplicate class the stage says which row stays. Null, empty and very long texts go through every stage whole (the
quality rules reject those of under 50 words). A stage that keeps nothing leaves an empty table, on which the later ones give empty
results. Columns besides those of documents are carried along, also where they are named like a stage's own; the last stage
returns its pieces alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from semblance.llm import mixing, neardup, packing, quality, toxicity
from semblance.llm.common import shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep(docs, table(spark, sf_dir, "labels"))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.first_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", apply_quality_rules),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Training, signatures, tokenisation and search are not SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
