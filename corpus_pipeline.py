"""Corpus pipeline over ``documents``: each stage reads what its predecessor kept, as Parquet.

The stages filter (toxicity, near-duplicates, benchmark leaks), order (mixing) and place
(sharding). All but the last return the columns of ``documents``; the mix is the order of the
written rows, which sharding follows when it numbers the slots of a shard.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from probity.llm import decontaminate, mixing, neardup, sharding, toxicity
from probity.llm import text as T


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the factorization machine scores under 0.5."""
    return toxicity.drop_toxic(docs, T.read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each class of near-duplicates (similarity 0.8)."""
    return neardup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    return decontaminate.drop_contaminated(docs, T.read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the Pfair schedule."""
    return mixing.mixed_order(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, shard and slot; slots follow the order of the rows in ``docs``' files."""
    return sharding.shard_in_order(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The classifier, the sketches and the schedule can't be stated in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what each returns is written to the shared folder and reread. A
    stage's rows are deleted when the next one has written its own; those the result reads stay."""
    docs, before = T.read(spark, sf_dir, "documents"), None
    folder = f"{T.checkpoint_dir(spark)}/probity-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            T.remove_folder(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
