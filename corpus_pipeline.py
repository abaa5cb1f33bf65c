"""The corpus pipeline: five stages from the ten operators, each over all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corpuskiln.llm import decontamination, near_copies, quality, secrets, sentencepieces
from corpuskiln.llm.common import drop, shared_dir, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Null and empty texts are scored like any other."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id; null and blank texts are one group.

    Near copies have a Jaccard similarity of 0.8 of their runs of five words; copies of these belong to the group.
    SimHash finds the closest, the rest is completed exactly: see ``near_copies``.
    """
    return near_copies.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words a twentieth or more lie in benchmark passages go."""
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by their kind in brackets; all documents stay."""
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, with its size and whether decoding gives the text back."""
    encoded = sentencepieces.encode(docs, sentencepieces.default_model(), check=True)
    return sentencepieces.digests(encoded, "ids")


STAGES = [
    ("quality classifier", keep_good),
    ("simhash near-dedup", keep_one_of_near_copies),
    ("benchmark decontamination", decontaminate),
    ("secret scans", redact),
    ("sentencepiece", encode),
]

#: The classifier's training can't be expressed in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the documents of sf_dir.

    What a stage returned lies in the shared folder until the next one's result is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    previous = None
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if previous:
            drop(spark, previous)
        docs, previous = spark.read.parquet(path), path
    return docs
