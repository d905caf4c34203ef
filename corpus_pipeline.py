"""A corpus pipeline over ``documents``: each stage works on all rows that its predecessor kept.

Order: toxic documents go, one document of each near-duplicate group stays, secrets are blotted out, sources are
mixed to target weights, and what is left is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardspark.llm import mixing, neardup, packing, secrets, toxicity
from wardspark.llm.common import stored, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below the threshold. The lexicon is learned from labelled rows of ``docs``."""
    return toxicity.accepted(docs, toxicity.fit(spark, sf_dir, docs))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates."""
    return neardup.deduplicated(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts blotted out."""
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn so that sources, languages and topics meet their target weights."""
    return mixing.sample(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequences and offsets."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("toxicity", toxicity_stage),
    ("MinHash near-dedup", neardup_stage),
    ("secret scans", secrets_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Learned scores, tokenizers and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
