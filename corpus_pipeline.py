"""Corpus pipeline: the documents table through the corpus operators, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickwatch.llm import packing, quality, recompression, setsketch
from tickwatch.llm.common import materialise, read
from tickwatch.llm.queries import BYTE_BPE


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of low quality and toxic ones go."""
    return quality.kept(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest doc_id."""
    return setsketch.survivors(docs, threshold=75)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are cut out; every document stays."""
    return recompression.deduplicated(docs, window=50)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents packed into sequences of 1024 tokens."""
    return packing.pack(docs, BYTE_BPE, end_id=2, capacity=1024)


STAGES = [
    ("quality classifier", classify),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", repeats),
    ("best-fit packing", pack),
]
#: SQL has no tokenizer; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each reads what the one before has written."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{i + 1}")
    return docs
