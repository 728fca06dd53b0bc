"""The corpus pipeline: stages that each read what the one before kept, written in between.

Language identification drops documents it rejects; exact deduplication keeps one of equal texts; near deduplication
keeps one document of each component (five-word shingles, similarity 0.8 or more); decontamination drops documents of
which benchmark windows cover a twentieth or more; packing returns the pieces of training sequences.

Defined cases: each stage handles null and empty texts, repeated rows and empty tables as its operator says. Documents
without letters are dropped by the first stage, so later ones see none. The four filtering stages drop by row, not by id:
rows that share an id, or have none, are judged on their own, and of rows that are equal in all columns one stays after
deduplication.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weir.llm import decontaminate, exact_dedup, langid, near_dedup, packing
from weir.session import Scratch, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, Scratch(spark, "stage1"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs, Scratch(spark, "stage2"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs, Scratch(spark, "stage3"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"), Scratch(spark, "stage4"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, Scratch(spark, "stage5"), packing.vocabulary())


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL has no byte-level BPE; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch.put(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
