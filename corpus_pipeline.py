"""Documents to training sequences: language, near-duplicates, benchmark passages, personal data, packing.

Each stage works on all that its predecessor kept and returns the columns of `documents`, the last one
the packed pieces with their ids. Between stages the rows are written to the shared folder and read again.

Defined cases are those of the operators: null and empty texts are of no language and go in the first
stage; documents that share an id, or have none, are told apart by their texts; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longtail.llm import decontaminate, jaccard, langid, packing, pii
from longtail.llm.common import Scratch, table
from longtail.llm.queries import tokenizer


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that no language is found in."""
    return langid.reject(docs, langid.train(docs, ~langid.held_out("doc_id", 4, 2)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join."""
    return jaccard.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents of which a twentieth of the words or more lies in benchmark windows."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With personal data replaced by marks, and n_chars of the new text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids."""
    return packing.pack(docs, *tokenizer())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminated", decontaminated), ("without_pii", without_pii), ("packed", packed)]

#: SQL can neither train the language model nor run the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
