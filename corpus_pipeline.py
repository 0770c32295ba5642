"""The corpus pipeline: language ID, near-duplicates, repeated strings, benchmark leaks, packing.

Each stage takes all documents that the one before has kept.  ``run`` applies
them in turn; a runner may also write each stage's rows and read them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxelflow.llm import decontamination, language_id, packing, simhash, suffix_dedup
from voxelflow.llm.common import read_table, workspace
from voxelflow.session import ship


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents whose language is undetermined go."""
    ship(spark)
    return language_id.keep_identified(docs, language_id.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of each group of near-duplicates the document of the smallest id stays."""
    ship(spark)
    return simhash.drop_near_duplicates(docs)


def cut_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: 200-byte strings that occur more than once are cut out of the texts."""
    ship(spark)
    return suffix_dedup.drop_repeated(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that contain a benchmark item go."""
    ship(spark)
    return decontamination.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: what is left, tokenized and packed into sequences; a row for each piece."""
    ship(spark)
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_strings", cut_repeated_strings),
    ("benchmark_leaks", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: The stages learn a classifier, hash with XXH64 and cut texts by bytes: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read again."""
    ship(spark)
    ws = workspace(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = ws.write(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            ws.drop(f"stage{k - 1}")
    return docs
