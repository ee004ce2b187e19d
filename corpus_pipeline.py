"""From raw documents to training sequences: five stages, each on all that the one before kept.

Every stage but the last returns the columns of ``documents``. What each does with
nulls, empty and very long texts, ties and repeated rows is the rule of its
operator; without documents every stage returns none.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from linkloom.llm import decontaminate, jaccard_join, packing, quality, substring_dedup
from linkloom.llm.common import written

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Workers have run other stages before, so the last one keeps fewer pieces of text.
CACHE_ENTRIES = 100_000
#: Rows that go to a Python worker at once; workers and executors keep less of a stage when the next begins.
BATCH_ROWS = 2_000


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similarity connect, the one with the least doc_id stays."""
    _small_batches(spark)
    return jaccard_join.keep_one(docs)


def repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes and more that an earlier document has are cut out."""
    _small_batches(spark)
    return substring_dedup.remove_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    _small_batches(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of binary lengths, with their ids."""
    _small_batches(spark)
    return packing.pack(docs, TOKENIZER, cache_entries=CACHE_ENTRIES, keep_encoder=False)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated text", repeated_text),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: SQL has no tokenizer, and the searches are too slow in it; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
