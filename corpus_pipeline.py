"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept, written as Parquet and read again. All but the last return the columns of
``documents``: language ID drops texts that are in no known language, near-dedup keeps one document of each group, the
secret scan blanks secrets in the text, mixing repeats, cuts or leaves documents by their source's target, and packing
gives every piece its place in a sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lemmata.llm import langid, mixing, neardup, packing, secrets
from lemmata.llm.common import forget, keep, small_batches, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.recognised(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with small_batches(spark):  # sets of long texts come in batches of whatever size is allowed, on both sides
        return neardup.deduplicated(docs, width=5, similarity=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secret_scan), ("mix", mix), ("pack", pack)]

#: Networks, sketches and tokenizers are not SQL; the stages are held against plain versions in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:  # what a stage wrote has been read by the next
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
