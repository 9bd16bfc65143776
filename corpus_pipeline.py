"""The training-data pipeline: STAGES in order, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontaminate, mixing, quality_classifier, sharding, simhash
from corpusloom.llm.shared import cut, discard, scratch, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones, rejects go; so do null texts."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest doc_id."""
    return simhash.deduplicate(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, word for word or paraphrased, go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are repeated or dropped by draws from doc_id until each source has its target share of the characters."""
    return mixing.mix(docs, numbered=False)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are range-partitioned by doc_id into shards of even size, numbered in the new column shard."""
    return sharding.shard(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminated),
    ("mixing to target weights", mixed),
    ("sharding", sharded),
]
#: SQL expresses neither boosted trees nor SimHash nor LSA; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; each stage's result is written to the shared folder and read again.

    What a stage cuts for itself is deleted once its result is written, and that result once the next one is; only the
    input of the last stage, which is read when the result is, stays.

    Null texts go in the first stage. Rows with a null doc_id pass through: they are scored and searched by their text,
    never count as near duplicates, are drawn as one doc_id and come first in the shards. An empty text is scored like any
    other, and empty texts are duplicates of each other. Rows that repeat doc_id and text are one document, whose row the
    second stage keeps once; the fourth may repeat it. Of equally good duplicates the smallest doc_id stays. Texts count
    whole, however long. Null languages, sources and counts are kept, further columns too. From an empty table come no rows.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            rows = stage(spark, docs, sf_dir)
            docs = cut(rows, name.replace(" ", "-"), keep=True)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
