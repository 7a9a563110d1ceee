"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as
Parquet in the shared folder and read again as the next one's docs. All but the
last return the columns of ``documents``; the last returns the pieces of packed
sequences. Beside ``documents`` the stages read ``labels`` and ``benchmark``. A
stage's own tables in the shared folder go when the next one begins, so a session
runs one pipeline at a time.

Defined results, from the stages' modules: null and empty texts are texts without
words (one of them stays); texts of any length are read whole; repeated rows are
copies of one text; of copies the least id stays, and a row without an id only
where no copy has one; columns of any name pass through; empty tables give empty
tables, and without labels nothing is rejected.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from rollcall.llm import decontaminate, jaccard, packing, pii, quality, simhash
from rollcall.llm.common import scratch, stage_begins, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the hierarchical classifier keeps."""
    return quality.filtered(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8 or more; by covering tables of SimHashes and bands of MinHashes), that with the least id."""
    return simhash.one_of_each(docs, near=jaccard.near_duplicates, mark=jaccard.name)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly passages go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it give way to their kind."""
    return pii.sanitise(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 4096 tokens."""
    return packing.pack(docs, packing.tokenizer_path())


def _alone(stage):
    """The stage behind the removal of what earlier stages left in the shared folder."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        stage_begins(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("quality", _alone(quality_classifier)),
    ("near_duplicates", _alone(near_duplicates)),
    ("decontamination", _alone(decontamination)),
    ("personal_data", _alone(personal_data)),
    ("packing", _alone(packed)),
]

#: SQL can't express the classifier, SimHash components or the packing; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{scratch(spark)}/pipeline_{uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
