"""A training corpus from raw documents, in stages; each writes its table before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickfold.llm.common import table, written
from tickfold.llm.decontaminate import without_contaminated
from tickfold.llm.ngram_join import one_of_each
from tickfold.llm.packing import pack_documents, with_checksums
from tickfold.llm.secrets import without_secrets
from tickfold.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest labelled examples aren't toxic."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with masks in the place of secrets."""
    clean = without_secrets(docs)
    return clean.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    return with_checksums(pack_documents(docs))


STAGES = [
    ("toxicity", toxicity),
    ("ngram_join", ngram_join),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("packing", packing),
]

#: The classifiers and the tokenizer have no form in SQL; a test holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
