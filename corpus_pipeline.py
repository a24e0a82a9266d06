"""A training-corpus pipeline over `documents`: five stages, each of which works on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents. Rows of null or clashing
columns are treated as each operator says. Stages set the session's Arrow batches to fewer rows, as batches of whole
texts would fill an executor's memory, and let shuffle files go with the query that wrote them, unless it says otherwise.
"""

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbral.llm import bpe, decontam, langid, secrets, similar
from umbral.llm.common import prepare, table, work_folder
from umbral.llm.queries import learns


def with_length(docs: DataFrame) -> DataFrame:
    """n_chars of texts that may have changed."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in none of the learned languages go; lang stays the given label."""
    prepare(spark)
    models = langid.fit(docs, learns(5, held=0))
    return langid.accepted(docs, models)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.8 or more of five-word runs that of the smallest id stays.

    SimHash balls propose candidates, and an exact join finds the links that three bits miss.
    """
    prepare(spark)
    return similar.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out; documents that are mostly such passages go."""
    prepare(spark)
    return with_length(decontam.remove(docs, table(spark, sf_dir, "benchmark")))


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials that few owners hold are masked."""
    prepare(spark)
    return with_length(secrets.redact(docs))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, with their number."""
    prepare(spark)
    ids = bpe.encode(docs.select("doc_id", "lang", "source", "text"), "text", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("scan_secrets", scan_secrets),
    ("tokenize", tokenize),
]

#: The first two stages and the last cannot be expressed in SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another, over documents."""
    docs, folder = table(spark, sf_dir, "documents"), f"{work_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
