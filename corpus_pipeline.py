"""The corpus pipeline: stages over the documents table, each written as Parquet and read again as the next one's input.

1. language: rows without letters go, and those of which more than half of the words are of no language.
2. near_copies: of each class of similar documents the row with the smallest id stays.
3. benchmark: rows that hold a benchmark item, also with other numbers, names or units, go.
4. personal_data: spans of personal data in the text are replaced by their kind in brackets; n_chars follows.
5. tokens: the texts encoded and decoded again; doc_id, ids, n_tokens and the decoded text.

All stages but the last return the columns of documents as they came.  A stage works on all rows of its input.

Defined cases, in every stage: an empty table stays empty; a null text has no letters and goes in the first stage, and alone is its own class,
holds no item and no personal data and has no tokens in the others; an empty text likewise; very long texts are read whole; a null id
is kept; of repeated rows (equal id and text) the second stage keeps one, the others keep what they keep of one for each; ties between
copies go to the smaller id; columns beyond those of documents, whatever their names, come through all stages but the last.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haplospan.llm import bpe, decontaminate, jaccard, langid, pii
from haplospan.llm.common import discard, shared_dir, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.fit(docs, other=True))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    n_chars = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return pii.mask_personal_data(docs).withColumn("n_chars", n_chars)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    decoded = bpe.round_trip(docs, path, pattern)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").cast("string").alias("text"))


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("benchmark", benchmark),
    ("personal_data", personal_data),
    ("tokens", tokens),
]
ORACLE_SQL = None  # the first stage is a trained model, which SQL cannot express


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    done = None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if done:
            discard(done)  # nothing reads the stage before any more
        done = docs = spark.read.parquet(path)
    return docs
