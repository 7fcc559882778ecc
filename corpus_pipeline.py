"""A training-data pipeline over `documents`: five stages, each one operator, each written and read again."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleweave.llm import bwt_dedup, decontam, langid, simhash, sp_codec
from ruleweave.llm.common import give_back, remove, shared_folder, table
from ruleweave.llm.queries import MODEL


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), or whose language is not determined, go; ids and repeats don't matter."""
    return langid.accepted(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest id stays; rows with a null id all stay, texts without words are one group."""
    return simhash.one_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that a document with a smaller id holds go; every row stays, null ids untouched, null texts as empty ones."""
    return bwt_dedup.without_repeats(docs).withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark windows in a twentieth of their words or more go; texts without words stay, rows of one id and text share a verdict."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What remains, encoded and decoded: the digests of operator 1, a row for each row (no ids for empty and null texts)."""
    return sp_codec.encode_decode(docs, MODEL)


def afresh(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """stage, begun with heaps that hold nothing of the stages before it."""

    @functools.wraps(stage)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        give_back(spark)
        return stage(spark, docs, sf_dir)

    return begun


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", afresh(language)),
    ("simhash_near_dedup", afresh(near_duplicates)),
    ("suffix_array_dedup", afresh(repeats)),
    ("benchmark_decontamination", afresh(contamination)),
    ("sentencepiece", afresh(tokens)),
]

#: Language ID is a trained model; SQL can't express the rows of run().
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage's result is Parquet in the shared folder until the next one is written.

    Null and empty texts go at the first stage, which finds no letter in them. Rows with null ids pass every stage
    but the language's and the benchmark's unjudged; repeated rows share each verdict; an empty table gives no rows.
    Columns besides those of documents stay until the last stage, whatever their names.
    """
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            remove(spark, before)
        before = f"{folder}/{name}"
    return docs
