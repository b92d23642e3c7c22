"""The training-data pipeline over documents: quality rules, near-duplicates, decontamination, personal data, mixing.

Its result has one row for each pass of each document that is left, with its redacted text, in training order.

Defined cases, by stage (the operators' docstrings say more):

* quality rules: null and empty texts and texts of under ten words fail and go; equal rows stay or go together; null
  languages and sources are groups of their own.
* near-duplicates: the smallest id of a group stays, with all its rows; rows of a null id stay.
* decontamination: texts without tokens hold no passage and stay; equal rows go together; an empty benchmark drops nothing.
* personal data: no row goes; null text stays null; n_chars, where there is one, is made to fit the text.
* mixing: a null source is a source of its own, last; a document that is not taken comes last with taken 0; equal rows
  are taken each by itself.

Empty tables give no rows in every stage, and further columns, whatever their names, are kept; mixing's own replace those of the
same names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexengine.llm import decontamination, mixing, near_dedup, pii, quality_rules
from lexengine.llm.common import remove, scratch_dir, scratch_scope, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the outlier test rejects."""
    return quality_rules.keep_good(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return near_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold the benchmark's passages."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced in their texts."""
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each pass of each document, with its words and position, in training order."""
    return mixing.training_rows(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("near_dedup", dedup),
    ("decontamination", decontaminate),
    ("pii", private),
    ("mixing", mix),
]

#: The stages can't be expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's output is written to the shared folder and read as the next one's input.

    A stage's scratch tables, and its input, go when its output is written; the last output stays for the caller.
    """
    docs = table(spark, sf_dir, "documents")
    root = f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{root}/{k}-{name}"
        with scratch_scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
