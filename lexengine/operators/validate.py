"""Checks of sentences against the dictionary, and retrieval evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.scratch import written
from .lookup import lookup


def unknown_tokens(sentences: DataFrame, lemmas: DataFrame, forms: DataFrame) -> DataFrame:
    """qid, n and token of each sentence token that no lookup stage finds; sentences (qid, sentence)."""
    tokens = sentences.select("qid", F.posexplode(text.sentence_tokens("sentence")).alias("n", "token"))
    distinct = tokens.select(F.col("token").alias("qid"), F.col("token").alias("word"), F.lit(True).alias("fuzzy")).distinct()
    found = lookup(distinct, lemmas, forms).select(F.col("qid").alias("token")).distinct()
    return tokens.join(found, "token", "left_anti").select("qid", "n", "token")


def validate(sentences: DataFrame, lemmas: DataFrame, forms: DataFrame, fallback: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """qid, valid and issues (tokens in order); fallback takes (token) rows that no lookup finds and gives those that a search vouches for."""
    missing = unknown_tokens(sentences, lemmas, forms)
    if fallback is not None:
        # written, as the search and what is left after it read them
        missing = written(missing, "unknown-tokens")
        missing = missing.join(fallback(missing.select("token").distinct()).select("token").distinct(), "token", "left_anti")
    issues = missing.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "token"))), lambda x: x["token"]).alias("issues"))
    none = F.array().cast("array<string>")
    return sentences.select("qid").join(issues, "qid", "left").select("qid", F.col("issues").isNull().alias("valid"), F.coalesce("issues", none).alias("issues"))


def expected_recall(expected: DataFrame, results: DataFrame) -> DataFrame:
    """category, found, expected and recall: an expected term is found if a result's word contains it, whatever the case.

    expected (category, terms array), results (category, word).
    """
    terms = expected.select("category", F.explode("terms").alias("term"))
    words = results.select(F.col("category").alias("c"), F.lower("word").alias("w")).distinct()
    hit = terms.join(words, (F.col("category") == F.col("c")) & F.contains(F.col("w"), F.lower("term")), "left_semi").withColumn("hit", F.lit(1))
    joined = terms.join(hit, ["category", "term"], "left")
    return joined.groupBy("category").agg(F.count("hit").alias("found"), F.count(F.lit(1)).alias("expected"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))


def mean_recall(recalls: DataFrame) -> DataFrame:
    return recalls.agg(F.avg("recall").alias("mean_recall"))
