"""Inflection tables: paths of a form within an entry's document, and the full record of a lemma."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions import text
from .lookup import described, lookup

_FOLD = str.maketrans(text.MACRONS, text.PLAIN_VOWELS)


def string_paths(document: str | None, target: str | None) -> list[str]:
    """Paths of all strings in a JSON document that equal the target, lower-cased or folded, in document order."""
    if not document or target is None:
        return []
    try:
        tree = json.loads(document)
    except ValueError:
        return []
    low = target.lower()
    folded = low.translate(_FOLD)
    out: list[str] = []
    todo: list[tuple[str, object]] = [("", tree)]
    while todo:
        path, node = todo.pop()
        if isinstance(node, str):
            own = node.lower()
            if own == low or own.translate(_FOLD) == folded:
                out.append(path)
        elif isinstance(node, (dict, list)):
            parts = node.items() if isinstance(node, dict) else enumerate(node)
            todo += reversed([(f"{path}/{k}" if path else str(k), v) for k, v in parts])
    return out


class JsonStringPaths:
    """The rows of json_string_paths(document, target)."""

    def eval(self, document: str, target: str) -> Iterator[tuple[str, int]]:
        for n, path in enumerate(string_paths(document, target)):
            yield path, n


def register(spark: SparkSession) -> None:
    """SQL: SELECT * FROM t, LATERAL json_string_paths(document, target)."""
    spark.udtf.register("json_string_paths", udtf(JsonStringPaths, returnType="path string, n int"))


def _paths(document: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([string_paths(d, t) for d, t in zip(document, target)], dtype=object)


def json_paths(document: str, target: str) -> Column:
    """Paths of the target's strings, as an array."""
    return F.pandas_udf(_paths, "array<string>")(document, target)


_WALK = """WITH RECURSIVE walk(id, low, path, v) AS (
  SELECT id, lower(target), CAST('' AS STRING), try_parse_json(document) FROM {rows} WHERE target IS NOT NULL
  UNION ALL
  SELECT w.id, w.low, concat(CASE WHEN w.path = '' THEN '' ELSE concat(w.path, '/') END, coalesce(e.key, CAST(e.pos AS STRING))), e.value
  FROM walk w, LATERAL variant_explode(w.v) AS e)
SELECT id, path, low, lower(CAST(v AS STRING)) AS own FROM walk WHERE schema_of_variant(v) = 'STRING'"""


def walked_paths(rows: DataFrame) -> DataFrame:
    """id and path of all strings in JSON documents that equal the target, lower-cased or folded; rows (id, document, target).

    A recursive query over variants, all of it in the JVM: each level of all documents is one step.  Rows and paths are those of
    ``string_paths``, in no order.  The session's bounds on recursion, of rows and of levels, are lifted for it.
    """
    conf = rows.sparkSession.conf
    conf.set("spark.sql.cteRecursionRowLimit", "-1")
    conf.set("spark.sql.cteRecursionLevelLimit", "-1")
    found = rows.sparkSession.sql(_WALK, rows=rows.select("id", "document", "target"))
    return found.where((F.col("own") == F.col("low")) | (text.fold("own") == text.fold("low"))).select("id", "path")


def with_paths(hits: DataFrame) -> DataFrame:
    """Described hits with matched_paths; where no path matches, matched_form goes too."""
    found = hits.withColumn("matched_paths", F.when(F.col("matched_form").isNotNull(), json_paths("forms_json", "matched_form")))
    any_path = F.size(F.coalesce("matched_paths", F.array().cast("array<string>"))) > 0
    return found.withColumn("matched_form", F.when(any_path, F.col("matched_form"))).withColumn("matched_paths", F.when(any_path, F.col("matched_paths"))).drop("forms_json")


def word_forms(words: DataFrame, entries: DataFrame, lemmas: DataFrame, forms: DataFrame, compat: bool = False) -> DataFrame:
    """The record of each lemma's first hit: lemma, translations, paradigm, gender, forms; or an error.

    compat gives empty paradigm and forms.
    """
    first = lookup(words.select("qid", "word", F.lit(True).alias("fuzzy")), lemmas, forms).where("rank = 1")
    hit = described(first, entries).select("qid", F.col("pos"), F.col("word").alias("lemma"), "de", "en", "gender")
    more = entries.select("pos", F.lit("").alias("paradigm") if compat else F.coalesce("paradigm", F.lit("")).alias("paradigm"), F.lit("{}").alias("forms") if compat else F.coalesce("forms_json", F.lit("{}")).alias("forms"))
    full = hit.join(more, "pos").drop("pos")
    return words.select("qid", F.col("word").alias("asked")).join(full, "qid", "left").select(
        "qid", "lemma", F.struct("de", "en").alias("translations"), "paradigm", "gender", "forms",
        F.when(F.col("lemma").isNull(), F.concat(F.lit("Word not found: "), "asked")).alias("error"),
    )
