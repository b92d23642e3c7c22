"""Word lookup: exact lemma, inflected form, folded lemma, folded form, then fuzzy; the first stage that finds anything decides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..sources.scratch import written
from .index import segment_index

FUZZY_DISTANCE = 2
FUZZY_HITS = 5
STAGES = {1: "lemma", 2: "form", 3: "folded lemma", 4: "folded form", 5: "fuzzy"}


def stage_exact(words: DataFrame, lemmas: DataFrame) -> DataFrame:
    return words.join(lemmas, F.col("key") == F.col("lemma")).select("qid", "key", F.lit(1).alias("stage"), "lemma", "pos", F.col("lemma").alias("matched_form"), F.lit(0.0).alias("score"), F.col("first_pos").alias("rank_pos"))


def stage_form(words: DataFrame, forms: DataFrame, lemmas: DataFrame) -> DataFrame:
    hit = words.join(forms.select("form", F.col("lemma").alias("form_lemma")), F.col("key") == F.col("form"))
    return hit.join(lemmas, F.col("form_lemma") == F.col("lemma")).select("qid", "key", F.lit(2).alias("stage"), "lemma", "pos", F.col("form").alias("matched_form"), F.lit(0.0).alias("score"), F.col("first_pos").alias("rank_pos"))


def stage_folded_lemma(words: DataFrame, lemmas: DataFrame) -> DataFrame:
    return words.join(lemmas, F.col("norm") == F.col("lemma_norm")).select("qid", "key", F.lit(3).alias("stage"), "lemma", "pos", F.col("lemma").alias("matched_form"), F.lit(0.0).alias("score"), F.col("first_pos").alias("rank_pos"))


def stage_folded_form(words: DataFrame, forms: DataFrame, lemmas: DataFrame) -> DataFrame:
    hit = words.join(forms.select("form", "form_norm", "form_pos", F.col("lemma").alias("form_lemma")), F.col("norm") == F.col("form_norm"))
    found = hit.join(lemmas, F.col("form_lemma") == F.col("lemma"))
    # forms of one lemma count once, the first of them
    once = found.groupBy("qid", "key", "lemma", "pos").agg(F.min_by("form", F.struct("form_pos", "form")).alias("matched_form"), F.min("form_pos").alias("rank_pos"))
    return once.select("qid", "key", F.lit(4).alias("stage"), "lemma", "pos", "matched_form", F.lit(0.0).alias("score"), "rank_pos")


def stage_fuzzy(words: DataFrame, lemmas: DataFrame, hits: int = FUZZY_HITS) -> DataFrame:
    """Lemmas within the edit distance by shared segments, so no word meets all lemmas; the best few by score."""
    keyed = words.select("qid", "key", "norm", F.explode(text.segment_keys(F.col("norm"))).alias("segment"))
    met = keyed.join(segment_index(lemmas), "segment").withColumn("distance", F.levenshtein("norm", "lemma_norm", FUZZY_DISTANCE)).where("distance >= 0")
    near = met.select("qid", "key", "norm", "lemma", "lemma_norm", "pos", "first_pos", "distance").distinct()
    scored = near.withColumn("score", text.fuzzy_score(F.col("norm"), F.col("lemma_norm"), F.col("distance")))
    order = W.partitionBy("qid").orderBy(F.desc("score"), "distance", "first_pos", "lemma")
    best = scored.withColumn("n", F.row_number().over(order)).where(F.col("n") <= hits)
    return best.select("qid", "key", F.lit(5).alias("stage"), "lemma", "pos", F.col("lemma").alias("matched_form"), "score", F.col("n").cast("bigint").alias("rank_pos"))


def lookup(words: DataFrame, lemmas: DataFrame, forms: DataFrame) -> DataFrame:
    """Hits of a batch of words (qid, word, fuzzy): qid, stage, rank, lemma, pos, matched_form and score.

    The four equi-join stages run side by side, once, and each word keeps its first; only words that none of
    them finds go to the fuzzy stage.
    """
    asked = words.select("qid", text.normal("word").alias("key"), F.coalesce("fuzzy", F.lit(True)).alias("fuzzy")).withColumn("norm", text.fold("key"))
    equal = stage_exact(asked, lemmas).unionByName(stage_form(asked, forms, lemmas)).unionByName(stage_folded_lemma(asked, lemmas)).unionByName(stage_folded_form(asked, forms, lemmas))
    # written, as both what follows and the words that are left read it
    first = written(equal.withColumn("first", F.min("stage").over(W.partitionBy("qid"))).where("stage = first").drop("first"), "equal-hits")
    rest = asked.where("fuzzy").join(first.select("qid"), "qid", "left_anti")
    out = first.unionByName(stage_fuzzy(rest, lemmas))
    rank = F.row_number().over(W.partitionBy("qid").orderBy("rank_pos", "lemma"))
    return out.withColumn("rank", rank).select("qid", "stage", "rank", "lemma", "pos", "matched_form", "score")


def described(hits: DataFrame, entries: DataFrame) -> DataFrame:
    """Hits with word, de, en and, where there is one, gender; matched_form only where it differs from the word."""
    full = hits.join(entries.select("pos", "word", "gender", "translations", "forms_json"), "pos")
    differs = F.col("matched_form") != F.lower("word")
    return full.select(
        "qid", "rank", "stage", "pos", "word", text.first_translation("translations", "miks").alias("de"), text.first_translation("translations", "engl").alias("en"),
        F.when(F.length("gender") > 0, F.col("gender")).alias("gender"), F.when(differs, F.col("matched_form")).alias("matched_form"), "forms_json",
    )
