"""Derived index tables: lemmas, inflected forms, folded keys and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

MOODS = ("indicative", "subjunctive", "optative", "imperative")


def form_list(forms: str = "forms"):
    """Distinct lower-cased forms of an entry: cases, moods (nested forms where there are any, else their own) and other forms."""
    none = F.array().cast("array<string>")
    c = lambda path: F.col(f"{forms}.{path}")
    parts = [F.flatten(F.transform(F.flatten(F.transform(c("declension"), lambda d: F.coalesce(d["cases"], F.array().cast("array<struct<singular:string,plural:string>>")))), lambda k: F.array(k["singular"], k["plural"])))]
    for mood in MOODS:
        parts.append(F.flatten(F.transform(c(mood), lambda i: F.when(i["forms"].isNotNull(), F.transform(i["forms"], lambda f: f["form"])).otherwise(F.array(i["form"])))))
    parts += [F.transform(c(x), lambda i: i["form"]) for x in ("participles", "infinitives")]
    whole = F.concat(*[F.coalesce(p, none) for p in parts])
    return F.array_distinct(F.transform(F.filter(whole, lambda f: F.length(f) > 0), F.lower))


def lemma_index(entries: DataFrame) -> DataFrame:
    """lemma, lemma_norm, pos of the entry that holds it (the last of equal lemmas) and first_pos (of the first, for order)."""
    keyed = entries.where(F.length("word") > 0).select(F.lower("word").alias("lemma"), "pos")
    return keyed.groupBy("lemma").agg(F.max("pos").alias("pos"), F.min("pos").alias("first_pos")).withColumn("lemma_norm", text.fold("lemma"))


def form_index(forms: DataFrame) -> DataFrame:
    """form, form_norm and the lemma that it belongs to (of the first entry), from rows (pos, word, form)."""
    keyed = forms.where((F.length("form") > 0) & F.col("word").isNotNull()).select(F.lower("form").alias("form"), F.lower("word").alias("lemma"), "pos")
    return keyed.groupBy("form").agg(F.min_by("lemma", F.struct("pos", "lemma")).alias("lemma"), F.min("pos").alias("form_pos")).withColumn("form_norm", text.fold("form"))


def exploded_forms(entries: DataFrame) -> DataFrame:
    """pos, word and form, one row per form."""
    return entries.select("pos", "word", F.explode(form_list()).alias("form"))


def segment_index(lemmas: DataFrame) -> DataFrame:
    """Three rows per lemma, by the segments of its folded form: what equi-joins words within edit distance 2."""
    return lemmas.select("lemma", "lemma_norm", "pos", "first_pos", F.explode(text.segments(F.col("lemma_norm"))).alias("segment"))
