"""Second-stage reranking: candidates are scored in fixed-size batches by an injected model, summed, weighted and cut."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..sources.connectors import FAILURES

BATCH = 32
#: Weights by word type.
WORD_TYPE_WEIGHTS = {"pn": 5.0, "prp": 4.5, "crd": 4.0, "ord": 4.0, "av": 3.5, "aj": 3.0, "nom": 3.0, "n": 3.0, "subst": 3.0, "pc": 2.5, "ij": 0.1}

Rerank = Callable[[str, list[str]], list[tuple[int, float]]]


def batched(rows: DataFrame, size: int = BATCH, rank: str = "rank") -> DataFrame:
    """Adds batch and its place in the batch from a rank that starts at 1."""
    return rows.withColumn("batch", F.floor((F.col(rank) - 1) / size).cast("bigint")).withColumn("index", ((F.col(rank) - 1) % size).cast("bigint"))


def type_weight(word_type: Column) -> Column:
    weights = F.create_map(*[F.lit(x) for pair in WORD_TYPE_WEIGHTS.items() for x in pair])
    return F.coalesce(F.try_element_at(weights, word_type), F.lit(1.0))


def score_batches(candidates: DataFrame, rerank: Rerank, on_error: str = "fallback") -> DataFrame:
    """qid, rank, relevance of candidates (qid, query, rank, batch, index, doc); a batch is one call of the model.

    on_error: "fallback" keeps a failed batch without scores, "drop" leaves it out, "raise" fails.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("index")
        try:
            scores = rerank(pdf["query"].iloc[0], pdf["doc"].tolist())
        except FAILURES:
            if on_error == "raise":
                raise
            return pd.DataFrame({"qid": pdf["qid"], "rank": pdf["rank"], "relevance": None}) if on_error == "fallback" else pd.DataFrame({"qid": [], "rank": [], "relevance": []})
        qid, ranks = pdf["qid"].iloc[0], pdf["rank"].tolist()
        return pd.DataFrame([(qid, ranks[i], float(s)) for i, s in scores if 0 <= i < len(ranks)], columns=["qid", "rank", "relevance"])

    return candidates.groupBy("qid", "batch").applyInPandas(run, "qid bigint, rank bigint, relevance double")


def summed(scores: DataFrame) -> DataFrame:
    """Scores of one candidate add up."""
    return scores.groupBy("qid", "rank").agg(F.sum("relevance").alias("relevance"))


def reranked(candidates: DataFrame, scores: DataFrame, k: int, weight: Column | None = None) -> DataFrame:
    """The k best candidates by summed score, times weight; ties and candidates without score keep their order."""
    total = summed(scores)
    value = F.col("relevance") * weight if weight is not None else F.col("relevance")
    joined = candidates.join(total, ["qid", "rank"]).withColumn("rerank_score", value)
    order = W.partitionBy("qid").orderBy(F.desc_nulls_last("rerank_score"), "rank")
    return joined.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= k)


def two_stage(hits: DataFrame, entries: DataFrame, queries: DataFrame, rerank: Rerank, k: int = 10, candidates: int = 100, batch: int = BATCH, on_error: str = "fallback") -> DataFrame:
    """Search hits (qid, rank, pos, word, de, en, score) of up to ``candidates`` rows, reranked; 0 candidates means no reranking."""
    if candidates == 0:
        return hits.where(F.col("rank") <= k).withColumn("rerank_score", F.lit(None).cast("double")).withColumn("word_type", F.lit(None).cast("string"))
    docs = hits.where(F.col("rank") <= candidates).join(entries.select("pos", "desc", text.multilang("translations").alias("doc")), "pos")
    docs = batched(docs.join(queries.select("qid", "query"), "qid"), batch)
    best = reranked(docs, score_batches(docs, rerank, on_error), k)
    return best.select("qid", F.col("new_rank").alias("rank"), "pos", "word", "de", "en", "score", "rerank_score", text.word_type("desc").alias("word_type"))


def rerank_corpus(entries: DataFrame, query: str, rerank: Rerank, batch: int = BATCH, on_error: str = "drop") -> DataFrame:
    """All entries with a German or English translation, scored against one query and weighted by word type, best first."""
    has = lambda x: F.size(F.coalesce(F.try_element_at("translations", F.lit(x)), F.array().cast("array<string>"))) > 0
    kind = text.word_type("desc")
    line = text.entry_line(F.col("word"), kind, F.col("gender"), text.first_translation("translations", "miks"), text.first_translation("translations", "engl"))
    rows = entries.where(has("miks") | has("engl")).withColumn("word_type", kind).withColumn("doc", line)
    # batches by position, so no global numbering is needed; a batch holds at most ``batch`` entries
    cells = rows.withColumn("qid", F.lit(0).cast("bigint")).withColumn("query", F.lit(query)).withColumn("batch", F.floor(F.col("pos") / batch)).withColumn("index", F.col("pos") % batch).withColumn("rank", F.col("pos").cast("bigint"))
    scores = summed(score_batches(cells.select("qid", "query", "rank", "batch", "index", "doc"), rerank, on_error))
    joined = cells.join(scores, ["qid", "rank"]).withColumn("rerank_score", F.col("relevance") * type_weight(F.col("word_type")))
    return joined.drop("qid", "query", "batch", "index", "rank", "relevance", "doc").orderBy(F.desc_nulls_last("rerank_score"), "pos")
