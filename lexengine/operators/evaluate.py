"""Retrieval evaluation: embedding search, two-stage search and rerank of the whole corpus, by expected terms."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.scratch import written
from . import rerank
from .validate import expected_recall

if TYPE_CHECKING:
    from ..engine import Engine

TOP = 20
EVALUATION_BATCH = 50
MAX_QUESTIONS = 10_000


def corpus_top(entries: DataFrame, queries: DataFrame, model: Callable, k: int = TOP, batch: int = EVALUATION_BATCH) -> DataFrame:
    """The k best entries with a translation for each query (category, query), by weighted relevance over the whole corpus."""
    first = lambda x: text.first_translation("translations", x)
    kind = text.word_type("desc")
    some = (F.size(F.coalesce(F.try_element_at("translations", F.lit("miks")), F.array().cast("array<string>"))) > 0) | (F.size(F.coalesce(F.try_element_at("translations", F.lit("engl")), F.array().cast("array<string>"))) > 0)
    rows = entries.where(some).select("pos", "word", kind.alias("word_type"), text.evaluation_line(F.col("word"), kind, first("miks"), first("engl"), first("leit"), first("latt")).alias("doc"))
    asked = queries.select(F.xxhash64("category").alias("qid"), "category", "query")
    # every question is put to every batch of the corpus
    if asked.count() > MAX_QUESTIONS:
        raise ValueError(f"more than {MAX_QUESTIONS} questions; evaluate blocks of them")
    cells = rows.withColumn("batch", F.floor(F.col("pos") / batch)).withColumn("index", F.col("pos") % batch).withColumn("rank", F.col("pos").cast("bigint")).crossJoin(F.broadcast(asked))
    scores = rerank.score_batches(cells.select("qid", "query", "rank", "batch", "index", "doc"), model, "drop")
    candidates = cells.select("qid", "category", "rank", "pos", "word", "word_type")
    best = rerank.reranked(candidates, scores, k, rerank.type_weight(F.col("word_type")))
    return best.where("rerank_score IS NOT NULL").select("category", F.col("new_rank").alias("rank"), "word", "rerank_score")


def evaluate(engine: Engine, questions: DataFrame, k: int = TOP) -> DataFrame:
    """method, category, found, expected, recall and the method's seconds; questions (category, query, terms)."""
    asked = questions.select(F.xxhash64("category").alias("qid"), "category", "query")
    methods = {
        "embedding": lambda: engine.search_dictionary(asked.select("qid", "query"), k).join(asked.select("qid", "category"), "qid"),
        "two stages": lambda: engine.search_dictionary(asked.select("qid", "query"), k, use_reranker=True).join(asked.select("qid", "category"), "qid"),
        "corpus": lambda: corpus_top(engine.entries, asked, engine.reranker, k),
    }
    out = None
    for name, run in methods.items():
        began = time.monotonic()
        hits = written(run().select("category", "word"), "hits")
        part = expected_recall(questions.select("category", "terms"), hits).select(F.lit(name).alias("method"), "*", F.lit(time.monotonic() - began).alias("seconds"))
        out = part if out is None else out.unionByName(part)
    return out
