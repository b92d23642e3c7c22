"""Semantic top-k search over embeddings, for batches of query vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text, vector
from ..sources.scratch import written

#: Query vectors that are broadcast at once; larger batches go block by block.
MAX_QUERIES = 4_096
#: Queries whose scores for a batch of rows a task holds at once.
SCORED = 256
#: Entries of vectors that are made columns; longer ones stay arrays.
UNROLLED = 256
#: One row in so many is looked at first, for a bound on the scores to rank.
LOOK = 16


def _ranked(scored: DataFrame, k: Column | int) -> DataFrame:
    # at equal scores the later row comes first
    order = W.partitionBy("qid").orderBy(F.desc("score"), F.desc("pos"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(queries: DataFrame) -> Iterator[list]:
    """The queries in blocks of at most ``MAX_QUERIES``, one in the driver at a time."""
    left = queries.select("qid", "vector").toLocalIterator()
    while block := list(islice(left, MAX_QUERIES)):
        yield block


def top_k(queries: DataFrame, rows: DataFrame, k: int, decimals: int | None = None) -> DataFrame:
    """qid, pos, score and rank of each query's k nearest rows; queries (qid, vector), rows (pos, embedding).

    Each batch of rows is scored against all queries by one matrix product and keeps its k best, so what
    is shuffled is k rows per query and batch, whatever the number of rows.  Each block of ``MAX_QUERIES``
    queries reads the rows once.
    """
    near = [_near(block, rows, k, decimals) for block in _blocks(queries)] or [_near([], rows, k, decimals)]
    return _ranked(reduce(DataFrame.unionByName, near), k)


def _best(scores: np.ndarray, pos: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, of equal ones the later rows; only what reaches the k-th score is sorted."""
    some = np.arange(len(scores)) if k >= len(scores) else np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    return some[np.lexsort((-pos[some], -scores[some]))[:k]]


def _near(lot: list, rows: DataFrame, k: int, decimals: int | None) -> DataFrame:
    """qid, pos and score of the k nearest rows of each batch of rows, for one block of queries."""
    ids = np.array([q.qid for q in lot], np.int64)
    matrix = np.array([q.vector for q in lot], float).reshape(len(lot), -1) if lot else np.empty((0, 0))
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    matrix = matrix / np.where(length > vector.LEAST_NORM, length, 1.0)
    held = rows.sparkSession.sparkContext.broadcast((ids, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = held.value
        for batch in batches:
            if not batch.num_rows or not len(qids):
                continue
            column = batch.column("embedding")
            pos = batch.column("pos").to_numpy(zero_copy_only=False)
            e = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            e = (e / np.maximum(np.linalg.norm(e, axis=1, keepdims=True), vector.LEAST_NORM)).T
            keep = min(k, batch.num_rows)
            for at in range(0, len(qids), SCORED):
                scores = q[at : at + SCORED] @ e
                if decimals is not None:
                    scores = np.round(scores, decimals)
                best = np.stack([_best(s, pos, keep) for s in scores])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids[at : at + SCORED], keep)), pa.array(pos[best].ravel()), pa.array(np.take_along_axis(scores, best, 1).ravel())], names=["qid", "pos", "score"])

    return rows.where("embedding IS NOT NULL").select(F.col("pos").cast("bigint").alias("pos"), "embedding").mapInArrow(run, "qid bigint, pos bigint, score double")


def _flat(rows: DataFrame, name: str, prefix: str, dimension: int) -> DataFrame:
    """The rows with a vector's length in entries and its norm (null if entries are missing), and its entries as columns, or as doubles if they are many."""
    v = F.transform(name, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    # with a gap in it a vector has no score
    whole = F.when(~F.exists(name, lambda x: x.isNull()), vector.norm(F.col(name)))
    entries = [F.coalesce(F.get(v, i), F.lit(0.0)).alias(f"{prefix}{i}") for i in range(dimension)] if dimension <= UNROLLED else [v.alias(prefix)]
    return rows.select(*[c for c in rows.columns if c != name], F.size(name).alias(f"{prefix}_size"), whole.alias(f"{prefix}_norm"), *entries)


def top_k_expressions(queries: DataFrame, rows: DataFrame, k: int, decimals: int | None = None) -> DataFrame:
    """The same by Column functions only.

    Spark compiles sums over columns, while it interprets functions over arrays, so vectors become columns, and norms are taken once per
    vector.  A first look at one row in ``LOOK`` tells for each query a score that k rows reach; of all pairs only those that reach it are
    ranked, so that pairs are neither sorted nor shuffled.
    """
    spark = rows.sparkSession
    dimension = queries.agg(F.max(F.size("vector")).alias("n")).first().n or 0
    few = len(queries.select("qid").limit(MAX_QUERIES + 1).collect()) <= MAX_QUERIES
    # columns of vectors are made before the join, not in it, and dealt to all cores however few files there are
    cores = spark.sparkContext.defaultParallelism
    asked = _flat(queries.select("qid", "vector"), "vector", "q", dimension).repartition(cores, "qid")
    held = _flat(rows.select("pos", "embedding"), "embedding", "e", dimension).repartition(4 * cores, "pos")
    if dimension <= UNROLLED:
        dot = reduce(lambda total, i: total + F.col(f"q{i}") * F.col(f"e{i}"), range(dimension), F.lit(0.0))
    else:
        dot = vector.dot(F.col("q"), F.col("e"))
    score = F.when(F.col("q_size") == F.col("e_size"), dot / (F.when(F.col("q_norm") > vector.LEAST_NORM, F.col("q_norm")).when(F.col("q_norm").isNotNull(), F.lit(1.0)) * F.when(F.col("e_norm").isNotNull(), F.greatest("e_norm", F.lit(vector.LEAST_NORM)))))

    def pairs(some: DataFrame, of: DataFrame) -> DataFrame:
        return some.crossJoin(F.broadcast(of) if few else of)

    # each group's best is another row, so k rows reach the k-th best of them
    at = F.xxhash64("pos")
    groups = pairs(held.where(F.pmod(at, F.lit(LOOK)) == 0), asked).select("qid", F.pmod(F.shiftright(at, 32), F.lit(4 * k)).alias("g"), score.alias("score"))
    best = groups.groupBy("qid", "g").agg(F.max("score").alias("score")).groupBy("qid").agg(F.get(F.sort_array(F.collect_list("score"), asc=False), k - 1).alias("reached"))
    least = F.col("reached") - (10.0**-decimals if decimals is not None else 0.0)
    asked = asked.join(written(best.select("qid", least.alias("least")), "reached"), "qid", "left")
    near = pairs(held, asked).withColumn("score", score).where(F.col("least").isNull() | (F.col("score") >= F.col("least")))
    return _ranked(near.select("qid", "pos", (F.round("score", decimals) if decimals is not None else F.col("score")).alias("score")), k)


def search(queries: DataFrame, rows: DataFrame, entries: DataFrame, k: int = 10, keep: Column | None = None, decimals: int | None = None) -> DataFrame:
    """Hits of each query: twice k nearest rows, then those that have translations, then k.

    The filter stands after the first cut on purpose, so a query can have fewer than k hits.
    """
    keep = F.size(F.coalesce("translations", F.create_map().cast("map<string,array<string>>"))) > 0 if keep is None else keep
    near = top_k(queries, rows, 2 * k, decimals).drop("rank")
    hits = near.join(entries, "pos").where(keep)
    ranked = _ranked(hits, k)
    return ranked.select("qid", "rank", "pos", "word", text.first_translation("translations", "miks").alias("de"), text.first_translation("translations", "engl").alias("en"), "score")


