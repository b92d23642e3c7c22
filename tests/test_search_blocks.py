"""Searches with more query vectors than are broadcast at once."""

import pytest

from lexengine.operators import search
from lexengine.plans import catalogue

from oracle import compare, connect


@pytest.mark.parametrize("name", ["vec_topk_cosine", "vec_topk_expressions", "vec_topk_postfilter", "two_stage_rerank", "weighted_rerank", "eval_label_recall"])
def test_blocks_of_queries_give_the_same_rows(spark, sf, monkeypatch, name):
    # a block is far smaller than the set of queries, and does not divide it
    monkeypatch.setattr(search, "MAX_QUERIES", 3)
    compare(spark, connect(sf), sf, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])


def test_no_queries_give_no_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0])], "pos bigint, embedding array<float>")
    none = spark.createDataFrame([], "qid bigint, vector array<float>")
    assert search.top_k(none, rows, 3).count() == 0


@pytest.mark.parametrize("most", [256, 2])
def test_expressions_rank_few_of_the_pairs(spark, sf, monkeypatch, most):
    # all pairs once were sorted to be ranked
    monkeypatch.setattr(search, "UNROLLED", most)
    ranked, rank = [], search._ranked
    monkeypatch.setattr(search, "_ranked", lambda scored, k: (ranked.append(scored), rank(scored, k))[1])
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("vec_id AS pos", "embedding")
    queries = rows.where("pos % 20 = 0").selectExpr("pos AS qid", "embedding AS vector")
    got = search.top_k_expressions(queries, rows, 2, 6).collect()
    assert ranked[0].count() < 0.5 * queries.count() * rows.count()
    assert sorted((r.qid, r["rank"], r.pos, r.score) for r in got) == sorted((r.qid, r["rank"], r.pos, r.score) for r in search.top_k(queries, rows, 2, 6).collect())


def test_expressions_put_rows_without_a_score_last(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0, None]), (4, [1.0]), (5, [0.0, 0.0]), (6, [2.0, 0.0])], "pos bigint, embedding array<float>")
    queries = spark.createDataFrame([(1, [3.0, 0.0]), (2, [0.0, 0.0])], "qid bigint, vector array<float>")
    got = {(r.qid, r["rank"]): (r.pos, r.score) for r in search.top_k_expressions(queries, rows, 5, 6).collect()}
    assert [got[1, i] for i in range(1, 6)] == [(6, 1.0), (1, 1.0), (5, 0.0), (4, None), (3, None)]
    assert [got[2, i] for i in range(1, 4)] == [(6, 0.0), (5, 0.0), (1, 0.0)]
