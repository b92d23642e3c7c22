"""The pipeline, stage by stage, against brute force on each stage's own input."""

import os

import corpus_pipeline
import pytest

from lexengine.llm import decontamination, mixing, pii, quality_rules
from lexengine.llm.common import clear_scratch, materialise, scratch_dir, table

from test_operators import brute_components, brute_counts, brute_pii, brute_tiles, check_training_rows, odd_docs


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    out = tmp_path_factory.mktemp("stages")
    docs = table(spark, sf, "documents")
    steps = [docs.collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{out}/{k}")
        docs = spark.read.parquet(f"{out}/{k}")
        steps.append(docs.collect())
    return steps


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "pii", "mixing"] and corpus_pipeline.ORACLE_SQL is None


def test_columns(steps):
    for rows in steps[:5]:
        assert list(rows[0].asDict()) == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality(spark, sf, steps):
    kept = {r.doc_id for r in quality_rules.judge(table(spark, sf, "documents")).collect() if r.kept}
    assert {r.doc_id for r in steps[1]} == kept and not any(brute_counts(r.text)[5] for r in steps[1])


def test_dedup(steps):
    want = brute_components([(r.doc_id, r.text) for r in steps[1]])
    assert {r.doc_id for r in steps[2]} == {i for i, c in want.items() if i == c}


def test_decontamination(spark, sf, steps):
    items = [decontamination.tokens(r.text) for r in table(spark, sf, "benchmark").collect()]
    index = decontamination.Index([(i, " ".join(t)) for i, t in enumerate(items)])
    kept = {r.doc_id for r in steps[3]}
    for r in steps[2]:
        # brute force on the items that share a token window with the document
        words = decontamination.tokens(r.text)
        windows = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        held = any(sum(n for n, _, _ in brute_tiles(words, t, 5)) >= 0.5 * len(t) for t in items if windows & {tuple(t[i : i + 5]) for i in range(len(t) - 4)})
        assert (r.doc_id in kept) == (not held)
    assert index.items


def brute_redaction(text):
    """The text with base spans and those that the trees add replaced, overlapping runs by their first kind."""
    data = text.encode()
    _, spans = pii.spans_of(data, pii.model())
    base = {(s, e) for s, k, e in spans if k < 4}
    at = [len(text[:i].encode()) for i in range(len(text) + 1)]
    assert base == {(at[s], at[e]) for s, _, e in brute_pii(text)}
    owner = [None] * (len(data) + 1)
    for n, (s, k, e) in enumerate(spans):
        run = n if owner[s] is None else owner[s]
        for i in range(s, e):
            owner[i] = run
    out, i = b"", 0
    while i < len(data):
        if owner[i] is None:
            out += data[i : i + 1]
        elif i == 0 or owner[i - 1] != owner[i]:
            out += f"[{pii.KINDS[spans[owner[i]][1]].upper()}]".encode()
        i += 1
    return out.decode()


def test_private(steps):
    before = {r.doc_id: r.text for r in steps[3]}
    for r in steps[4]:
        assert r.text == brute_redaction(before[r.doc_id]) and r.n_chars == len(r.text)
    assert {r.doc_id for r in steps[4]} == set(before)


def test_mixing(spark, steps, tmp_path):
    assert {r.doc_id for r in steps[5]} == {r.doc_id for r in steps[4]}
    by = {}
    for r in steps[5]:
        by.setdefault(r.source, []).append(r)
    for rows in by.values():
        assert sum(r.taken for r in rows) == pytest.approx(rows[0].target, abs=1.01)
    docs = spark.createDataFrame(steps[4], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    check_training_rows(steps[4], steps[5], mixing.curriculum(docs).collect())


def test_run_gives_the_last_stage_in_training_order(spark, sf, steps):
    out = corpus_pipeline.run(spark, sf)
    assert sorted(out.collect(), key=str) == sorted(steps[5], key=str)
    # files in order of their numbers hold the rows in order
    places = [2.0 if r.position is None else r.position for r in out.orderBy("_metadata.file_path", "_metadata.row_index").collect()]
    assert places == sorted(places)


def test_run_leaves_only_its_result(spark, sf):
    folder = f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}".removeprefix("file://")
    clear_scratch(spark)
    corpus_pipeline.run(spark, sf)
    (left,) = os.listdir(folder)
    assert os.listdir(f"{folder}/{left}") == ["4-mixing"]


def test_stages_on_odd_rows_and_empty_tables(spark, sf):
    odd = odd_docs(spark)
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for docs in (odd, plain, plain.limit(0)):
        want = docs.columns
        for name, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, docs, sf)
            assert out.columns == want
            docs = materialise(out, name)
        mixed = corpus_pipeline.STAGES[4][1](spark, docs, sf)
        assert set(want) - set(mixing.ADDED) <= set(mixed.columns) and mixed.count() >= docs.count()
    # what passes the rules comes through, with a null id, equal rows and equal ids as each stage says
    kept = materialise(corpus_pipeline.quality(spark, plain, sf), "kept").collect()
    assert {r.doc_id for r in kept} >= {None, 9} and not {1, 2, 3, 4, 5} & {r.doc_id for r in kept}


def test_scopes_of_threads_are_apart(spark):
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    from lexengine.llm.common import materialise, scratch_scope

    both = Barrier(2, timeout=60)

    def work(n):
        with scratch_scope(spark):
            mine = materialise(spark.range(n), "apart")
            both.wait()
            if n == 3:
                return mine.count()
        # by now this thread's own scope is gone, and the other's may still be read
        return n

    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(work, (3, 4))) == [3, 4]
