import pytest

from lexengine.plans import catalogue
from lexengine.plans import lexicon as L


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


PURE = "vec_norm_clip fold_macrons word_type entry_formats html_clean html_items ingest_status prefix_cross tool_parse_xml tool_parse_json response_split result_lines history_concat content_words sse_parse lookup_exact lookup_fuzzy lookup_cascade validate_sentence".split()


@pytest.mark.parametrize("name", PURE)
def test_expressions_stay_in_the_jvm(spark, sf, name):
    p = plan(catalogue.QUERIES[name](spark, sf))
    assert not any(x in p for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("name", ["lookup_exact", "lookup_form", "lookup_fuzzy", "lookup_cascade", "validate_sentence", "ingest_antijoin"])
def test_joins_are_equi_joins(spark, sf, name):
    p = plan(catalogue.QUERIES[name](spark, sf))
    assert "CartesianProduct" not in p and "NestedLoopJoin" not in p


def test_scans_read_only_what_they_need(spark, sf):
    p = plan(catalogue.QUERIES["ingest_union_dedupe"](spark, sf))
    assert "text" not in p
    p = plan(L.table(spark, sf, "documents").where("lang = 'en'").select("doc_id"))
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in p


def test_search_keeps_k_rows_per_batch(spark, sf):
    p = plan(catalogue.QUERIES["vec_topk_cosine"](spark, sf))
    # one exchange, of the candidates alone
    assert p.count("Exchange hashpartitioning") == 1 and "MapInArrow" in p


def test_throttle_sorts_once_and_holds_no_history(spark, sf):
    p = plan(catalogue.QUERIES["throttle_delay"](spark, sf))
    assert p.count("Exchange hashpartitioning") == 1 and "collect_list" not in p and "Window" not in p
