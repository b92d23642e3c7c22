import json
import random
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexengine.engine import Engine
from lexengine.functions import text
from lexengine.operators import embed, ingest, rerank, validate
from lexengine.operators.forms import string_paths, walked_paths
from lexengine.operators.index import exploded_forms, form_index, lemma_index
from lexengine.sources import entries as sources
from lexengine.sources import matrices
from lexengine.sources.connectors import embed_column, fetch, hash_embedder, overlap_reranker

ENTRIES = [
    {"word": "Buttan", "desc": "n", "paradigm": "12", "gender": "n", "translations": {"miks": ["Haus"], "engl": ["house", "home"]}, "forms": {"declension": [{"cases": [{"singular": "buttan", "plural": "butta"}]}]}},
    {"word": "semmē", "desc": "n", "translations": {"miks": ["Erde"], "engl": ["earth"]}, "forms": {"declension": [{"cases": [{"singular": "semmē", "plural": "semmis"}]}]}},
    {"word": "kwaitītun", "desc": "if", "translations": {"engl": ["want"]}, "forms": {"indicative": [{"forms": [{"form": "kwaita"}]}], "infinitives": [{"form": "kwaitītun"}]}},
    {"word": "deiwas", "desc": "n", "translations": {"miks": ["Gott"]}, "forms": {"imperative": [{"form": "deiwai"}]}},
    {"word": "buttan", "desc": "n", "translations": {"miks": ["Zweites"]}},
    {"word": "abbeimas", "desc": "↑ Abbai dat", "translations": {}},
    {"word": "leer", "desc": "av", "translations": {"miks": [], "engl": []}},
    {"word": "as", "desc": "pn", "translations": {"miks": ["ich"]}},
    {"word": "butta", "desc": "n", "translations": {"miks": ["Form-Lemma"]}, "forms": {"declension": [{"cases": [{"singular": "Buttan", "plural": None}]}]}},
]


@pytest.fixture(scope="module")
def entries(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("dictionary") / "entries.json"
    path.write_text(json.dumps(ENTRIES, ensure_ascii=False))
    return sources.read_entries(spark, str(path)).persist()


@pytest.fixture(scope="module")
def engine(entries):
    return Engine.build(entries, hash_embedder(64), overlap_reranker())


def test_entries_keep_order_and_maps(entries):
    rows = entries.orderBy("pos").collect()
    assert [r.word for r in rows] == [e["word"] for e in ENTRIES]
    assert rows[0].translations == {"miks": ["Haus"], "engl": ["house", "home"]} and rows[5].translations == {}


def test_entries_from_an_object(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"b": ENTRIES[1], "a": ENTRIES[0]}))
    assert {r.word for r in sources.read_entries(spark, str(tmp_path / "d.json")).collect()} == {"Buttan", "semmē"}


def test_missing_files(spark, tmp_path):
    with pytest.raises(Exception):
        sources.read_entries(spark, str(tmp_path / "none.json")).count()
    assert sources.read_or_empty(spark, str(tmp_path / "none"), sources.WORDLIST).count() == 0
    assert sources.state_row(spark, str(tmp_path / "none")) == {"phase": "enumerate", "done_prefixes": [], "done_3letter": [], "completed_words": 0}


def test_lists_keep_all_rows(spark, tmp_path):
    rows = spark.range(50).selectExpr("concat('w', id) AS word", "'1' AS paradigm")
    sources.write_json(rows.coalesce(1), str(tmp_path / "list"))
    sources.write_json(rows.limit(3).coalesce(1), str(tmp_path / "list"), "append")
    assert sources.read_or_empty(spark, str(tmp_path / "list"), sources.WORDLIST).count() == 53
    (tmp_path / "array.json").write_text(json.dumps([{"word": "a"}, {"word": "b"}], indent=2))
    assert sources.read_or_empty(spark, str(tmp_path / "array.json"), sources.WORDLIST, document=True).count() == 2


def test_npy_round_trip(spark, tmp_path):
    matrix = np.random.default_rng(0).random((9, 4), np.float32)
    np.save(tmp_path / "m.npy", matrix)
    rows = matrices.read_npy(spark, str(tmp_path / "m.npy")).orderBy("pos").collect()
    assert np.allclose([r.embedding for r in rows], matrix)


def test_positions_without_one_task(spark):
    rows = sources.with_position(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")), "k").orderBy("k").collect()
    assert [r.pos for r in rows] == list(range(1000))


@pytest.mark.parametrize("partitions", [8, 200])
def test_positions_of_wide_rows_keep_all_rows(spark, partitions):
    # wide rows of few keys, with the adaptive execution that coalesces partitions
    wide = spark.range(60_000, numPartitions=16).select(F.col("id"), (F.xxhash64("id") % 1000).alias("k"), F.repeat(F.md5(F.col("id").cast("string")), 20).alias("payload"), F.lit("x").alias("part"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    try:
        got = sources.with_position(wide, "k")
        assert got.columns == [*wide.columns, "pos"]
        rows = got.select("id", "k", "pos").orderBy("pos").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [r.pos for r in rows] == list(range(60_000)) and {r.id for r in rows} == set(range(60_000))
    assert [r.k for r in rows] == sorted(r.k for r in rows)


def test_positions_of_ties_nulls_and_no_rows(spark):
    rows = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b"), (None, "a"), (0, None)], "k int, v string")
    got = sources.with_position(rows, "k", "v").orderBy("pos").collect()
    assert [(r.k, r.v, r.pos) for r in got] == [(None, "a", 0), (None, "a", 1), (0, None, 2), (1, "b", 3), (1, "b", 4)]
    assert sources.with_position(rows.limit(0), "k").count() == 0


def test_indexes(entries):
    lemmas = {r.lemma: (r.pos, r.first_pos) for r in lemma_index(entries).collect()}
    assert lemmas["buttan"] == (4, 0)
    forms = {r.form: r.lemma for r in form_index(exploded_forms(entries)).collect()}
    assert forms["butta"] == "buttan" and forms["buttan"] == "buttan" and forms["kwaita"] == "kwaitītun" and forms["deiwai"] == "deiwas"


@pytest.mark.parametrize(
    "word,fuzzy,stage,first",
    [("BUTTAN ", True, 1, "buttan"), ("butta", True, 1, "butta"), ("semmis", True, 2, "semmē"), ("semme", True, 3, "semmē"), ("deiws", True, 5, "deiwas"), ("deiws", False, None, None), ("", True, 5, "as")],
)
def test_lookup_stages(spark, engine, word, fuzzy, stage, first):
    rows = engine.lookup_word(spark.createDataFrame([(1, word, fuzzy)], "qid bigint, word string, fuzzy boolean")).orderBy("rank").collect()
    if stage is None:
        assert rows == []
    else:
        assert rows[0].stage == stage and rows[0].word.lower() == first


def test_paths_of_a_form(spark, engine):
    row = engine.lookup_word(spark.createDataFrame([(1, "semmis", True)], "qid bigint, word string, fuzzy boolean")).first()
    assert row.matched_form == "semmis" and row.matched_paths == ["declension/0/cases/0/plural"]


def test_string_paths_order():
    assert string_paths('{"b":{"x":"Semmē"},"a":["semme",1,null]}', "semmē") == ["b/x", "a/0"]
    assert string_paths(None, "x") == [] and string_paths("{broken", "x") == []


def test_word_forms(spark, engine):
    asked = spark.createDataFrame([(1, "kwaita"), (2, "qqqqqqqqqq")], "qid bigint, word string")
    rows = {r.qid: r for r in engine.get_word_forms(asked).collect()}
    assert json.loads(rows[1].forms)["infinitives"] == [{"form": "kwaitītun"}] and rows[1].error is None
    assert rows[2].error == "Word not found: qqqqqqqqqq"
    assert engine.get_word_forms(asked, compat=True).where("qid = 1").first().forms == "{}"


def test_search_and_rerank(spark, engine):
    asked = spark.createDataFrame([(1, "German: Gott"), (2, "English: earth; German: Erde")], "qid bigint, query string")
    hits = engine.search_dictionary(asked, 2).collect()
    assert {r.word for r in hits if r.rank == 1} == {"deiwas", "semmē"}
    again = engine.search_dictionary(asked, 2, use_reranker=True, candidates=4).collect()
    assert len(again) == 4
    plain = engine.search_dictionary(asked, 2, use_reranker=True, candidates=0).collect()
    assert sorted(plain) == sorted(hits)


def test_rerank_failures(spark):
    rows = spark.createDataFrame([(1, "q", i + 1, i // 2, i % 2, f"d{i}") for i in range(4)], "qid bigint, query string, rank int, batch bigint, index bigint, doc string")

    def broken(q, docs):
        if "d0" in docs:
            raise ValueError("no")
        return [(i, 1.0) for i in range(len(docs))]

    assert rerank.score_batches(rows, broken, "drop").count() == 2
    kept = rerank.reranked(rows, rerank.score_batches(rows, broken, "fallback"), 4).orderBy("new_rank").collect()
    assert [r.rank for r in kept] == [3, 4, 1, 2]
    with pytest.raises(Exception):
        rerank.score_batches(rows, broken, "raise").count()


def test_corpus_rerank(entries):
    rows = rerank.rerank_corpus(entries, "Haus house", overlap_reranker()).collect()
    assert rows[0].word == "Buttan" and all(r.word not in ("leer", "abbeimas") for r in rows)


def test_tools(engine):
    assert engine.call_tool("lookup_word", {"word": "semme"})[0]["de"] == "Erde"
    assert engine.call_tool("nothing", {}) == {"error": "Unknown tool: nothing"}
    assert engine.call_tool("validate", {"sentence": "As buttan, zzzzzzzz."}) == {"valid": False, "issues": ["zzzzzzzz"]}
    assert engine.call_tool("search_dictionary", {"query": "German: Gott", "top_k": 1}) == [{"word": "deiwas", "de": "Gott", "en": ""}]


def test_views_and_table_function(spark, engine):
    engine.views()
    rows = spark.sql("SELECT e.word, p.path FROM entries e, LATERAL json_string_paths(e.forms_json, 'kwaita') p").collect()
    assert [(r.word, r.path) for r in rows] == [("kwaitītun", "indicative/0/forms/0/form")]


def test_table_functions_equal_the_engine(spark, engine):
    engine.views()
    words = ["Buttan ", "butta", "semme", "SEMMIS", "kwaita", "as", "deiwai", "none", "", None, "buttan"]
    asked = spark.createDataFrame([(i, w, False) for i, w in enumerate(words)], "qid bigint, word string, fuzzy boolean")
    asked.createOrReplaceTempView("asked_words")
    columns = ["qid", "rank", "stage", "word", "de", "en", "gender"]
    got = spark.sql("SELECT a.qid, h.* FROM asked_words a, LATERAL lookup_word(a.word) h").select(*columns).collect()
    want = engine.lookup_word(asked).select(*columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str) and len({r.stage for r in got}) >= 3
    records = spark.sql("SELECT a.qid, r.* FROM asked_words a, LATERAL word_record(a.word) r").collect()
    held = engine.get_word_forms(asked).where("lemma is not null")
    have = {r.qid: (r.lemma, r.translations.de, r.translations.en, r.paradigm, r.gender, r.forms) for r in held.collect()}
    assert {r.qid: tuple(r)[1:] for r in records} == {k: v for k, v in have.items() if k in {r.qid for r in got}}
    assert spark.sql("SELECT word FROM lookup_word('Semme')").first().word == "semmē"


def test_embedding_build(spark, entries, tmp_path):
    built = embed.build(entries, hash_embedder(8))
    assert {r.word for r in built.collect()} == {"Buttan", "semmē", "kwaitītun", "deiwas", "buttan", "as", "butta"}
    assert built.where("pos = 0").first().passage == "English: house, home; German: Haus"
    matrices.write_matrix(built, str(tmp_path / "e"), "hash", "local", "translations_only")
    assert json.loads((tmp_path / "e/meta.json").read_text()) == {"model": "hash", "provider": "local", "strategy": "translations_only", "num_entries": 7, "embedding_dim": 8}

    def broken(texts):
        raise OSError("down")

    assert set(embed_column(entries.limit(1), "word", broken, zero_on_error=True, dimension=3).first().embedding) == {0.0}


def test_fetch_tries_again():
    waits, calls = [], []

    def failing(request, timeout):
        calls.append(request)
        raise OSError("down")

    with pytest.raises(OSError):
        fetch("http://x", wait=waits.append, open_url=failing)
    assert len(calls) == 3 and waits == [5.0, 10.0]


@pytest.mark.parametrize("q,c,d,score", [("butan", "buttan", 1, 28.5), ("deiws", "deiwas", 1, 19.0), ("semm", "semme", 1, 27.0), ("as", "tu", 2, 9.0), ("abcd", "abce", 1, 19.5)])
def test_fuzzy_score(spark, q, c, d, score):
    assert spark.range(1).select(text.fuzzy_score(F.lit(q), F.lit(c), F.lit(d)).alias("s")).first().s == score


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_goldens(spark):
    assert one(spark, text.clean(F.lit("<b>a</b> &amp;  c"))) == "a & c"
    assert tuple(one(spark, text.split_response(F.lit("As asma [DE: Ich bin]")))) == ("As asma", "Ich bin")
    assert tuple(one(spark, text.split_response(F.lit("no marker")))) == ("no marker", "")
    call = one(spark, text.xml_calls(F.lit('<search query="König" top_k="3" />')))[0]
    assert call.name == "search" and call.arguments == {"query": "König", "top_k": "3"}
    tagged = one(spark, text.tagged_calls(F.lit('<tool_call>{"name":"a","arguments":{"x":1}}</tool_call>')))[0]
    assert tagged.name == "a" and json.loads(tagged.arguments) == {"x": 1}
    flexible = one(spark, text.flexible_call(F.lit('search_dictionary(query="Haus", top_k=3)')))
    assert flexible.name == "search_dictionary" and json.loads(flexible.arguments) == {"query": "Haus", "top_k": 3}
    assert [tuple(p) for p in one(spark, text.result_lines(F.lit("ERGEBNIS:\nIch;As")))] == [("Ich", "As")]
    assert [tuple(p) for p in one(spark, text.loose_result_lines(F.lit("Beispiel eins;abc\nIch bin;As asma\na;b")))] == [("Ich bin", "As asma")]
    assert one(spark, text.stream_text(F.lit("a<tool_call>x</tool_call>b"))) == "a<tool_call>x</tool_call>"
    parts = one(spark, text.reference_parts(F.lit("↑ Aīns f [ainā 61(21)]")))
    assert (parts.base_form, parts.grammar, parts.source, parts.is_form) == ("Aīns", "f", "ainā 61(21)", True)
    assert one(spark, text.word_type(F.lit("↑ x"))) == "" and one(spark, text.word_type(F.lit("N pl"))) == "n"
    assert one(spark, ingest.upper_median(F.array(*[F.lit(float(i)) for i in (4, 1, 3, 2)]))) == 3.0


def test_segments_cover_the_distance(spark):
    rng = np.random.default_rng(2)
    words = {"", "a", "ab", "ba", "abc", "āb"} | {"".join(rng.choice(list("abc"), rng.integers(0, 9))) for _ in range(120)}
    rows = spark.createDataFrame([(w,) for w in sorted(words)], "w string")
    pairs = rows.crossJoin(rows.withColumnRenamed("w", "v")).select("w", "v", F.levenshtein("w", "v").alias("d"), F.arrays_overlap(text.segments(F.col("w")), text.segment_keys(F.col("v"))).alias("met"))
    assert pairs.where("d <= 2 AND NOT met").count() == 0 and pairs.where("d > 2 AND NOT met").count() > 0


def test_recursive_walk_equals_the_table_function(spark):
    rng = random.Random(8)

    def made(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.4:
            return rng.choice(["a", "A", "ā", "Ā", "b", "", 1, None, True, 2.5])
        if kind < 0.7:
            return [made(depth - 1) for _ in range(rng.randint(0, 3))]
        return {rng.choice(["a", "b", "x/y", "0", "ā"]) + str(k): made(depth - 1) for k in range(rng.randint(0, 3))}

    rows = [(i, json.dumps(made(rng.randint(0, 6))), rng.choice(["a", "Ā", "b", ""])) for i in range(300)] + [(900, "{broken", "a"), (901, None, "a"), (902, '"a"', None), (903, "", "a")]
    rows.append((904, "[" * 150 + '"a"' + "]" * 150, "a"))
    got = walked_paths(spark.createDataFrame(rows, "id bigint, document string, target string"))
    want = Counter((i, p) for i, d, t in rows for p in string_paths(d, t))
    assert Counter((r.id, r.path) for r in got.collect()) == want and sum(want.values()) > 100


def test_validation_and_recall(spark, engine):
    rows = engine.validate(spark.createDataFrame([(1, "Buttan semme."), (2, "xyzxyzxyz buttan qwertzuiop")], "qid bigint, sentence string")).orderBy("qid").collect()
    assert rows[0].valid and rows[1].issues == ["xyzxyzxyz", "qwertzuiop"]
    # a search that has hits vouches for words, one that has none doesn't
    sentence = spark.createDataFrame([(2, "xyzxyzxyz buttan qwertzuiop")], "qid bigint, sentence string")
    assert engine.validate(sentence, by_search=True).first().valid
    bare = replace(engine, vectors=engine.vectors.limit(0))
    assert bare.validate(sentence, by_search=True).first().issues == ["xyzxyzxyz", "qwertzuiop"]
    expected = spark.createDataFrame([("a", ["tu", "as"])], "category string, terms array<string>")
    got = validate.expected_recall(expected, spark.createDataFrame([("a", "TUsa")], "category string, word string"))
    assert got.first().recall == 0.5 and validate.mean_recall(got).first().mean_recall == 0.5


def test_ingest_resumes(spark):
    a = spark.createDataFrame([("w", "1", "n"), ("w", "1", "n"), ("v", "2", "n")], "word string, paradigm string, desc string")
    known = a.limit(0)
    once = ingest.merge(known, a)
    assert once.count() == 2 and ingest.merge(once, a).count() == 2
    assert ingest.remaining(ingest.prefixes(spark), spark.createDataFrame([("ab",)], "prefix string")).count() == 728


def test_batch_of_calls(spark, engine):
    calls = [(1, "lookup", {"word": "semme"}), (2, "search", {"query": "German: Gott"}), (3, "get_forms", {"lemma": "kwaita"}), (4, "nothing", {}), (5, "lookup", {"word": "deiws", "fuzzy": "false"}), (6, "validate", {"sentence": "buttan"})]
    got = {r.qid: json.loads(r.result) for r in engine.dispatch(spark.createDataFrame(calls, "qid bigint, name string, arguments map<string,string>"), 1).collect()}
    assert got[1][0]["de"] == "Erde" and got[2] == [{"word": "deiwas", "de": "Gott", "en": ""}] and got[3]["lemma"] == "kwaitītun"
    assert got[4] == {"error": "Unknown tool: nothing"} and got[5] == [] and got[6] == {"valid": True, "issues": []}


def test_evaluation(spark, engine):
    from lexengine.operators.evaluate import evaluate

    questions = spark.createDataFrame([("house", "English: house", ["BUTT"]), ("god", "German: Gott", ["deiwas", "none"])], "category string, query string, terms array<string>")
    rows = evaluate(engine, questions, 3).collect()
    assert {r.method for r in rows} == {"embedding", "two stages", "corpus"} and len(rows) == 6
    assert {r.recall for r in rows if r.category == "god" and r.method != "corpus"} == {0.5}


def test_enumeration_subdivides_and_completes(spark):
    words = [f"ab{a}{b}" for a in "abde" for b in "abdeghij"] + ["gi"]
    source = spark.createDataFrame([(w, "1", "n") for w in words], "word string, paradigm string, desc string")

    def ask(prefixes):
        hit = prefixes.join(source, F.startswith("word", "prefix"))
        n = F.row_number().over(__import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy("prefix").orderBy("word"))
        return hit.withColumn("n", n).where("n <= 30").drop("n")

    start = spark.createDataFrame([("ab",), ("gi",), ("zz",)], "prefix string")
    found, asked = ingest.enumerate_words(start, ask, source.limit(0))
    assert {r.word for r in found.collect()} == set(words)
    assert {r.prefix for r in asked.collect()} > {"ab", "gi", "zz", "aba"}
    results = spark.createDataFrame([("gi", "1", "miks", 0, ["eins"]), ("gi", "1", "miks", 1, ["zwei"]), ("gi", "1", "engl", 0, [])], "word string, paradigm string, lang string, n int, translations array<string>")
    done = source.where("word <> 'gi'")
    assert [(r.word, r.translations) for r in ingest.complete_words(source, done, results).collect()] == [("gi", {"miks": ["eins"]})]
    assert ingest.search_requests(start, "http://x", "d").first().url == "http://x/?s=ab&language=engl&dia=d"
    assert ingest.form_requests(source, "http://x", "d").count() == len(words)


def test_completion_stream(spark):
    stream = 'data: {"choices":[{"delta":{"content":"a"}}]}\n\ndata: {broken\n\ndata: {"choices":[{"delta":{"reasoning_content":"r"}}]}\n\ndata: [DONE]\n\ndata: {"choices":[]}'
    assert [tuple(d) for d in one(spark, text.completion_deltas(F.lit(stream)))] == [("a", None), (None, "r")]


def test_chat_service(monkeypatch):
    from lexengine.sources import connectors

    monkeypatch.setattr(connectors, "fetch", lambda *a, **k: json.dumps({"choices": [{"message": {"content": "c", "reasoning_content": "r"}}]}))
    assert connectors.http_chat(connectors.Settings(), "http://x", "m")([]) == "r"


def test_prompts_and_tools(spark, tmp_path):
    from lexengine.sources import prompts

    assert prompts.load_prompt(str(tmp_path / "none")) == prompts.DEFAULT_PROMPT
    tools = [json.loads(r.tool) for r in prompts.function_format(prompts.tool_table(spark)).orderBy("n").collect()]
    assert tools[0]["function"]["parameters"]["required"] == ["query"] and tools[1]["function"]["parameters"]["properties"]["fuzzy"] == {"type": "boolean", "default": "true"}


def test_dialogue_loops():
    from lexengine.operators import chat

    replies = iter(["call", "call", "call", "done"])
    parse = lambda t: [{"name": "lookup", "arguments": {"w": 1}}] if t == "call" else []
    answer, calls = chat.generate(lambda m: next(replies), lambda n, a: {"ok": 1}, "s", "u", parse)
    assert answer == "call" and len(calls) == 1
    out = chat.staged_answer("q", lambda q: ["Ich"], lambda g: g + " Haus", lambda w: [{"word": w, "de": "d", "en": "e"}], lambda c: c, str.split)
    assert out.splitlines() == ['search "Ich":', "  Ich [d] (e)", 'search "Haus":', "  Haus [d] (e)"]


def _subdivided(words, cap, depth):
    """Level by level: counts of the words under the prefixes that overflowed."""
    out, live = {}, {w for w in words if w and len(w) >= 2}
    for k in range(2, depth + 1):
        counts = Counter(w[:k] for w in live if len(w) >= k)
        out |= counts
        live = {w for w in live if counts[w[:k]] >= cap}
    return out


@pytest.mark.parametrize("cap, depth", [(1, 6), (3, 4), (5, 6), (1000, 6)])
def test_subdivision_equals_levels(spark, cap, depth):
    rng = random.Random(cap)
    words = ["".join(rng.choices("abā", k=rng.randrange(9))) for _ in range(400)] + [None, "", "a", "ab", "ab"]
    rows = spark.createDataFrame([(w,) for w in words], "word string")
    got = ingest.subdivide(rows, cap=cap, depth=depth).collect()
    assert len(got) == len({r.prefix for r in got})
    assert {r.prefix: r.n for r in got} == _subdivided(words, cap, depth)


def test_subdivision_of_nothing(spark):
    assert ingest.subdivide(spark.createDataFrame([], "word string")).collect() == []
