"""Queries of the engine over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text, vector
from ..functions.measure import Measure
from ..operators import chat, embed, evaluate, forms, index, ingest, lookup, rerank, search, tables, validate
from ..sources import entries as entry_files
from ..sources import prompts as prompt_files
from ..sources.connectors import embed_column
from ..sources.scratch import scratch_dir, written
from . import lexicon as L
from .lexicon import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _long(*names: str):
    return [F.col(n).cast("bigint").alias(n) for n in names]


# Search.

COSINE = "list_reduce(list_prepend(0e0, list_transform(list_zip(q.e, r.e), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), lambda a, b: a + b)"
_NORM = "sqrt(list_reduce(list_prepend(0e0, list_transform({0}, lambda x: x::DOUBLE * x::DOUBLE)), lambda a, b: a + b))"
_SCORED = f"""
q AS (SELECT vec_id AS qid, embedding AS e, {_NORM.format('embedding')} AS n FROM embeddings WHERE vec_id % 20 = 0),
r AS (SELECT vec_id AS pos, label, embedding AS e, greatest({_NORM.format('embedding')}, 1e-10) AS n FROM embeddings),
scored AS (SELECT qid, pos, label, round({COSINE} / (CASE WHEN q.n > 1e-10 THEN q.n ELSE 1e0 END * r.n), 6) AS score FROM q, r)"""


def _vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "pos")
    return rows.where("pos % 20 = 0").select(F.col("pos").alias("qid"), F.col("embedding").alias("vector"), "label"), rows


@query(f"WITH {_SCORED} SELECT qid, pos, score, rank::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos DESC) AS rank FROM scored) WHERE rank <= 10")
def vec_topk_cosine(spark, sf_dir):
    """Every twentieth vector is a query against all vectors."""
    queries, rows = _vectors(spark, sf_dir)
    return search.top_k(queries, rows, 10, decimals=6).select("qid", "pos", "score", *_long("rank"))


@query(f"WITH {_SCORED} SELECT qid, pos, score, rank::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos DESC) AS rank FROM scored) WHERE rank <= 10")
def vec_topk_expressions(spark, sf_dir):
    queries, rows = _vectors(spark, sf_dir)
    return search.top_k_expressions(queries, rows, 10, decimals=6).select("qid", "pos", "score", *_long("rank"))


@query(f"""WITH {_SCORED}, near AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos DESC) AS r FROM scored),
kept AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos DESC) AS rank FROM near WHERE r <= 10 AND label % 2 = 0)
SELECT qid, pos, score, rank::BIGINT AS rank FROM kept WHERE rank <= 5""")
def vec_topk_postfilter(spark, sf_dir):
    """Twice k first, then the filter, then k: fewer than k rows are possible."""
    queries, rows = _vectors(spark, sf_dir)
    near = search.top_k(queries, rows, 10, decimals=6).drop("rank").join(rows.select("pos", "label"), "pos").where("label % 2 = 0")
    return search._ranked(near, 5).select("qid", "pos", "score", *_long("rank"))


@query(f"SELECT vec_id, round({_NORM.format('embedding')}, 9) AS norm, round(greatest({_NORM.format('embedding')}, 1e-10), 9) AS clipped FROM embeddings")
def vec_norm_clip(spark, sf_dir):
    n = vector.norm(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(n, 9).alias("norm"), F.round(F.greatest(n, F.lit(vector.LEAST_NORM)), 9).alias("clipped"))


@query("SELECT vec_id, CASE WHEN label = 3 THEN 0e0 ELSE round(list_reduce(list_prepend(0e0, list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), lambda a, b: a + b), 9) END AS squared FROM embeddings")
def vec_zero_fallback(spark, sf_dir):
    failed = F.when(F.col("label") != 3, F.col("embedding"))
    e = vector.or_zero(failed, 64)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vector.dot(e, e), 9).alias("squared"))


_TOP20 = f"WITH {_SCORED}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos DESC) AS rank FROM scored) WHERE rank <= 20)"


def _top20(spark, sf_dir):
    queries, rows = _vectors(spark, sf_dir)
    top = search.top_k(queries, rows, 20, decimals=6).join(rows.select("pos", "label"), "pos")
    return rerank.batched(top, 8)


@query(_TOP20 + """, s AS (SELECT *, ((pos * 7 + qid) % 101)::DOUBLE AS rel FROM top)
SELECT qid, pos, rel AS rerank_score, new_rank::BIGINT AS new_rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, rank) AS new_rank FROM s) WHERE new_rank <= 10""")
def two_stage_rerank(spark, sf_dir):
    """Candidates in batches of 8 to a scorer that stands in for a model."""
    docs = _top20(spark, sf_dir).withColumn("query", F.col("qid").cast("string")).withColumn("doc", F.col("pos").cast("string"))

    def scorer(q: str, texts: list[str]) -> list[tuple[int, float]]:
        return [(i, float((int(t) * 7 + int(q)) % 101)) for i, t in enumerate(texts)]

    best = rerank.reranked(docs, rerank.score_batches(docs, scorer), 10)
    return best.select("qid", "pos", "rerank_score", *_long("new_rank"))


_TYPES = "['pn', 'prp', 'crd', 'av', 'aj', 'n', 'pc', 'ij', 'xx', ''][(label + 1)::INT]"


@query(_TOP20 + f""", s AS (SELECT *, {_TYPES} AS word_type, ((pos * 7 + qid) % 101)::DOUBLE AS rel FROM top),
w AS (SELECT *, rel * CASE word_type WHEN 'pn' THEN 5e0 WHEN 'prp' THEN 4.5e0 WHEN 'crd' THEN 4e0 WHEN 'av' THEN 3.5e0 WHEN 'aj' THEN 3e0 WHEN 'n' THEN 3e0 WHEN 'pc' THEN 2.5e0 WHEN 'ij' THEN 0.1e0 ELSE 1e0 END AS weighted FROM s)
SELECT qid, pos, word_type, round(weighted, 6) AS rerank_score, new_rank::BIGINT AS new_rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY weighted DESC, rank) AS new_rank FROM w) WHERE new_rank <= 10""")
def weighted_rerank(spark, sf_dir):
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("pn", "prp", "crd", "av", "aj", "n", "pc", "ij", "xx", "")]), F.col("label") + 1)
    top = _top20(spark, sf_dir).withColumn("word_type", kinds)
    scores = top.select("qid", "rank", ((F.col("pos") * 7 + F.col("qid")) % 101).cast("double").alias("relevance"))
    best = rerank.reranked(top, scores, 10, rerank.type_weight(F.col("word_type")))
    return best.select("qid", "pos", "word_type", F.round("rerank_score", 6).alias("rerank_score"), *_long("new_rank"))


@query(_TOP20 + """, twice AS (SELECT qid, rank, rel FROM (SELECT qid, rank, (rank % 5)::DOUBLE AS rel FROM top UNION ALL SELECT qid, rank, (pos % 3)::DOUBLE FROM top))
SELECT qid, rank::BIGINT AS rank, sum(rel) AS relevance FROM twice GROUP BY qid, rank""")
def rerank_score_sum(spark, sf_dir):
    top = _top20(spark, sf_dir)
    one = top.select("qid", "rank", (F.col("rank") % 5).cast("double").alias("relevance"))
    two = top.select("qid", "rank", (F.col("pos") % 3).cast("double").alias("relevance"))
    return rerank.summed(one.unionByName(two)).select("qid", *_long("rank"), "relevance")


@query(_TOP20 + """, per AS (SELECT t.qid, avg(CASE WHEN t.label = q.label THEN 1e0 ELSE 0e0 END) AS recall FROM top t JOIN (SELECT vec_id AS qid, label FROM embeddings) q ON t.qid = q.qid GROUP BY t.qid)
SELECT round(avg(recall), 9) AS mean_recall, count(*) AS queries FROM per""")
def eval_label_recall(spark, sf_dir):
    """Share of neighbours with the query's label, averaged over queries."""
    queries, _ = _vectors(spark, sf_dir)
    hits = _top20(spark, sf_dir).join(queries.select("qid", F.col("label").alias("wanted")), "qid")
    per = hits.groupBy("qid").agg(F.avg((F.col("label") == F.col("wanted")).cast("double")).alias("recall"))
    return per.agg(F.round(F.avg("recall"), 9).alias("mean_recall"), F.count(F.lit(1)).alias("queries"))


@query("""WITH e AS (SELECT lang AS category, unnest(['the', 'der', 'que', 'zzzz']) AS term FROM (SELECT DISTINCT lang FROM documents)),
w AS (SELECT DISTINCT lang, lower(unnest(string_split_regex(text, '[ \\n\\t\\r]+'))) AS word FROM documents),
f AS (SELECT DISTINCT category, term FROM e JOIN w ON category = lang AND contains(word, term))
SELECT e.category, count(f.term) AS found, count(*) AS expected, count(f.term) / count(*)::DOUBLE AS recall FROM e LEFT JOIN f ON e.category = f.category AND e.term = f.term GROUP BY e.category""")
def eval_expected_recall(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    expected = docs.select(F.col("lang").alias("category")).distinct().withColumn("terms", F.array(*[F.lit(x) for x in ("the", "der", "que", "zzzz")]))
    return validate.expected_recall(expected, docs.select(F.col("lang").alias("category"), F.explode(F.split("text", r"[ \n\t\r]+")).alias("word")))


# Lexicon and lookup.


@query(f"WITH {L.SQL_ENTRIES} SELECT word, pos, n FROM entries")
def lexicon_entries(spark, sf_dir):
    place = F.min(F.col("doc_id") * 1000000 + F.col("i")).alias("pos")
    return L.tokens(spark, sf_dir).groupBy("word").agg(place, F.count(F.lit(1)).alias("n"))


@query(f"WITH {L.SQL_ENTRIES} SELECT substr(word, 1, 4) AS lemma, max(pos) AS pos, min(pos) AS first_pos, arg_max(word, pos) AS last_word FROM entries GROUP BY 1")
def lexicon_last_wins(spark, sf_dir):
    """Of equal keys the last entry holds, in the place of the first."""
    rows = L.entries(spark, sf_dir).withColumn("lemma", F.substring("word", 1, 4))
    return rows.groupBy("lemma").agg(F.max("pos").alias("pos"), F.min("pos").alias("first_pos"), F.max_by("word", "pos").alias("last_word"))


@query(f"WITH {L.SQL_ENTRIES}, f AS (SELECT pos, word AS lemma, substr(word, 1, 4) AS form FROM entries) SELECT form, arg_min(lemma, pos) AS lemma FROM f GROUP BY form")
def forms_first_wins(spark, sf_dir):
    from ..operators.index import form_index

    rows = L.entries(spark, sf_dir).select("pos", "word", F.substring("word", 1, 4).alias("form"))
    return form_index(rows).select("form", "lemma")


_LOOKUP = f"WITH {L.SQL_ENTRIES}, {L.SQL_INDEXES}, {L.SQL_ASKED}"
_STAGE1 = ", s1 AS (SELECT qid, 1 AS stage, lemma, l.pos, lemma AS matched_form, 0e0 AS score, l.pos AS o FROM keyed JOIN lemmas l ON key = lemma)"
_STAGE2 = """, k2 AS (SELECT * FROM keyed WHERE qid NOT IN (SELECT qid FROM s1)),
s2 AS (SELECT qid, 2 AS stage, l.lemma, l.pos, form AS matched_form, 0e0 AS score, l.pos AS o FROM k2 JOIN forms f ON key = form JOIN lemmas l ON f.lemma = l.lemma)"""
_STAGE3 = """, k3 AS (SELECT * FROM k2 WHERE qid NOT IN (SELECT qid FROM s2)),
s3 AS (SELECT qid, 3 AS stage, lemma, l.pos, lemma AS matched_form, 0e0 AS score, l.pos AS o FROM k3 JOIN lemmas l ON norm = lemma_norm)"""
_STAGE4 = """, k4 AS (SELECT * FROM k3 WHERE qid NOT IN (SELECT qid FROM s3)),
s4 AS (SELECT qid, 4 AS stage, l.lemma, l.pos, arg_min(form, form_pos) AS matched_form, 0e0 AS score, min(form_pos) AS o FROM k4 JOIN forms f ON norm = form_norm JOIN lemmas l ON f.lemma = l.lemma GROUP BY ALL)"""
_NEAR = f"SELECT qid, norm, lemma, lemma_norm, pos, {L.sql_distance('norm', 'lemma_norm')} AS d FROM {{0}}, lemmas WHERE abs(length(norm) - length(lemma_norm)) <= 2"
_STAGE5 = f""", k5 AS (SELECT * FROM k4 WHERE qid NOT IN (SELECT qid FROM s4)),
d5 AS ({_NEAR.format('k5')}),
c5 AS (SELECT *, {L.sql_score('norm', 'lemma_norm', 'd')} AS score FROM d5 WHERE d <= 2),
s5 AS (SELECT * FROM (SELECT qid, 5 AS stage, lemma, pos, lemma AS matched_form, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, d, pos, lemma) AS o FROM c5) WHERE o <= 5)"""


def _words(spark, sf_dir):
    return L.asked(spark, sf_dir).select("qid", text.normal("word").alias("key")).withColumn("norm", text.fold("key"))


@query(_LOOKUP + _STAGE1 + " SELECT qid, lemma, pos FROM s1")
def lookup_exact(spark, sf_dir):
    lemmas = L.lemmas(spark, sf_dir)
    return lookup.stage_exact(_words(spark, sf_dir), lemmas).select("qid", "lemma", "pos")


@query(_LOOKUP + " SELECT qid, l.lemma, l.pos, form AS matched_form FROM keyed JOIN forms f ON key = form JOIN lemmas l ON f.lemma = l.lemma")
def lookup_form(spark, sf_dir):
    _, lemmas, forms_ = L.dictionary(spark, sf_dir)
    return lookup.stage_form(_words(spark, sf_dir), forms_, lemmas).select("qid", "lemma", "pos", "matched_form")


@query(_LOOKUP + " SELECT qid, lemma, l.pos FROM keyed JOIN lemmas l ON norm = lemma_norm")
def lookup_folded_lemma(spark, sf_dir):
    lemmas = L.lemmas(spark, sf_dir)
    return lookup.stage_folded_lemma(_words(spark, sf_dir), lemmas).select("qid", "lemma", "pos")


@query(_LOOKUP + " SELECT qid, l.lemma, l.pos, arg_min(form, form_pos) AS matched_form FROM keyed JOIN forms f ON norm = form_norm JOIN lemmas l ON f.lemma = l.lemma GROUP BY ALL")
def lookup_folded_form(spark, sf_dir):
    _, lemmas, forms_ = L.dictionary(spark, sf_dir)
    return lookup.stage_folded_form(_words(spark, sf_dir), forms_, lemmas).select("qid", "lemma", "pos", "matched_form")


@query(_LOOKUP + f""", d5 AS ({_NEAR.format('keyed')}),
c5 AS (SELECT *, {L.sql_score('norm', 'lemma_norm', 'd')} AS score FROM d5 WHERE d <= 2)
SELECT qid, lemma, score, r::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, d, pos, lemma) AS r FROM c5) WHERE r <= 5""")
def lookup_fuzzy(spark, sf_dir):
    lemmas = L.lemmas(spark, sf_dir)
    return lookup.stage_fuzzy(_words(spark, sf_dir), lemmas).select("qid", "lemma", "score", F.col("rank_pos").alias("rank"))


@query(f"""WITH {L.SQL_ENTRIES}, p AS (SELECT word AS a, lead(word) OVER (PARTITION BY left(word, 2) ORDER BY word COLLATE "C") AS b FROM entries),
d AS (SELECT a, b, {L.sql_distance('a', 'b')}::BIGINT AS d FROM p WHERE b IS NOT NULL) SELECT a, b, d, {L.sql_score('a', 'b', 'd')} AS score FROM d""")
def fuzzy_score(spark, sf_dir):
    """The score of each word of the dictionary for the next one in order with the same two first letters."""
    following = F.lead("word").over(W.partitionBy(F.left("word", F.lit(2))).orderBy("word"))
    pairs = L.entries(spark, sf_dir).select(F.col("word").alias("a"), following.alias("b")).where("b IS NOT NULL")
    near = pairs.withColumn("d", F.levenshtein("a", "b"))
    return near.select("a", "b", F.col("d").cast("bigint").alias("d"), text.fuzzy_score(F.col("a"), F.col("b"), F.col("d")).alias("score"))


def _cascade(spark, sf_dir):
    return (*L.dictionary(spark, sf_dir), L.asked(spark, sf_dir))


_CASCADE = _LOOKUP + _STAGE1 + _STAGE2 + _STAGE3 + _STAGE4 + _STAGE5 + ", hits AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3 UNION ALL SELECT * FROM s4 UNION ALL SELECT * FROM s5), ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY o, lemma) AS rank FROM hits)"


@query(_CASCADE + " SELECT qid, stage::BIGINT AS stage, rank::BIGINT AS rank, lemma, pos, matched_form, score FROM ranked")
def lookup_cascade(spark, sf_dir):
    """All five stages on words that exercise each."""
    _, lemmas, forms_, words = _cascade(spark, sf_dir)
    return lookup.lookup(words, lemmas, forms_).select("qid", *_long("stage", "rank"), "lemma", "pos", "matched_form", "score")


@query(_CASCADE + """ SELECT qid, rank::BIGINT AS rank, f.word, f.de, f.en, CASE WHEN gender <> '' THEN gender END AS gender,
  CASE WHEN matched_form <> f.word AND matched_form = f.word || 's' THEN matched_form END AS matched_form,
  CASE WHEN matched_form <> f.word AND matched_form = f.word || 's' THEN 'declension/0/cases/0/plural' END AS path FROM ranked r JOIN full_entries f ON r.pos = f.pos""")
def lookup_described(spark, sf_dir):
    """Hits as callers see them, with the path of the matched form."""
    rows, lemmas, forms_, words = _cascade(spark, sf_dir)
    hits = forms.with_paths(lookup.described(lookup.lookup(words, lemmas, forms_), rows))
    return hits.select("qid", *_long("rank"), "word", "de", "en", "gender", "matched_form", F.get("matched_paths", F.lit(0)).alias("path"))


@query(_CASCADE + """, one AS (SELECT r.qid, f.word, f.de, f.en, '12' AS paradigm, f.gender FROM ranked r JOIN full_entries f ON r.pos = f.pos WHERE rank = 1)
SELECT k.qid, one.word AS lemma, one.de, one.en, paradigm, gender, CASE WHEN one.word IS NULL THEN 'missing' END AS error FROM keyed k LEFT JOIN one ON k.qid = one.qid""")
def word_forms(spark, sf_dir):
    rows, lemmas, forms_, words = _cascade(spark, sf_dir)
    out = forms.word_forms(words, rows, lemmas, forms_)
    gender = F.when(F.col("lemma").isNotNull(), F.coalesce("gender", F.lit("")))
    return out.select("qid", "lemma", "translations.de", "translations.en", "paradigm", gender.alias("gender"), F.when(F.col("error").isNotNull(), "missing").alias("error"))


@query(f"WITH {L.SQL_ENTRIES} SELECT pos, 'declension/0/cases/0/singular' AS path, 0::BIGINT AS n FROM entries UNION ALL SELECT pos, 'label', 1::BIGINT FROM entries WHERE word = 'the'")
def json_paths(spark, sf_dir):
    """Paths by the table function, from SQL."""
    forms.register(spark)
    rows = L.entries(spark, sf_dir).withColumn("doc", F.when(F.col("word") == "the", F.concat(F.expr("left(forms_json, length(forms_json) - 1)"), F.lit(',"label":"THE"}'))).otherwise(F.col("forms_json")))
    return spark.sql("SELECT pos, p.path, CAST(p.n AS BIGINT) AS n FROM {documents}, LATERAL json_string_paths(doc, word) AS p", documents=rows)


@query(_LOOKUP + _STAGE1 + _STAGE2 + _STAGE3 + _STAGE4 + """, hits AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3 UNION ALL SELECT * FROM s4),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY o, lemma) AS rank FROM hits)
SELECT qid, rank::INT AS rank, stage::INT AS stage, f.word, f.de, f.en, nullif(gender, '') AS gender, nullif(matched_form, f.word) AS matched_form FROM ranked r JOIN full_entries f ON r.pos = f.pos""")
def lookup_table_function(spark, sf_dir):
    """A batch of words through the SQL table function, which becomes joins with the indexes."""
    for name, rows in zip(("entries", "lemma_index", "form_index"), L.dictionary(spark, sf_dir)):
        rows.createOrReplaceTempView(name)
    tables.register(spark)
    found = spark.sql("SELECT a.qid, h.* FROM {asked} a, LATERAL lookup_word(a.word) h", asked=L.asked(spark, sf_dir))
    return found.select("qid", "rank", "stage", "word", "de", "en", "gender", "matched_form")


@query(f"WITH {L.SQL_ENTRIES} SELECT pos, 'declension/0/cases/0/singular' AS path FROM entries UNION ALL SELECT pos, 'more/1/' || word FROM entries")
def json_walk(spark, sf_dir):
    """Paths by a recursive query, without Python; documents have a branch whose key is the word and that holds it, too."""
    more = F.concat(F.expr("left(forms_json, length(forms_json) - 1)"), F.lit(',"more":[null,{"'), "word", F.lit('":"'), "word", F.lit('","x":"'), "word", F.lit('x"}]}'))
    rows = L.entries(spark, sf_dir).select(F.col("pos").alias("id"), more.alias("document"), F.col("word").alias("target"))
    return forms.walked_paths(rows).select(F.col("id").alias("pos"), "path")


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS pos FROM orders")
def positions(spark, sf_dir):
    """The place of each row in an order, as entries have one."""
    return entry_files.with_position(table(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey"), "o_totalprice", "o_orderkey").select("o_orderkey", "o_totalprice", "pos")


# Text functions.


@query(f"SELECT doc_id, translate(text, '{text.MACRONS}', '{text.PLAIN_VOWELS}') AS folded FROM (SELECT doc_id, translate(text, 'aeiou', 'āēīōū') AS text FROM documents)")
def fold_macrons(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("text", F.translate("text", "aeiou", "āēīōū"))
    return docs.select("doc_id", text.fold("text").alias("folded"))


@query("SELECT doc_id, lower(regexp_extract(text, '^\\s*([\\p{L}\\p{N}_]+)', 1)) AS word_type FROM documents")
def word_type(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.word_type("text").alias("word_type"))


@query(f"""WITH {L.SQL_ENTRIES}, t AS (SELECT *, lower(regexp_extract(kind, '^\\s*([\\p{{L}}\\p{{N}}_]+)', 1)) AS wt FROM full_entries)
SELECT pos, concat_ws(' | ', nullif(de, ''), nullif(en, '')) AS multilang,
  concat_ws(' ', word, CASE WHEN wt <> '' THEN '[' || wt || ']' END, CASE WHEN gender <> '' THEN '(' || gender || ')' END, ': ' || de, CASE WHEN en <> '' THEN '| ' || en END) AS line,
  word || ' [' || wt || ']: ' || de || ' | ' || en || ' |  | ' AS evaluation, trim(word || ' ' || de || ' ' || en, ' ') AS plain,
  concat_ws('; ', CASE WHEN en <> '' THEN 'English: ' || en || ', ' || word || 'x' END, CASE WHEN de <> '' THEN 'German: ' || de END) AS passage FROM t""")
def entry_formats(spark, sf_dir):
    e = L.entries(spark, sf_dir)
    kind = text.word_type("desc")
    de, en = text.first_translation("translations", "miks"), text.first_translation("translations", "engl")
    nothing = F.lit("")
    return e.select("pos", text.multilang("translations").alias("multilang"), text.entry_line(F.col("word"), kind, F.col("gender"), de, en).alias("line"), text.evaluation_line(F.col("word"), kind, de, en, nothing, nothing).alias("evaluation"), text.plain_line(F.col("word"), de, en).alias("plain"), text.passage("translations").alias("passage"))


@query(f"WITH {L.SQL_ENTRIES} SELECT pos FROM full_entries WHERE de <> '' OR en <> ''")
def has_translation(spark, sf_dir):
    return embed.embeddable(L.entries(spark, sf_dir)).select("pos")


@query(f"WITH {L.SQL_ENTRIES} SELECT count(*) AS entries, count(*) FILTER (en <> '') AS with_engl, count(*) FILTER (de <> '') AS with_miks, count(*) AS with_forms FROM full_entries")
def ingest_status(spark, sf_dir):
    return ingest.status(L.entries(spark, sf_dir), ("engl", "miks")).select("entries", "with_engl", "with_miks", "with_forms")


def _clean(column: str) -> str:
    out = f"regexp_replace({column}, '<[^>]+>', '', 'g')"
    for reference, sign in text.ENTITIES:
        out = f"replace({out}, '{reference}', '{sign.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace({out}, '[\\s\\x{{00A0}}]+', ' ', 'g'), ' ')"


@query(f"SELECT page_id, {_clean("html")} AS cleaned FROM pages")
def html_clean(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.clean("html").alias("cleaned"))


_LI = "SELECT page_id, unnest(l) AS item, unnest(range(len(l))) AS n FROM (SELECT page_id, regexp_extract_all(h, '<li>(.*?)</li>', 1, 's') AS l FROM p)"


@query(f"""WITH p AS (SELECT page_id, replace(replace(html, '<a href=', '<span class=''word''><a href='), '</a>', '</a></span><span class=''numb''> 7 </span>') AS h FROM pages), i AS ({_LI})
SELECT page_id, n::BIGINT AS n, {_clean("regexp_extract(item, 'class=''word''>(.*?)</span>', 1)")} AS word, trim(regexp_extract(item, 'class=''numb''>(.*?)</span>', 1), ' ') AS paradigm FROM i WHERE {_clean("regexp_extract(item, 'class=''word''>(.*?)</span>', 1)")} <> ''""")
def html_items(spark, sf_dir):
    """List items of pages as word list rows; markup of the word list is put around the pages' links."""
    marked = F.replace(F.replace("html", F.lit("<a href="), F.lit("<span class='word'><a href=")), F.lit("</a>"), F.lit("</a></span><span class='numb'> 7 </span>"))
    return ingest.parse_results(table(spark, sf_dir, "pages").select("page_id", marked.alias("html"))).select("page_id", *_long("n"), "word", "paradigm")


# Ingestion.


@query("""WITH r AS (SELECT source, lang, doc_id, n_chars, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS r FROM documents)
SELECT source, lang, doc_id, n_chars FROM r WHERE r = 1""")
def lang_first_match(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "lang", "doc_id", "n_chars")
    return ingest.first_match(docs, ("source", "lang"), "doc_id")


@query("""WITH r AS (SELECT source, lang, n_chars, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS r FROM documents),
f AS (SELECT source, lang, n_chars FROM r WHERE r = 1 AND n_chars % 2 = 0)
SELECT s.source, string_agg(f.lang || '=' || f.n_chars, ',' ORDER BY f.lang) AS translations FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN f ON s.source = f.source GROUP BY s.source""")
def ingest_complete(spark, sf_dir):
    """Stubs joined with the first row of each language; a first row that is empty leaves the language out."""
    docs = table(spark, sf_dir, "documents")
    results = docs.select(F.col("source").alias("word"), F.lit("").alias("paradigm"), "lang", F.col("doc_id").alias("n"), F.when(F.col("n_chars") % 2 == 0, F.array(F.col("n_chars").cast("string"))).otherwise(F.array().cast("array<string>")).alias("translations"))
    stubs = docs.select(F.col("source").alias("word"), F.lit("").alias("paradigm")).distinct()
    done = ingest.complete(stubs, results)
    told = F.array_join(F.transform(F.array_sort(F.map_entries("translations")), lambda e: F.concat(e["key"], F.lit("="), F.element_at(e["value"], 1))), ",")
    return done.select(F.col("word").alias("source"), F.nullif(told, F.lit("")).alias("translations"))


@query("SELECT d.doc_id, d.source FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id")
def ingest_antijoin(spark, sf_dir):
    return ingest.new_rows(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), ("doc_id",))


@query("SELECT doc_id FROM labels UNION SELECT doc_id FROM documents")
def ingest_union_dedupe(spark, sf_dir):
    return ingest.merge(table(spark, sf_dir, "labels").select("doc_id"), table(spark, sf_dir, "documents").select("doc_id"), ("doc_id",))


@query(f"SELECT a || b AS prefix FROM (SELECT unnest({ingest.ALPHABET!r}) AS a), (SELECT unnest({ingest.ALPHABET!r}) AS b)")
def prefix_cross(spark, sf_dir):
    return ingest.prefixes(spark)


_LEVELS = ", ".join(f"c{k} AS (SELECT substr(word, 1, {k}) AS prefix, count(*) AS n FROM entries {f'JOIN c{k - 1} ON c{k - 1}.prefix = substr(word, 1, {k - 1}) AND c{k - 1}.n >= 30' if k > 2 else ''} WHERE length(word) >= {k} GROUP BY 1)" for k in range(2, 7))


@query(f"WITH {L.SQL_ENTRIES}, {_LEVELS} " + " UNION ALL ".join(f"SELECT prefix, n FROM c{k}" for k in range(2, 7)))
def prefix_subdivide(spark, sf_dir):
    return ingest.subdivide(L.entries(spark, sf_dir))


@query("SELECT doc_id, doc_id // 32 AS batch, doc_id % 32 AS index FROM documents")
def batch_index(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") + 1).alias("rank"))
    return rerank.batched(docs).select("doc_id", "batch", "index")


_MEDIANS = """m AS (SELECT user_id % 50 AS key, event_id AS seq, list(value) OVER (PARTITION BY user_id % 50 ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS l, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS r FROM events),
n AS (SELECT key, seq, r, list_sort(l)[len(l) // 2 + 1] AS median FROM m),
b AS (SELECT *, max(CASE WHEN r = 20 THEN median END) OVER (PARTITION BY key) AS base FROM n)"""


def _times(spark, sf_dir):
    return table(spark, sf_dir, "events").select((F.col("user_id") % 50).cast("string").alias("key"), F.col("event_id").alias("seq"), F.col("value").alias("elapsed"))


@query(f"""WITH RECURSIVE {_MEDIANS}, d AS (
  SELECT key, r, 0.05e0 AS delay FROM b WHERE r = 1
  UNION ALL SELECT b.key, b.r, CASE WHEN b.r > 20 AND b.median / b.base > 2e0 THEN least(d.delay * 1.5e0, 2e0) WHEN b.r > 20 AND b.median / b.base < 1.3e0 AND d.delay > 0.05e0 THEN greatest(d.delay * 0.8e0, 0.05e0) ELSE d.delay END
  FROM d JOIN b ON b.key = d.key AND b.r = d.r + 1)
SELECT b.key::VARCHAR AS key, b.seq, b.median, CASE WHEN b.r >= 20 THEN b.base END AS baseline, round(d.delay, 9) AS delay FROM b JOIN d ON b.key = d.key AND b.r = d.r""")
def throttle_delay(spark, sf_dir):
    """Median of the last 20, baseline and adaptive delay of fifty streams of times."""
    return ingest.throttle(_times(spark, sf_dir)).select("key", "seq", "median", "baseline", F.round("delay", 9).alias("delay"))


# Conversations.

_MADE = "c AS (SELECT conv_id, turn, role, text, '<search query=\"' || role || '\" top_k=\"' || turn || '\" /> then <lookup word=\"w' || conv_id || '\" />' AS xml FROM conversations)"


@query(f"WITH {_MADE} SELECT conv_id, turn, 0::BIGINT AS n, 'search' AS name, role AS first, turn::VARCHAR AS second FROM c UNION ALL SELECT conv_id, turn, 1::BIGINT, 'lookup', 'w' || conv_id, NULL FROM c")
def tool_parse_xml(spark, sf_dir):
    made = F.concat(F.lit('<search query="'), "role", F.lit('" top_k="'), F.col("turn").cast("string"), F.lit('" /> then <lookup word="w'), F.col("conv_id").cast("string"), F.lit('" />'))
    calls = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(text.xml_calls(made)).alias("n", "c"))
    get = lambda k: F.try_element_at("c.arguments", F.lit(k))
    return calls.select("conv_id", "turn", *_long("n"), F.col("c.name").alias("name"), F.coalesce(get("query"), get("word")).alias("first"), get("top_k").alias("second"))


@query("SELECT conv_id, turn, 'find' AS name, role AS asked, 'tag' AS via FROM conversations WHERE turn % 2 = 0 UNION ALL SELECT conv_id, turn, 'find', role, 'bare' FROM conversations WHERE turn % 2 = 1")
def tool_parse_json(spark, sf_dir):
    bare = F.concat(F.lit('{"name": "find", "arguments": {"q": "'), "role", F.lit('"}}'))
    made = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("I call <tool_call>\n"), bare, F.lit("\n</tool_call> now"))).otherwise(F.concat(F.lit("say "), bare, F.lit(" end")))
    calls = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(text.tagged_calls(made)).alias("c"))
    return calls.select("conv_id", "turn", F.col("c.name").alias("name"), F.get_json_object("c.arguments", "$.q").alias("asked"), F.when(F.col("turn") % 2 == 0, "tag").otherwise("bare").alias("via"))


@query("SELECT conv_id, turn, 'find' AS name, role AS q, turn::VARCHAR AS k FROM conversations WHERE turn % 3 <> 2 UNION ALL SELECT conv_id, turn, NULL, NULL, NULL FROM conversations WHERE turn % 3 = 2")
def tool_parse_flexible(spark, sf_dir):
    k = F.col("turn").cast("string")
    made = F.when(F.col("turn") % 3 == 0, F.concat(F.lit('find(q="'), "role", F.lit('", k='), k, F.lit(")"))).when(F.col("turn") % 3 == 1, F.concat(F.lit('{"name": "find", "arguments": {"q": "'), "role", F.lit('", "k": '), k, F.lit("}}"))).otherwise("no call")
    call = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.flexible_call(made).alias("c"))
    return call.select("conv_id", "turn", F.col("c.name").alias("name"), F.get_json_object("c.arguments", "$.q").alias("q"), F.get_json_object("c.arguments", "$.k").alias("k"))


@query("SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS answer, CASE WHEN turn % 2 = 0 THEN 'to ' || role ELSE '' END AS translation FROM conversations")
def response_split(spark, sf_dir):
    made = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit(" [DE:  to "), "role", F.lit("]"))).otherwise(F.col("text"))
    r = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.split_response(made).alias("r"))
    return r.select("conv_id", "turn", "r.answer", "r.translation")


@query("""WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM conversations)
SELECT conv_id, turn, n::BIGINT AS n, trim(line, ' ') AS de, 'p' || n AS pr FROM l WHERE trim(line, ' ') <> '' AND NOT contains(line, ';') AND NOT starts_with(trim(line, ' '), 'ERGEBNIS')""")
def result_lines(spark, sf_dir):
    """Lines of texts as result pairs behind the mark."""
    made = F.concat(F.lit("thinking; no\nERGEBNIS:\n"), F.array_join(F.filter(F.transform(F.split("text", "\n"), lambda t, i: F.when((F.trim(t) != "") & ~F.contains(t, F.lit(";")), F.concat(t, F.lit(" ; p"), i.cast("string")))), lambda t: t.isNotNull()), "\n"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(text.result_lines(made, only_after_mark=True)).alias("p"))
    return rows.select("conv_id", "turn", F.substring("p.pr", 2, 9).cast("bigint").alias("n"), "p.de", "p.pr")


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history, count(*) AS turns FROM conversations GROUP BY conv_id")
def history_concat(spark, sf_dir):
    return chat.history(table(spark, sf_dir, "conversations"))


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


@query(f"""SELECT conv_id, turn, list_sort(list_distinct(list_filter(list_transform(string_split_regex(regexp_replace(text, '[.,!?;:"()\\[\\]{{}}]', ' ', 'g'), '\\s+'), lambda w: lower(w)), lambda w: length(w) > 1 AND NOT list_contains([{_STOP}], w)))) AS words FROM conversations""".replace("AS words", "::VARCHAR AS words").replace("list_sort(", "array_to_string(list_sort(").replace("::VARCHAR AS words", ", ' ') AS words"))
def content_words(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.sort_array(text.content_words("text")), " ").alias("words"))


@query("SELECT conv_id, string_agg(w, ',' ORDER BY n, w) AS words FROM (SELECT conv_id, role || length(text) % 3 AS w, min(turn) AS n FROM conversations WHERE role <> 'system' GROUP BY 1, 2) GROUP BY conv_id")
def used_words(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("n"), F.col("role").alias("name"), F.concat("role", (F.length("text") % 3).cast("string")).alias("word"))
    return chat.used_words(rows, ("user", "assistant")).select("conv_id", F.array_join("words", ",").alias("words"))


@query("""WITH r AS (SELECT conv_id, role AS call, turn, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS rank FROM conversations),
l AS (SELECT conv_id, call, rank, '  ' || turn || ' [' || length(text) || '] (' || role_ || ')' AS line FROM (SELECT *, call AS role_ FROM r) WHERE rank <= 5
  UNION ALL SELECT DISTINCT conv_id, call, 0, 'search "' || call || '":' FROM r)
SELECT conv_id, string_agg(line, chr(10) ORDER BY call, rank) AS context FROM l GROUP BY conv_id""")
def context_compact(spark, sf_dir):
    rank = F.row_number().over(W.partitionBy("conv_id", "role").orderBy("turn"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("role").alias("call"), F.col("role").alias("asked"), rank.alias("rank"), F.col("turn").cast("string").alias("word"), F.length("text").cast("string").alias("de"), F.col("role").alias("en"))
    return chat.context(rows)


@query("""WITH s AS (SELECT event_id, user_id, event_type, ts, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS start FROM events),
i AS (SELECT *, sum(start) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM s)
SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id)::BIGINT AS streak FROM i""")
def dup_streak(spark, sf_dir):
    return chat.repeats(table(spark, sf_dir, "events"), "user_id", "event_type", ("ts", "event_id")).select("event_id", "user_id", *_long("streak"))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def distinct_calls(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("n"), F.col("event_type").alias("name"), F.lit("{}").alias("arguments"))
    return chat.distinct_calls(calls).select(F.col("conv_id").alias("user_id"), F.col("name").alias("event_type"), F.col("n").alias("event_id"))


@query("SELECT conv_id, role AS idx, string_agg(text, '' ORDER BY turn) AS arguments, arg_max('call' || turn, turn) AS id FROM conversations GROUP BY conv_id, role")
def stream_assembly(spark, sf_dir):
    """Fragments of calls put together in order."""
    parts = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("stream_id"), F.col("role").alias("idx"), F.col("turn").alias("seq"), F.concat(F.lit("call"), F.col("turn").cast("string")).alias("id"), F.col("role").alias("name"), F.col("text").alias("arguments"))
    return chat.assemble_calls(parts).select(F.col("stream_id").alias("conv_id"), "idx", "arguments", "id")


@query("SELECT event_id, 'e' || event_type AS event, event_id AS value FROM events WHERE event_type <> 'error'")
def sse_parse(spark, sf_dir):
    """Frames of an event stream; those whose data is no JSON are left out."""
    data = F.when(F.col("event_type") == "error", "{broken").otherwise(F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit("}")))
    frames = table(spark, sf_dir, "events").select("event_id", F.explode(text.sse_events(F.concat(F.lit("event: e"), "event_type", F.lit("\r\ndata: "), data, F.lit("\r\n\r\n")))).alias("e"))
    return frames.select("event_id", "e.event", F.get_json_object("e.data", "$.id").cast("bigint").alias("value"))


@query("SELECT doc_id, 'W' || doc_id AS base_form, 'f pl' AS grammar, CASE WHEN doc_id % 2 = 0 THEN source || ' 61(' || doc_id || ')' END AS source, true AS is_form FROM documents")
def reference_desc_parse(spark, sf_dir):
    d = F.col("doc_id").cast("string")
    made = F.concat(F.lit("↑ W"), d, F.lit(" f pl"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" ["), "source", F.lit(" 61("), d, F.lit(")]"))).otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", text.reference_parts(made).alias("r")).select("doc_id", "r.*")


@query(f"""WITH {L.SQL_ENTRIES}, {L.SQL_INDEXES}, s AS (SELECT item_id AS qid, string_split_regex(trim(regexp_replace(translate(text, '.,', '  '), '\\s+', ' ', 'g')), ' ') AS l FROM benchmark),
t AS (SELECT qid, lower(unnest(l)) AS token, unnest(l) AS raw FROM s)
SELECT qid, count(*) AS missing FROM t WHERE length(raw) >= 2 AND token NOT IN (SELECT lemma FROM lemmas) AND token NOT IN (SELECT form FROM forms)
  AND translate(token, '{text.MACRONS}', '{text.PLAIN_VOWELS}') NOT IN (SELECT lemma_norm FROM lemmas) AND translate(token, '{text.MACRONS}', '{text.PLAIN_VOWELS}') NOT IN (SELECT form_norm FROM forms) GROUP BY qid""")
def validate_sentence(spark, sf_dir):
    """Tokens of benchmark items that the dictionary of the documents doesn't know, fuzzy matches aside."""
    _, lemmas, forms_ = L.dictionary(spark, sf_dir)
    tokens = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.posexplode(text.sentence_tokens("text")).alias("n", "token"))
    asked = tokens.select(F.col("token").alias("qid"), F.col("token").alias("word"), F.lit(False).alias("fuzzy")).distinct()
    found = lookup.lookup(asked, lemmas, forms_).select(F.col("qid").alias("token")).distinct()
    return tokens.join(found, "token", "left_anti").groupBy("qid").agg(F.count(F.lit(1)).alias("missing"))


@query(f"""WITH {L.SQL_ENTRIES}, {L.SQL_INDEXES}, s AS (SELECT item_id AS qid, string_split_regex(trim(regexp_replace(translate(text, '.,', '  '), '\\s+', ' ', 'g')), ' ') AS l FROM benchmark),
t AS (SELECT qid, unnest(l) AS token, unnest(range(len(l))) AS n FROM s),
u AS (SELECT DISTINCT token, translate(lower(token), '{text.MACRONS}', '{text.PLAIN_VOWELS}') AS norm FROM t WHERE length(token) >= 2),
f AS (SELECT token FROM u WHERE lower(token) NOT IN (SELECT lemma FROM lemmas) AND lower(token) NOT IN (SELECT form FROM forms) AND norm NOT IN (SELECT lemma_norm FROM lemmas) AND norm NOT IN (SELECT form_norm FROM forms)
  AND NOT EXISTS (SELECT 1 FROM lemmas WHERE abs(length(norm) - length(lemma_norm)) <= 2 AND {L.sql_distance('norm', 'lemma_norm')} <= 2))
SELECT item_id AS qid, i.issues IS NULL AS valid, coalesce(i.issues, '') AS issues FROM benchmark LEFT JOIN (SELECT qid, string_agg(token, ' ' ORDER BY n) AS issues FROM t JOIN f USING (token) GROUP BY qid) i ON item_id = i.qid""")
def validated_sentences(spark, sf_dir):
    """Benchmark items as sentences: valid if each token is found, also by a word near it, and else the tokens that aren't."""
    _, lemmas, forms_ = L.dictionary(spark, sf_dir)
    sentences = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("sentence"))
    return validate.validate(sentences, lemmas, forms_).select("qid", "valid", F.array_join("issues", " ").alias("issues"))


_ENTRY_JSON = """'"de":"' || de || '","en":"' || en || '"'"""
_GENDER_JSON = """CASE WHEN gender <> '' THEN ',"gender":"' || gender || '"' ELSE '' END"""


@query(f"""WITH {L.SQL_ENTRIES} SELECT pos AS qid, CASE pos % 4
  WHEN 0 THEN '[{{"word":"' || word || '",' || {_ENTRY_JSON} || {_GENDER_JSON} || '}}]'
  WHEN 1 THEN '{{"valid":' || CASE WHEN length(word) > 0 AND pos % 8 = 1 THEN 'true,"issues":[]' ELSE 'false,"issues":["zq0jxw1vk"]' END || '}}'
  WHEN 2 THEN '{{"lemma":"' || word || '","translations":{{' || {_ENTRY_JSON} || '}},"paradigm":"12"' || {_GENDER_JSON} || ',"forms":"' || replace('{{"declension":[{{"cases":[{{"singular":"' || word || '","plural":"' || word || 's"}}]}}]}}', '"', chr(92) || '"') || '"}}'
  ELSE '{{"error":"Unknown tool: translate"}}' END AS result FROM full_entries""")
def dispatched_calls(spark, sf_dir):
    """A call for each word of the dictionary, by the engine's dispatcher: lookups, sentences, records, and a tool that there isn't."""
    from ..engine import Engine
    from ..sources.connectors import hash_embedder

    rows, lemmas, forms_ = L.dictionary(spark, sf_dir)
    engine = Engine(rows, lemmas, forms_, rows.select("pos", F.array(F.lit(0.0), F.lit(1.0)).cast("array<float>").alias("embedding")), hash_embedder(2))
    kind = F.col("pos") % 4
    sentence = F.concat("word", F.when(F.col("pos") % 8 == 1, F.lit(".")).otherwise(F.lit(", zq0jxw1vk")))
    arguments = F.when(kind == 0, F.create_map(F.lit("word"), F.concat(F.lit(" "), F.col("word")), F.lit("fuzzy"), F.lit("false"))).when(kind == 1, F.create_map(F.lit("sentence"), sentence)).otherwise(F.create_map(F.lit("lemma"), F.col("word")))
    name = F.when(kind == 0, "lookup_word").when(kind == 1, "validate").when(kind == 2, "get_forms").otherwise("translate")
    return engine.dispatch(rows.select(F.col("pos").alias("qid"), name.alias("name"), arguments.alias("arguments")))


@query("SELECT count(*)::BIGINT AS entries, sum(length(text))::BIGINT AS chars, ceil(count(*) / 32e0)::BIGINT AS batches, true AS timed FROM documents")
def observed_batches(spark, sf_dir):
    """Count, sum and batches of a job, observed while its rows are written."""
    measure = Measure("documents")
    with measure.running():
        written(measure.of(table(spark, sf_dir, "documents"), chars=F.sum(F.length("text").cast("bigint"))), "observed")
    found = measure.result(32)
    return spark.createDataFrame([(found["rows"], found["chars"], found["batches"], found["seconds"] > 0 and found["rate"] > 0)], "entries bigint, chars bigint, batches bigint, timed boolean")


@query(f"WITH {L.SQL_ENTRIES}, t AS (SELECT conv_id, turn, lower(regexp_extract(text, '([A-Za-z]+)', 1)) AS token FROM conversations) SELECT conv_id, turn, token, coalesce(nullif(f.de, ''), token) AS gloss FROM t LEFT JOIN full_entries f ON t.token = f.word")
def gloss_tokens(spark, sf_dir):
    tokens = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("qid"), F.col("turn").alias("n"), F.lower(F.regexp_extract("text", "([A-Za-z]+)", 1)).alias("token"))
    hits = L.entries(spark, sf_dir).select(F.col("word").alias("token"), text.first_translation("translations", "miks").alias("de"), F.col("pos").alias("rank"))
    return chat.gloss(tokens, hits).select(F.col("qid").alias("conv_id"), F.col("n").alias("turn"), "token", "gloss")


@query(f"""SELECT item_id, {list(text.TOPICS)!r}[(item_id % 5 + 1)::INT] AS topic, 'In ' || CASE WHEN item_id % 2 = 0 THEN 'LT' ELSE 'DE' END || ': tools' AS prompt FROM benchmark""")
def prompts(spark, sf_dir):
    lang = F.when(F.col("item_id") % 2 == 0, "lt").otherwise("fr")
    return table(spark, sf_dir, "benchmark").select("item_id", text.topic("item_id").alias("topic"), text.render_prompt(F.lit("In {lang_code}: {tools}"), lang, F.lit("tools")).alias("prompt"))


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'lookup' WHEN 'click' THEN 'search' ELSE 'unknown' END AS tool,
  CASE event_type WHEN 'view' THEN 'L' || user_id WHEN 'click' THEN 'S' || user_id ELSE 'Unknown tool: ' || event_type END AS result FROM events""")
def tool_dispatch(spark, sf_dir):
    """Calls split by tool, each part through its operator, put together again."""
    calls = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("user_id").cast("string").alias("a"))
    part = lambda where, tool, result: calls.where(where).select("event_id", F.lit(tool).alias("tool"), result.alias("result"))
    found = part("event_type = 'view'", "lookup", F.concat(F.lit("L"), "a")).unionByName(part("event_type = 'click'", "search", F.concat(F.lit("S"), "a")))
    return found.unionByName(part("event_type NOT IN ('view', 'click')", "unknown", F.concat(F.lit("Unknown tool: "), "event_type")))


@query("""SELECT date_trunc('hour', ts) + INTERVAL (10 * (minute(ts) // 10)) MINUTE AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def event_windows(spark, sf_dir):
    """Ten-minute windows, the batch form of the streaming aggregate."""
    rows = table(spark, sf_dir, "events").withColumn("w", F.window("ts", "10 minutes"))
    return rows.groupBy("w", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("SELECT conv_id AS stream_id, turn, CASE WHEN role = 'assistant' THEN text ELSE '' END AS content, CASE WHEN role <> 'assistant' THEN text ELSE '' END AS reasoning FROM conversations")
def stream_content(spark, sf_dir):
    """Content and reasoning pieces put together by turn."""
    kind = F.when(F.col("role") == "assistant", "content").otherwise("reasoning")
    # pieces of six characters, all of the text
    pieces = F.posexplode(F.regexp_extract_all("text", F.lit(r"(?s)(.{1,6})"), F.lit(1))).alias("seq", "piece")
    deltas = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("stream_id"), "turn", kind.alias("kind"), pieces)
    return chat.assemble_content(deltas)


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'done' WHEN 'purchase' THEN 'tool_call_delta' WHEN 'click' THEN 'reasoning_delta' ELSE 'content_delta' END AS event_type FROM events""")
def event_routing(spark, sf_dir):
    is_ = lambda t: F.when(F.col("event_type") == t, F.lit("x"))
    rows = table(spark, sf_dir, "events").select("event_id", is_("error").alias("error"), is_("signup").alias("finish"), is_("purchase").alias("tool_call"), is_("click").alias("reasoning"), is_("view").alias("content"))
    return chat.routed(rows).select("event_id", "event_type")


@query("SELECT conv_id, turn, text || '</tool_call>' AS cut FROM conversations")
def stream_cut(spark, sf_dir):
    """What stands before the end of the first call."""
    made = F.concat(F.col("text"), F.lit("</tool_call>"), F.col("text"), F.lit("</tool_call>"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.stream_text(made).alias("cut"))


@query("SELECT page_id, NOT (contains(url, '..') OR contains(url, '/')) AS whole, NOT (contains(regexp_extract(url, '([^/]*)$', 1), '..') OR contains(regexp_extract(url, '([^/]*)$', 1), '/')) AS last FROM pages")
def safe_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", prompt_files.safe_name("url").alias("whole"), prompt_files.safe_name(F.regexp_extract("url", "([^/]*)$", 1)).alias("last"))


@query("SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM events")
def time_stamps(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", prompt_files.stamp("ts").alias("stamp"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN props WHEN event_id % 3 = 1 THEN '[' || props || ',' || event_id || ']' ELSE '[]' END AS content FROM events")
def json_unwrap(spark, sf_dir):
    """Content blocks: one is itself, several are an array."""
    block = lambda kind, x: F.struct(F.lit(kind).alias("type"), x.alias("text"))
    number = F.col("event_id").cast("string")
    made = F.when(F.col("event_id") % 3 == 0, F.array(block("text", F.col("props")), block("image", number))).when(F.col("event_id") % 3 == 1, F.array(block("text", F.col("props")), block("text", number))).otherwise(F.array(block("image", number)))
    return table(spark, sf_dir, "events").select("event_id", text.unwrap_blocks(made).alias("content"))


@query("""SELECT a.event_id AS id, b.event_id AS answer FROM events a JOIN events b ON b.event_id = a.event_id + 1 AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 30 SECONDS""")
def response_match(spark, sf_dir):
    """Requests joined with their responses by id within half a minute."""
    events = table(spark, sf_dir, "events")
    requests = events.select(F.col("event_id").alias("id"), F.col("ts").alias("sent"), F.col("event_type").alias("method"))
    responses = events.select((F.col("event_id") - 1).alias("id"), F.col("ts").alias("received"), F.col("event_id").alias("answer"))
    return chat.answered(requests, responses).select("id", "answer")


@query("SELECT count(*)::BIGINT AS entries, sum(length(text))::BIGINT AS chars, ceil(count(*) / 32e0)::BIGINT AS batches FROM documents")
def batch_statistics(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.agg(F.count(F.lit(1)).alias("entries"), F.sum(F.length("text").cast("bigint")).alias("chars"), F.ceil(F.count(F.lit(1)) / 32).alias("batches"))


@query("""SELECT '- search_dictionary(query: string, top_k: integer = 10, use_reranker: boolean = false): Semantic search; several related terms work best.' || chr(10)
  || '- lookup_word(word: string, fuzzy: boolean = true): Looks up a lemma or an inflected form.' || chr(10) || '- get_word_forms(lemma: string): All inflected forms of a lemma.' AS tools""")
def tool_prompt(spark, sf_dir):
    return chat.tool_descriptions(prompt_files.tool_table(spark))


@query("""WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM conversations)
SELECT conv_id, turn, trim(line, ' ') AS de, 'xyz' AS pr FROM l WHERE NOT contains(line, ';') AND length(trim(line, ' ')) > 2 AND NOT regexp_matches(lower(line), 'beispiel|example') AND NOT starts_with(trim(line, ' '), 'ERGEBNIS')""")
def result_lines_loose(spark, sf_dir):
    """The fallback for responses without a mark."""
    made = F.array_join(F.transform(F.filter(F.split("text", "\n"), lambda t: ~F.contains(t, F.lit(";"))), lambda t: F.concat(t, F.lit(";xyz"))), "\n")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(text.loose_result_lines(made)).alias("p"))
    return rows.select("conv_id", "turn", "p.de", "p.pr")


# Entries made of the embeddings table, for the operators that read entries and vectors together.

_KINDS = ("pn", "prp", "crd", "av", "aj", "n", "pc", "ij", "xx", "")
_VECTOR_ENTRIES = """
raw AS (SELECT vec_id AS pos, 'w' || vec_id AS word, ['pn', 'prp', 'crd', 'av', 'aj', 'n', 'pc', 'ij', 'xx', ''][(label + 1)::INT] AS wt,
  CASE WHEN label % 3 = 0 THEN 'm' ELSE '' END AS gender, CASE WHEN label % 4 = 1 THEN 'D' || vec_id % 7 ELSE '' END AS de, CASE WHEN label % 4 = 2 THEN 'E' || vec_id ELSE '' END AS en, label FROM embeddings),
v AS (SELECT *, concat_ws(' | ', nullif(de, ''), nullif(en, '')) AS multilang, word || ' [' || wt || ']: ' || de || ' | ' || en || ' |  | ' AS evaluation,
  concat_ws(' ', word, CASE WHEN wt <> '' THEN '[' || wt || ']' END, CASE WHEN gender <> '' THEN '(' || gender || ')' END, ': ' || de, CASE WHEN en <> '' THEN '| ' || en END) AS line,
  CASE wt WHEN 'pn' THEN 5e0 WHEN 'prp' THEN 4.5e0 WHEN 'crd' THEN 4e0 WHEN 'av' THEN 3.5e0 WHEN 'aj' THEN 3e0 WHEN 'n' THEN 3e0 WHEN 'pc' THEN 2.5e0 WHEN 'ij' THEN 0.1e0 ELSE 1e0 END AS weight FROM raw)"""


def _vector_entries(spark, sf_dir):
    """An entry for each vector: of four labels one has no translations, one a German, one an English, one an empty list."""
    p, label = F.col("vec_id"), F.col("label")
    one = lambda lang, *x: F.create_map(F.lit(lang), F.array(*x).cast("array<string>"))
    maps = (
        F.when(label % 4 == 1, one("miks", F.concat(F.lit("D"), (p % 7).cast("string")))).when(label % 4 == 2, one("engl", F.concat(F.lit("E"), p.cast("string")), F.lit("x")))
        .when(label % 4 == 3, one("miks")).otherwise(F.create_map().cast("map<string,array<string>>"))
    )
    kind = F.element_at(F.array(*[F.lit(x) for x in _KINDS]), label + 1)
    gender = F.when(label % 3 == 0, "m").otherwise("")
    return table(spark, sf_dir, "embeddings").select(p.alias("pos"), F.concat(F.lit("w"), p.cast("string")).alias("word"), kind.alias("desc"), gender.alias("gender"), maps.alias("translations"))


@query(f"""WITH {_SCORED}, {_VECTOR_ENTRIES}, near AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos DESC) AS r FROM scored),
kept AS (SELECT n.qid, n.pos, v.word, v.de, v.en, row_number() OVER (PARTITION BY qid ORDER BY n.score DESC, n.pos DESC) AS rank FROM near n JOIN v ON n.pos = v.pos WHERE r <= 10 AND v.label % 4 <> 0)
SELECT qid, rank::BIGINT AS rank, pos, word, de, en FROM kept WHERE rank <= 5""")
def search_hits(spark, sf_dir):
    """Search as callers use it: twice k nearest, those with a translations map that isn't empty, k of them."""
    queries, rows = _vectors(spark, sf_dir)
    return search.search(queries, rows, _vector_entries(spark, sf_dir), 5, decimals=6).select("qid", *_long("rank"), "pos", "word", "de", "en")


@query(f"""WITH {_SCORED}, {_VECTOR_ENTRIES}, near AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos DESC) AS r FROM scored),
kept AS (SELECT n.qid, v.*, row_number() OVER (PARTITION BY qid ORDER BY n.score DESC, n.pos DESC) AS rank FROM near n JOIN v ON n.pos = v.pos WHERE r <= 60 AND v.label % 4 <> 0),
s AS (SELECT *, ((length(multilang) * 7 + qid) % 11)::DOUBLE AS rel FROM (SELECT * FROM kept WHERE rank <= 30)),
b AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, rank) AS new_rank FROM s)
SELECT qid, new_rank::BIGINT AS rank, word, de, en, rel AS rerank_score, wt AS word_type FROM b WHERE new_rank <= 10""")
def two_stage_hits(spark, sf_dir):
    """Search for more hits than wanted, then a reranker that stands in for a model, then the cut."""
    queries, rows = _vectors(spark, sf_dir)
    entries = _vector_entries(spark, sf_dir)
    asked = queries.select("qid", F.col("qid").cast("string").alias("query"))

    def scorer(q: str, docs: list[str]) -> list[tuple[int, float]]:
        return [(i, float((len(d) * 7 + int(q)) % 11)) for i, d in enumerate(docs)]

    best = rerank.two_stage(search.search(queries, rows, entries, 30, decimals=6), entries, asked, scorer, 10, 30, 8)
    return best.select("qid", *_long("rank"), "word", "de", "en", "rerank_score", "word_type")


@query(f"WITH {_VECTOR_ENTRIES} SELECT pos, wt AS word_type, round(((length(line) * 7 + 5) % 101) * weight, 6) AS rerank_score FROM v WHERE label % 4 IN (1, 2)")
def corpus_rerank(spark, sf_dir):
    """All entries with a German or English translation against one query, weighted by word type."""
    scored = rerank.rerank_corpus(_vector_entries(spark, sf_dir), "house", lambda q, docs: [(i, float((len(d) * 7 + len(q)) % 101)) for i, d in enumerate(docs)])
    return scored.select("pos", "word_type", F.round("rerank_score", 6).alias("rerank_score"))


@query(f"""WITH {_VECTOR_ENTRIES}, s AS (SELECT r_name AS category, v.pos, v.word, ((length(evaluation) * 7 + length(r_name)) % 101) * weight AS score FROM v, region WHERE label % 4 IN (1, 2)),
b AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, pos) AS rank FROM s) SELECT category, rank::BIGINT AS rank, word, round(score, 6) AS rerank_score FROM b WHERE rank <= 20""")
def corpus_best(spark, sf_dir):
    """The best entries of the whole corpus for each question."""
    asked = table(spark, sf_dir, "region").select(F.col("r_name").alias("category"), F.col("r_name").alias("query"))
    best = evaluate.corpus_top(_vector_entries(spark, sf_dir), asked, lambda q, docs: [(i, float((len(d) * 7 + len(q)) % 101)) for i, d in enumerate(docs)])
    return best.select("category", *_long("rank"), "word", F.round("rerank_score", 6).alias("rerank_score"))


@query(f"""WITH {_VECTOR_ENTRIES}, p AS (SELECT pos, concat_ws('; ', CASE WHEN en <> '' THEN 'English: ' || en || ', x' END, CASE WHEN de <> '' THEN 'German: ' || de END) AS passage FROM v WHERE de <> '' OR en <> '')
SELECT pos, length(passage)::DOUBLE AS size, (length(passage) - length(replace(passage, 'e', '')))::DOUBLE AS es FROM p""")
def embedded_entries(spark, sf_dir):
    """Vectors of the passages of the entries that have a translation, by an embedder that stands in for a model."""
    rows = embed.build(_vector_entries(spark, sf_dir), lambda texts: np.array([[len(t), t.count("e")] for t in texts], np.float32).reshape(-1, 2))
    return rows.select("pos", F.col("embedding")[0].cast("double").alias("size"), F.col("embedding")[1].cast("double").alias("es"))


@query("SELECT doc_id, length(text)::DOUBLE AS size, 1e0 AS one FROM documents")
def embedded_column(spark, sf_dir):
    """A text column through an embedding function, in batches."""
    docs = embed_column(table(spark, sf_dir, "documents"), "text", lambda texts: np.array([[len(t), 1] for t in texts], np.float32).reshape(-1, 2))
    return docs.select("doc_id", F.col("embedding")[0].cast("double").alias("size"), F.col("embedding")[1].cast("double").alias("one"))


@query(f"WITH {L.SQL_ENTRIES} SELECT pos, word || ',' || word || 's' AS forms FROM entries")
def entry_forms(spark, sf_dir):
    """The distinct forms of each entry's inflection tables."""
    rows = L.entries(spark, sf_dir).select("pos", F.from_json("forms_json", entry_files.FORMS).alias("forms"))
    return rows.select("pos", F.array_join(index.form_list(), ",").alias("forms"))


_ENUMERATED = """pre AS (SELECT word, k, left(word, k) AS prefix FROM entries, (SELECT unnest(range(2, 7)) AS k) WHERE length(word) >= k),
counted AS (SELECT *, count(*) OVER (PARTITION BY prefix) AS c, row_number() OVER (PARTITION BY prefix ORDER BY word COLLATE "C") AS r FROM pre),
open AS (SELECT *, coalesce(min(c) OVER (PARTITION BY word ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 30) AS above FROM counted)"""


@query(f"WITH {L.SQL_ENTRIES}, {_ENUMERATED} SELECT DISTINCT word FROM open WHERE above >= 30 AND r <= 30")
def enumerated_words(spark, sf_dir):
    """Words that a source which shows thirty of a prefix gives away, asked with ever longer prefixes."""
    words = written(L.entries(spark, sf_dir).select("word", F.lit("1").alias("paradigm"), F.lit("n").alias("desc")), "source-words")
    letters = sorted("abcdefghijklmnopqrstuvwxyz" + L.ACCENTS)
    shown = words.withColumn("prefix", F.explode(F.transform(F.filter(F.sequence(F.lit(2), F.lit(6)), lambda k: F.length("word") >= k), lambda k: F.substring(F.col("word"), F.lit(1), k))))
    shown = written(shown.withColumn("n", F.row_number().over(W.partitionBy("prefix").orderBy("word"))).where("n <= 30").drop("n"), "source-answers")
    found, _ = ingest.enumerate_words(ingest.prefixes(spark, letters), lambda asked: asked.join(shown, "prefix"), words.limit(0), letters)
    return found.select("word")


def _scratch(spark, name):
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT n_name AS word, n_regionkey::VARCHAR AS paradigm, 'n' AS \"desc\", CASE WHEN n_regionkey % 2 = 0 THEN 'T' || n_nationkey END AS translation FROM nation")
def word_list_files(spark, sf_dir):
    """A word list written in two parts, by group, and read again; a list that isn't there has no rows."""
    made = F.when(F.col("n_regionkey") % 2 == 0, F.array(F.concat(F.lit("T"), F.col("n_nationkey").cast("string")))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("word"), F.col("n_regionkey").cast("string").alias("paradigm"), F.lit("n").alias("desc"), made.alias("translations_engl"), (F.col("n_nationkey") % 3).alias("part"))
    path = _scratch(spark, "word-list")
    entry_files.write_json(rows.where("part = 0"), path, by="part")
    entry_files.write_json(rows.where("part <> 0"), path, "append", by="part")
    read = entry_files.read_or_empty(spark, path, entry_files.WORDLIST).drop("part").unionByName(entry_files.read_or_empty(spark, path + "-none", entry_files.WORDLIST))
    return read.select("word", "paradigm", "desc", F.get("translations_engl", F.lit(0)).alias("translation"))


@query("""SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS pos, n_name AS word, 'n' AS "desc", 'D' || n_regionkey AS de, '{"declension":[{"cases":[{"singular":"' || n_name || '"}]}]}' AS forms_json FROM nation""")
def entry_document(spark, sf_dir):
    """Entries from one JSON document, with their places in it; the table of nations is small by nature."""
    cases = F.struct(F.array(F.struct(F.array(F.struct(F.col("n_name").alias("singular"))).alias("cases"))).alias("declension"))
    one = F.struct(F.col("n_name").alias("word"), F.lit("n").alias("desc"), F.create_map(F.lit("miks"), F.array(F.concat(F.lit("D"), F.col("n_regionkey").cast("string")))).alias("translations"), cases.alias("forms"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", F.to_json(one).alias("e")))), lambda x: x["e"])
    whole = table(spark, sf_dir, "nation").agg(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")).alias("value"))
    path = _scratch(spark, "entries")
    whole.coalesce(1).write.text(path)
    read = entry_files.read_entries(spark, path)
    return read.select("pos", "word", "desc", text.first_translation("translations", "miks").alias("de"), "forms_json")


@query("SELECT 'complete' AS phase, (SELECT string_agg(n_name, ',' ORDER BY n_name) FROM nation) AS done, count(*) AS words FROM nation")
def saved_state(spark, sf_dir):
    """The state of an ingest, saved and read again."""
    names = [r.n_name for r in table(spark, sf_dir, "nation").orderBy("n_name").collect()]  # 25 rows
    path = _scratch(spark, "state")
    entry_files.write_state(spark, path, {"phase": "complete", "done_prefixes": names, "completed_words": len(names)})
    state = entry_files.state_row(spark, path)
    return spark.createDataFrame([(state["phase"], ",".join(state["done_prefixes"]), state["completed_words"])], "phase string, done string, words bigint")


@query("SELECT event_id, 'event: ' || event_type || chr(10) || 'data: {\"id\":' || event_id || '}' || chr(10) || chr(10) AS frame FROM events")
def sse_output(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("event"), F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit("}")).alias("data"))
    framed = entry_files.sse_frames(rows.select("event", "data", "event_id"))
    return framed.select(F.regexp_extract("value", r'"id":(\d+)', 1).cast("bigint").alias("event_id"), F.col("value").alias("frame"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type END AS content, CASE WHEN event_id % 2 = 1 THEN event_type END AS reasoning FROM events")
def completion_parts(spark, sf_dir):
    """Deltas of completion streams; broken data and what follows the end are left out."""
    name = F.when(F.col("event_id") % 2 == 0, "content").otherwise("reasoning_content")
    made = F.concat(F.lit('data: {broken\n\ndata: {"choices":[{"delta":{"'), name, F.lit('":"'), "event_type", F.lit('"}}]}\n\ndata: [DONE]\n\n'))
    rows = table(spark, sf_dir, "events").select("event_id", F.explode(text.completion_deltas(made)).alias("d"))
    return rows.select("event_id", "d.content", "d.reasoning")


@query("""SELECT event_id, '{"id":"chatcmpl-' || event_id || '","object":"chat.completion","model":"' || event_type || '","choices":[{"index":0,"message":{"role":"assistant","content":"' || event_type || '","tool_calls":[]},"finish_reason":"stop"}],"usage":'
  || CASE WHEN event_id % 2 = 0 THEN '{"prompt_tokens":' || user_id || ',"completion_tokens":1,"total_tokens":' || (user_id + 1) || '}' ELSE '{}' END || '}' AS answer FROM events""")
def completion_envelopes(spark, sf_dir):
    tokens = F.when(F.col("event_id") % 2 == 0, F.col("user_id"))
    made = text.completion(F.col("event_id").cast("string"), F.col("event_type"), F.col("event_type"), F.lit("stop"), tokens, F.lit(1).cast("bigint"))
    return table(spark, sf_dir, "events").select("event_id", made.alias("answer"))


@query("""SELECT doc_id, CASE lang WHEN 'de' THEN 'Quelle ' || source WHEN 'en' THEN 'Quelle ' || source ELSE 'Saltinis ' || source || ' {source}' END AS told,
  replace(replace(source || '<i>', '<', '&lt;'), '>', '&gt;') || '<br>' || lang AS shown FROM (SELECT doc_id, source, lang FROM documents)""")
def reader_messages(spark, sf_dir):
    """Messages in the reader's language with a variable, and text as markup shows it."""
    messages = {"de": {"source": "Quelle {source}"}, "lt": {"source": "Saltinis {source} {source}"}}
    told = text.message(messages, text.reader_language(F.col("lang")), F.lit("source"), {"source": F.col("source")})
    shown = text.broken_lines(F.concat(text.shown(F.concat("source", F.lit("<i>"))), F.lit("\n"), F.col("lang")))
    return table(spark, sf_dir, "documents").select("doc_id", told.alias("told"), shown.alias("shown"))


@query("""SELECT doc_id, printf('%2d', (doc_id % 120)::INT) || '. ' || rpad(source || lang, greatest(20, length(source || lang))::INT, ' ') || ' [' || rpad('n ' || lang, 10, ' ') || '] ' || rpad(left(source, 40), 40, ' ') || ' | ' || printf('%.4f', n_chars / 8e0) AS line FROM documents""")
def result_rows(spark, sf_dir):
    """Printed lists of results."""
    line = text.result_row((F.col("doc_id") % 120).cast("int"), F.concat("source", "lang"), F.lit("n"), F.col("lang"), F.col("source"), F.col("n_chars") / 8)
    return table(spark, sf_dir, "documents").select("doc_id", line.alias("line"))


@query(f"""WITH {L.SQL_ENTRIES} SELECT word, 'http://words/?s=' || url_encode(word) || '&language=engl&dia=d' AS asked, word || '|12|' || kind || '|d' AS form FROM full_entries""")
def word_requests(spark, sf_dir):
    """The addresses that ask for words, and the form fields that ask for their inflection tables."""
    rows = L.entries(spark, sf_dir).select("word", "paradigm", "desc")
    asked = ingest.search_requests(rows.select(F.col("word").alias("prefix")), "http://words", "d").select(F.col("prefix").alias("word"), F.col("url").alias("asked"))
    form = ingest.form_requests(rows, "http://words/more", "d").select("word", F.array_join(F.transform(F.array(*[F.lit(x) for x in ("word", "numb", "desc", "dia")]), lambda k: F.element_at("form", k)), "|").alias("form"))
    return asked.join(form, "word")


@query("""WITH w AS (SELECT DISTINCT lower(n_name) AS word FROM nation) SELECT word, 'T' || word AS translation FROM w""")
def trial_run(spark, sf_dir):
    """The trial run on the words of a small table: searched, kept where equal, completed."""
    words = tuple(r.w for r in table(spark, sf_dir, "nation").select(F.lower("n_name").alias("w")).collect())  # 25 rows
    listed = lambda asked: asked.select(F.explode(F.array(F.col("word"), F.concat("word", F.lit("s")))).alias("found"), "word").select(F.col("found").alias("word"), F.lit("1").alias("paradigm"), F.col("word").alias("asked"))
    results = lambda stubs: stubs.select("word", "paradigm", F.lit("miks").alias("lang"), F.lit(0).alias("n"), F.array(F.concat(F.lit("T"), "word")).alias("translations"))
    return ingest.trial(listed, results, spark, words).select("word", text.first_translation("translations", "miks").alias("translation"))
