"""A dictionary made from the test documents, as DataFrames and as SQL, on which the dictionary operators are shown.

Words are the documents' tokens in lower case whose letters fold to a-z; their position is the place of
their first occurrence.  Translations, types and forms are composed from the word and its position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import index
from ..sources.scratch import written

ACCENTS, BASE = "äöüáéíóúàèêçñß", "aouaeiouaeecns"


#: The oracle's edit distance counts bytes; so each letter beyond ASCII that words have becomes one of these, which they don't have.
_SINGLE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def sql_distance(a: str, b: str) -> str:
    """Edit distance in letters, in SQL."""
    beyond = ACCENTS + text.MACRONS
    single = lambda x: f"translate({x}, '{beyond}', '{_SINGLE[: len(beyond)]}')"
    return f"levenshtein({single(a)}, {single(b)})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _word(token: str) -> Column:
    return F.lower(F.regexp_replace(token, "[.,;:!?]", ""))


def _is_word(word: str) -> Column:
    return F.translate(word, ACCENTS, BASE).rlike("^[a-z]+$")


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", r"[ \n\t\r]+")).alias("i", "token"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, i and word of every document token that is a word."""
    return _raw(spark, sf_dir).select("doc_id", "i", _word("token").alias("word")).where(_is_word("word"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    # tokens are cleaned once each, not at each occurrence
    raw = _raw(spark, sf_dir).groupBy("token").agg(F.min(F.col("doc_id") * 1000000 + F.col("i")).alias("pos"))
    words = raw.select(_word("token").alias("word"), "pos").where(_is_word("word")).groupBy("word").agg(F.min("pos").alias("pos"))
    miks = F.when(F.col("pos") % 3 != 0, F.array(F.concat(F.lit("D"), "word"))).otherwise(F.array().cast("array<string>"))
    engl = F.when(F.col("pos") % 2 == 0, F.array(F.reverse("word"), F.concat("word", F.lit("x")))).otherwise(F.array().cast("array<string>"))
    kind = F.element_at(F.array(F.lit("n m"), F.lit("av"), F.lit("PN pl"), F.lit("↑ ref")), (F.col("pos") % 4 + 1).cast("int"))
    forms = F.concat(F.lit('{"declension":[{"cases":[{"singular":"'), "word", F.lit('","plural":"'), "word", F.lit('s"}]}]}'))
    return words.select(
        "pos", "word", F.element_at(F.array(F.lit("m"), F.lit("f"), F.lit("")), (F.col("pos") % 3 + 1).cast("int")).alias("gender"), kind.alias("desc"),
        F.create_map(F.lit("miks"), miks, F.lit("engl"), engl).alias("translations"), forms.alias("forms_json"), F.lit("12").alias("paradigm"),
    )


def form_rows(rows: DataFrame) -> DataFrame:
    """pos, word and two forms of each entry."""
    return rows.select("pos", "word", F.explode(F.array(F.col("word"), F.concat("word", F.lit("s")))).alias("form"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, word: the first word of each benchmark item, changed so that every lookup stage is used."""
    first = F.lower(F.regexp_replace(F.get(F.split("text", r"[ \n\t\r]+"), F.lit(0)), "[.,;:!?]", ""))
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), first.alias("w"))
    long = F.translate("w", text.PLAIN_VOWELS, text.MACRONS)
    word = (
        F.when(F.col("qid") % 5 == 0, F.concat(F.lit(" "), F.upper("w"), F.lit(" "))).when(F.col("qid") % 5 == 1, F.concat("w", F.lit("s")))
        .when(F.col("qid") % 5 == 2, long).when(F.col("qid") % 5 == 3, F.concat(long, F.lit("s"))).otherwise(F.concat(F.col("w").substr(1, 2), F.lit("q"), F.substring("w", 3, 100)))
    )
    return rows.select("qid", word.alias("word"), F.lit(True).alias("fuzzy"))


def lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lemma index, for queries that read it once."""
    return index.lemma_index(entries(spark, sf_dir))


def indexes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lemma and form index of written entries, written once for the several stages that read them."""
    return written(index.lemma_index(rows), "lemmas"), written(index.form_index(form_rows(rows)), "forms")


def dictionary(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries and both indexes; the documents are read once."""
    rows = written(entries(spark, sf_dir), "entries")
    return rows, *indexes(rows)


SQL_ENTRIES = f"""
toks AS (
  SELECT doc_id, lower(regexp_replace(t, '[.,;:!?]', '', 'g')) AS word, i - 1 AS i FROM (
    SELECT doc_id, unnest(l) AS t, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split_regex(text, '[ \\n\\t\\r]+') AS l FROM documents))),
words AS (
  SELECT doc_id, i, word FROM toks WHERE regexp_full_match(translate(word, '{ACCENTS}', '{BASE}'), '[a-z]+')),
entries AS (
  SELECT min(doc_id * 1000000 + i)::BIGINT AS pos, word, count(*) AS n FROM words GROUP BY word),
full_entries AS (
  SELECT *, ['m', 'f', ''][(pos % 3 + 1)::INT] AS gender, ['n m', 'av', 'PN pl', '↑ ref'][(pos % 4 + 1)::INT] AS kind,
    CASE WHEN pos % 3 <> 0 THEN 'D' || word ELSE '' END AS de, CASE WHEN pos % 2 = 0 THEN reverse(word) ELSE '' END AS en FROM entries)"""

SQL_INDEXES = f"""
lemmas AS (SELECT lower(word) AS lemma, pos, translate(lower(word), '{text.MACRONS}', '{text.PLAIN_VOWELS}') AS lemma_norm FROM entries),
form_rows AS (SELECT pos, word AS lemma, word AS form FROM entries UNION ALL SELECT pos, word, word || 's' FROM entries),
forms AS (SELECT form, arg_min(lemma, pos) AS lemma, min(pos) AS form_pos, translate(form, '{text.MACRONS}', '{text.PLAIN_VOWELS}') AS form_norm FROM form_rows GROUP BY form)"""

SQL_ASKED = f"""
firsts AS (SELECT item_id AS qid, lower(regexp_replace(string_split_regex(text, '[ \\n\\t\\r]+')[1], '[.,;:!?]', '', 'g')) AS w FROM benchmark),
asked AS (
  SELECT qid, CASE qid % 5 WHEN 0 THEN w WHEN 1 THEN w || 's' WHEN 2 THEN translate(w, '{text.PLAIN_VOWELS}', '{text.MACRONS}')
    WHEN 3 THEN translate(w, '{text.PLAIN_VOWELS}', '{text.MACRONS}') || 's' ELSE substr(w, 1, 2) || 'q' || substr(w, 3) END AS key FROM firsts),
keyed AS (SELECT qid, key, translate(key, '{text.MACRONS}', '{text.PLAIN_VOWELS}') AS norm FROM asked)"""


def sql_score(q: str, c: str, d: str) -> str:
    """The fuzzy score in SQL, of two words and their distance."""
    return f"""(10e0 - 3e0 * {d} + CASE WHEN length({q}) >= 3 AND length({c}) >= 3 AND left({q}, 3) = left({c}, 3) THEN 6e0 ELSE 0e0 END
    + greatest(0, 5 - abs(length({q}) - length({c}))) + CASE WHEN contains({c}, {q}) THEN 2e0 * length({q}) WHEN contains({q}, {c}) THEN 2e0 * length({c}) ELSE 0e0 END
    + 0.5e0 * coalesce(list_position(list_transform(range(1, least(length({q}), length({c})) + 1), lambda i: substr({q}, i, 1) = substr({c}, i, 1)), false) - 1, least(length({q}), length({c})))
    + CASE WHEN length({q}) >= 2 AND length({c}) >= 2 AND right({q}, 2) = right({c}, 2) THEN 4e0 ELSE 0e0 END
    + CASE WHEN length({q}) >= 3 AND length({c}) >= 3 AND right({q}, 3) = right({c}, 3) THEN 6e0 ELSE 0e0 END)"""
