"""The lookup tools as SQL table functions, over the engine's views.

    SELECT a.qid, h.* FROM asked a, LATERAL lookup_word(a.word) h
    SELECT * FROM word_record('semme')

They are SQL functions, so a batch of words becomes joins with the indexes, not a call for each; the stages are those of
``lookup.lookup`` but the fuzzy one.  Null finds nothing.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..functions import text

_KEY = "lower(regexp_replace(asked, '(?U)^\\\\s+|\\\\s+$', ''))"
_NORM = f"translate({_KEY}, '{text.MACRONS}', '{text.PLAIN_VOWELS}')"
_FIRST = "coalesce(get(try_element_at({0}.translations, '{1}'), 0), '')"

#: All hits of the four equal stages.
HITS = f"""CREATE OR REPLACE TEMPORARY FUNCTION lookup_hits(asked STRING)
RETURNS TABLE(stage INT, lemma STRING, pos BIGINT, matched_form STRING, rank_pos BIGINT) RETURN
  SELECT 1, lemma, pos, lemma, first_pos FROM lemma_index WHERE lemma = {_KEY}
  UNION ALL SELECT 2, l.lemma, l.pos, f.form, l.first_pos FROM form_index f JOIN lemma_index l ON f.lemma = l.lemma WHERE f.form = {_KEY}
  UNION ALL SELECT 3, lemma, pos, lemma, first_pos FROM lemma_index WHERE lemma_norm = {_NORM}
  UNION ALL SELECT 4, l.lemma, l.pos, min_by(f.form, struct(f.form_pos, f.form)), min(f.form_pos) FROM form_index f JOIN lemma_index l ON f.lemma = l.lemma
    WHERE f.form_norm = {_NORM} GROUP BY l.lemma, l.pos"""

#: Those of the first stage that finds any, described.
LOOKUP = f"""CREATE OR REPLACE TEMPORARY FUNCTION lookup_word(asked STRING)
RETURNS TABLE(rank INT, stage INT, pos BIGINT, word STRING, de STRING, en STRING, gender STRING, matched_form STRING) RETURN
  SELECT h.rank, h.stage, h.pos, e.word, {_FIRST.format('e', 'miks')}, {_FIRST.format('e', 'engl')}, nullif(e.gender, ''), CASE WHEN h.matched_form <> lower(e.word) THEN h.matched_form END
  FROM (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY rank_pos, lemma) AS rank, min(stage) OVER () AS first FROM lookup_hits(asked)) h
  JOIN entries e ON h.pos = e.pos WHERE h.stage = h.first"""

#: The record of the first of them.
RECORD = f"""CREATE OR REPLACE TEMPORARY FUNCTION word_record(asked STRING)
RETURNS TABLE(lemma STRING, de STRING, en STRING, paradigm STRING, gender STRING, forms STRING) RETURN
  SELECT h.word, h.de, h.en, coalesce(e.paradigm, ''), h.gender, coalesce(e.forms_json, '{{}}')
  FROM lookup_word(asked) h JOIN entries e ON h.pos = e.pos WHERE h.rank = 1"""


def register(spark: SparkSession) -> None:
    """The functions, over the session's views entries, lemma_index and form_index."""
    for statement in (HITS, LOOKUP, RECORD):
        spark.sql(statement)
