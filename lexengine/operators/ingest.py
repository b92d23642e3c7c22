"""Resumable ingestion: prefixes, parsed result pages, known keys, language joins, status."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..functions.pace import LEAST, MOST, WINDOW, Pace, paced
from ..sources.scratch import written

# Fixed values of the word list's source.
ALPHABET = sorted("abdeghijklmnoprstuwzāēīōūšž")
RESULT_CAP = 30
MAX_DEPTH = 6
KEY = ("word", "paradigm", "desc")
LANGUAGES = ("engl", "miks", "leit", "latt", "pols", "mask")
# The markup of its result pages.
ITEM = r"(?s)<li>(.*?)</li>"
WORD = r"class='word'>(.*?)</span>"
NUMBER = r"class='numb'>(.*?)</span>"
GENDER = r'class="gend">(.*?)</span>'
DESCRIPTION = r"class='desc'>(.*?)</span>"
AUDIO = r"src='(/upload/audio/[^']+)'"
TRANSLATION = r"class='translation-child'>.*?class='translation-number'>\d+</span>\s*(.*?)</span>"
NOTE = r'(?s)<div class="descripcio">(.*?)</div>\s*</div>'


def prefixes(spark: SparkSession, alphabet: list[str] | None = None) -> DataFrame:
    """All two-letter prefixes."""
    letters = spark.createDataFrame([(x,) for x in alphabet or ALPHABET], "letter string")
    return letters.crossJoin(F.broadcast(letters.withColumnRenamed("letter", "second"))).select(F.concat("letter", "second").alias("prefix"))


def remaining(all_prefixes: DataFrame, done: DataFrame) -> DataFrame:
    return all_prefixes.join(done.select("prefix"), "prefix", "left_anti")


def subdivide(words: DataFrame, start: int = 2, cap: int = RESULT_CAP, depth: int = MAX_DEPTH) -> DataFrame:
    """prefix and n of the prefixes that a capped source has to be asked for.

    A prefix with ``cap`` results or more is asked again with one letter more, down to ``depth`` letters.
    A longer prefix never has more results than a shorter one of it, so the next shorter one decides, and one
    aggregation over the words' prefixes serves all levels.
    """
    words = words.select("word").where(F.length("word") >= start).distinct()
    lengths = F.sequence(F.lit(start), F.least(F.length("word"), F.lit(depth)))
    cut = words.select(F.explode(F.transform(lengths, lambda k: F.left("word", k))).alias("prefix"))
    # written, as each prefix is held against its shorter one
    counts = written(cut.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")), "prefix-counts")
    over = counts.where(F.col("n") >= cap).select(F.col("prefix").alias("shorter"))
    longer = counts.where(F.length("prefix") > start).withColumn("shorter", F.expr("left(prefix, length(prefix) - 1)"))
    return counts.where(F.length("prefix") == start).unionByName(longer.join(over, "shorter", "left_semi").select("prefix", "n"))


def new_rows(rows: DataFrame, known: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Rows whose key isn't known yet, one per key."""
    return rows.dropDuplicates(list(key)).join(known.select(*key), list(key), "left_anti")


def merge(known: DataFrame, rows: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    return known.unionByName(new_rows(rows, known, key))


def parse_results(pages: DataFrame, base: str = "", html: str = "html") -> DataFrame:
    """Word list rows of result pages: one per <li> that names a word, in page order."""
    items = pages.select(*[c for c in pages.columns if c != html], F.posexplode(F.regexp_extract_all(html, F.lit(ITEM), F.lit(1))).alias("n", "item"))
    one = lambda pattern: F.regexp_extract("item", pattern, 1)
    children = F.regexp_extract_all("item", F.lit(TRANSLATION), F.lit(1))
    audio = one(AUDIO)
    return items.select(
        *[c for c in items.columns if c != "item"], text.clean(one(WORD)).alias("word"), text.strip(one(NUMBER)).alias("paradigm"),
        text.strip(one(GENDER)).alias("gender"), text.clean(one(DESCRIPTION)).alias("desc"),
        F.when(F.length(audio) > 0, F.concat(F.lit(base), audio)).otherwise("").alias("audio"),
        F.filter(F.transform(children, text.clean), lambda t: F.length(t) > 0).alias("translations_engl"),
        text.clean(one(NOTE)).alias("description"),
    ).where(F.length("word") > 0)


def first_match(results: DataFrame, by: tuple[str, ...] = ("word", "paradigm", "lang"), order: str = "n") -> DataFrame:
    """Of each key the first result."""
    return results.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(order))).where("_r = 1").drop("_r")


def complete(stubs: DataFrame, results: DataFrame) -> DataFrame:
    """Stubs with a translations map: per language the first row of the same word and paradigm decides; empty lists are left out.

    results (word, paradigm, lang, n, translations).
    """
    chosen = first_match(results).where(F.size("translations") > 0)
    maps = chosen.groupBy("word", "paradigm").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("lang", "translations")))).alias("translations"))
    return stubs.join(maps, ["word", "paradigm"], "left").withColumn("translations", F.coalesce("translations", F.create_map().cast("map<string,array<string>>")))


def status(entries: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """Counts of entries, of translations by language, and of forms; one row."""
    has = lambda c: F.count_if(c)
    lists = {x: F.size(F.coalesce(F.try_element_at("translations", F.lit(x)), F.array().cast("array<string>"))) > 0 for x in languages}
    return entries.agg(F.count(F.lit(1)).alias("entries"), *[has(c).alias(f"with_{x}") for x, c in lists.items()], has(F.length(F.coalesce("forms_json", F.lit(""))) > 2).alias("with_forms"))


def upper_median(values: Column) -> Column:
    """The middle of an array, the upper one of two."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def throttle(times: DataFrame, window: int = WINDOW, least: float = LEAST, most: float = MOST) -> DataFrame:
    """key, seq, median of the last ``window`` times, baseline (the first full window's) and the delay after each.

    One stream of times (key) is a sequence, so its rows are sorted and read one after another; what is held of it
    are its last times, its baseline and its delay.  Streams are independent and spread.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = object(), Pace(delay=least)
        for batch in batches:
            medians, bases, delays = [], [], []
            for k, elapsed in zip(batch.column("key").to_pylist(), batch.column("elapsed").to_pylist()):
                if k != key:
                    key, state = k, Pace(delay=least)
                state, middle = paced(state, elapsed, window, least, most)
                medians.append(middle)
                bases.append(state.baseline)
                delays.append(state.delay)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("seq"), *(pa.array(x, pa.float64()) for x in (medians, bases, delays))], names=["key", "seq", "median", "baseline", "delay"])

    rows = times.where("elapsed IS NOT NULL").select(F.col("key").cast("string").alias("key"), F.col("seq").cast("bigint").alias("seq"), F.col("elapsed").cast("double").alias("elapsed"))
    return rows.repartition("key").sortWithinPartitions("key", "seq", "elapsed").mapInArrow(run, "key string, seq bigint, median double, baseline double, delay double")


def search_requests(prefixes_: DataFrame, base: str, dialect: str, language: str = "engl") -> DataFrame:
    """prefix and the address that asks for it."""
    return prefixes_.select("prefix", F.concat(F.lit(f"{base}/?s="), F.url_encode("prefix"), F.lit(f"&language={language}&dia={dialect}")).alias("url"))


def form_requests(stubs: DataFrame, base: str, dialect: str) -> DataFrame:
    """Key, address and form fields of the requests for inflection tables: only of words that have a paradigm."""
    form = F.create_map(F.lit("word"), F.col("word"), F.lit("numb"), F.col("paradigm"), F.lit("desc"), F.coalesce("desc", F.lit("")), F.lit("dia"), F.lit(dialect))
    return stubs.where(F.length("paradigm") > 0).select(*KEY, F.lit(base).alias("url"), form.alias("form"))


def enumerate_words(start: DataFrame, ask: Callable[[DataFrame], DataFrame], known: DataFrame, alphabet: list[str] | None = None, cap: int = RESULT_CAP, depth: int = MAX_DEPTH) -> tuple[DataFrame, DataFrame]:
    """Phase one: word list rows of all prefixes, and the prefixes asked.

    ask takes (prefix) rows and gives word list rows with their prefix, at most ``cap`` for each; a prefix at the
    cap is asked again with each letter added, down to ``depth`` letters.  Each round is kept, so that a source is
    asked once.
    """
    letters = start.sparkSession.createDataFrame([(x,) for x in alphabet or ALPHABET], "letter string")
    live, found, asked = start.select("prefix").distinct(), known, None
    for _ in range(depth):
        got = written(ask(live), "asked")
        asked = live if asked is None else asked.unionByName(live)
        found = merge(found, got.select(*known.columns))
        full = got.groupBy("prefix").count().where((F.col("count") >= cap) & (F.length("prefix") < depth)).select("prefix")
        live = full.crossJoin(F.broadcast(letters)).select(F.concat("prefix", "letter").alias("prefix"))
        live = written(live, "prefixes")
        if live.isEmpty():
            break
    return found, asked


def complete_words(stubs: DataFrame, done: DataFrame, results: DataFrame, forms: DataFrame | None = None) -> DataFrame:
    """Phase two: entries of the stubs that aren't done, with translations and, where given, forms (word, paradigm, desc, forms_json)."""
    rows = complete(new_rows(stubs, done), results)
    return rows.join(forms, list(KEY), "left") if forms is not None else rows.withColumn("forms_json", F.lit(None).cast("string"))


#: The words of the trial run.
TRIAL_WORDS = ("buttan", "ēitwei", "grazzus", "kwaitītun", "wundan")


def trial(search: Callable[[DataFrame], DataFrame], results: Callable[[DataFrame], DataFrame], spark: SparkSession, words: tuple[str, ...] = TRIAL_WORDS) -> DataFrame:
    """The trial run: the few words are searched, stubs of exactly these words completed.

    search takes (word) rows and gives word list rows with the word asked as ``asked``; results takes the stubs and gives
    the rows of all languages that ``complete`` takes.
    """
    asked = spark.createDataFrame([(w,) for w in words], "word string")
    stubs = written(search(asked).where("word = asked").drop("asked"), "trial-stubs")
    return complete(stubs, results(stubs))
