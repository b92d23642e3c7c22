"""Mixing sources to target weights by a time-varying curriculum, in DataFrame operations only.

1. Targets: each source's share of all words by weight, stopped at ``MAX_REPEATS`` times the source's size;
   the excess is shared again by weight (water filling, one pass over the sources in order of the ratio
   at which they stop).
2. Taken words: a source's documents stand in a pseudo-random order of their ids; the source's words are
   read from the start, again and again, until the target is reached.  A document's words are those of
   its passes below the target, so the last document taken may be cut, and no other.
3. Positions: every source has a schedule, a piecewise linear weight over training time 0..1 given by
   knots.  Its integral, scaled to the target, is the cumulative demand; the inverse of it at the word in
   the middle of what a pass takes is the training position of the pass.
4. Order: every pass of a document is a row of its own, and rows are range-sorted by position.

Running sums within a source go over buckets of the order's first 12 bits, then within a bucket, so a
source that holds a third of all rows is spread over up to 4,096 groups.  Only the sources themselves,
one row each, meet in one window.

Defined cases: null text has size 0; null source is a source of its own, last in order; a source of
size 0 has target 0; documents with equal ids are ordered by size and a hash of their text, and equal
rows take what rows in any order would; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_SQL, materialise, only

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Weight schedules in order of the sources, repeating: knots at equal steps of training time.
SCHEDULES = ((1.0, 1.0, 1.0), (1.5, 1.0, 0.5), (0.5, 1.0, 1.5))
BUCKET_DIGITS = 3


def sizes(docs: DataFrame, *keys: str) -> DataFrame:
    """The keys, doc_id, source, size in words, and a hash of the text; the only step that reads texts."""
    slim = only(docs, *keys, "doc_id", "text", "source")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_SQL)), F.lit(0)).cast("long")
    return slim.select(*keys, "doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64("text").alias("text_hash"))


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size, rank and target, one row per source."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = W.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = totals.withColumn("rank", F.row_number().over(in_order) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("rank") % len(weights) + 1))
    stop = (F.col("source_size") * max_repeats).cast("double")
    first_to_stop = W.orderBy(stop / F.col("weight"), "rank")
    upto = first_to_stop.rowsBetween(W.unboundedPreceding, -1)
    onward = first_to_stop.rowsBetween(W.currentRow, W.unboundedFollowing)
    filled = (
        ranked.withColumn("stop", stop)
        .withColumn("all", F.sum("source_size").over(W.partitionBy()))
        .withColumn("stopped", F.coalesce(F.sum("stop").over(upto), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(onward))
    )
    # the level at which this and all later sources would share what the stopped ones leave
    level = (F.col("all").cast("double") - F.col("stopped")) / F.col("open_weight")
    filled = filled.withColumn("level", level).withColumn("stops", F.col("weight") * F.col("level") >= F.col("stop"))
    # stopping is monotone in this order: the level of the first source that doesn't stop holds for all after it
    open_level = F.first(F.when(~F.col("stops"), F.col("level")), ignorenulls=True).over(first_to_stop.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    target = F.when(F.col("stops"), F.col("stop")).otherwise(F.least(F.col("stop"), F.col("weight") * open_level))
    return filled.select("source", "source_size", "rank", target.alias("target"))


def _cumulative(knots: tuple[float, ...]) -> list[float]:
    step, out = 1.0 / (len(knots) - 1), [0.0]
    for a, b in zip(knots, knots[1:]):
        out.append(out[-1] + (a + b) / 2 * step)
    return out


def _inverse(share: Column, knots: tuple[float, ...]) -> Column:
    """Training time at which the schedule's integral reaches the share (0..1) of its whole."""
    cumulative = _cumulative(knots)
    step, whole = 1.0 / (len(knots) - 1), cumulative[-1]
    out = None
    for k in reversed(range(len(knots) - 1)):
        a, slope = knots[k], (knots[k + 1] - knots[k]) / step
        rest = F.greatest(share * F.lit(whole) - F.lit(cumulative[k]), F.lit(0.0))
        # a * t + slope / 2 * t^2 = rest, in the form that also holds for slope 0
        at = F.lit(k * step) + rest * F.lit(2.0) / (F.lit(a) + F.sqrt(F.lit(a * a) + F.lit(2.0 * slope) * rest))
        out = at if out is None else F.when(share * F.lit(whole) >= F.lit(cumulative[k + 1]), out).otherwise(at)
    return F.least(out, F.lit(1.0))


def curriculum(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, schedules: tuple[tuple[float, ...], ...] = SCHEDULES) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and the training positions of the passes, per document."""
    rows = _passes(materialise(sizes(docs), "mix-sizes"), weights, max_repeats, schedules)
    return rows.select("doc_id", "source", "size", "source_size", "target", "taken", *[f"position_{p + 1}" for p in range(max_repeats)])


def _passes(sized: DataFrame, weights: tuple[float, ...], max_repeats: int, schedules: tuple[tuple[float, ...], ...]) -> DataFrame:
    """The sized rows with source_size, target, taken, and what each pass takes and where (taken_1, position_1 ...)."""
    columns = sized.columns
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    ordered = sized.withColumn("key", key).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    targets = source_targets(sized, weights, max_repeats)
    buckets = ordered.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = F.sum("bucket_size").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    starts = buckets.withColumn("bucket_start", F.coalesce(before, F.lit(0)))
    starts = starts.join(targets, starts["source"].eqNullSafe(targets["source"])).drop(targets["source"]).drop("bucket_size")
    within = F.sum("size").over(W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "text_hash").rowsBetween(W.unboundedPreceding, -1))
    placed = ordered.withColumn("within", F.coalesce(within, F.lit(0)))
    rows = placed.join(starts, placed["source"].eqNullSafe(starts["source"]) & (placed["bucket"] == starts["bucket"])).drop(starts["source"]).drop(starts["bucket"])
    limit = F.floor("target")
    start = F.col("bucket_start") + F.col("within")
    takes = [F.greatest(F.lit(0), F.least(F.col("size"), limit - (start + p * F.col("source_size")))).cast("long") for p in range(max_repeats)]
    rows = rows.withColumn("taken", sum(takes[1:], takes[0]))
    for p, take in enumerate(takes):
        share = ((start + p * F.col("source_size")).cast("double") + take.cast("double") / F.lit(2.0)) / F.nullif(F.col("target"), F.lit(0.0))
        position = None
        for k in reversed(range(len(schedules))):
            at = _inverse(share, schedules[k])
            position = at if position is None else F.when(F.col("rank") % len(schedules) == k, at).otherwise(position)
        rows = rows.withColumn(f"position_{p + 1}", F.when(take > 0, position)).withColumn(f"taken_{p + 1}", take)
    return rows.select(*columns, "source_size", "target", "taken", *[f"{c}_{p + 1}" for p in range(max_repeats) for c in ("taken", "position")])


def _sorted(rows: DataFrame, partitions: int | None, *by: Column) -> DataFrame:
    dealt = rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)
    return dealt.sortWithinPartitions(*by)


def in_training_order(mixed: DataFrame, partitions: int | None = None) -> DataFrame:
    """Documents range-sorted by the position of their first pass; those that are not taken come last."""
    return _sorted(mixed, partitions, F.col("position_1").asc_nulls_last(), F.col("doc_id"))


def _numbered(docs: DataFrame) -> DataFrame:
    """The documents, packed as row, with a file and a place in it that tell rows apart on every reading."""
    packed = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    try:
        return docs.select(packed, F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    except AnalysisException:
        # no table of Parquet files: numbered as it is written to one
        return materialise(docs.select(packed, F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("place")), "mix-rows")


#: Columns that training_rows adds.
ADDED = ("size", "source_size", "target", "pass", "taken", "position")


def training_rows(docs: DataFrame, partitions: int | None = None, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, schedules: tuple[tuple[float, ...], ...] = SCHEDULES) -> DataFrame:
    """One row for each pass of each document, in training order, with all columns of docs.

    Added are size, source_size, target, pass (from 1), the words that the pass takes, and its position.  A document
    that the mix takes nothing of has one row with pass and position null and taken 0, after all others.
    """
    numbered = _numbered(docs)
    flat = numbered.select("file", "place", *[F.col("row")[c].alias(c) for c in docs.columns if c.lower() in ("doc_id", "text", "source")])
    sized = materialise(sizes(flat, "file", "place"), "mix-sizes")
    rows = _passes(sized, weights, max_repeats, schedules)
    each = F.filter(F.array(*[F.struct(F.lit(p + 1).alias("pass"), F.col(f"taken_{p + 1}").alias("taken"), F.col(f"position_{p + 1}").alias("position")) for p in range(max_repeats)]), lambda x: x["taken"] > 0)
    nothing = F.array(F.struct(F.lit(None).cast("int").alias("pass"), F.lit(0).cast("long").alias("taken"), F.lit(None).cast("double").alias("position")))
    passes = rows.select("file", "place", "size", "source_size", "target", F.explode(F.when(F.size(each) > 0, each).otherwise(nothing)).alias("x"))
    passes = materialise(passes.select("file", "place", "size", "source_size", "target", "x.*"), "mix-passes")
    kept = [c for c in docs.columns if c.lower() not in ADDED]
    joined = numbered.join(passes, ["file", "place"]).select(*[F.col("row")[c].alias(c) for c in kept], *ADDED)
    return _sorted(joined, partitions, F.col("position").asc_nulls_last(), F.col("doc_id") if "doc_id" in kept else F.lit(0), F.col("pass"))


def _inverse_sql(share: str, knots: tuple[float, ...]) -> str:
    cumulative = _cumulative(knots)
    step, whole, out = 1.0 / (len(knots) - 1), cumulative[-1], ""
    for k in reversed(range(len(knots) - 1)):
        a, slope = knots[k], (knots[k + 1] - knots[k]) / step
        rest = f"greatest({share} * {whole!r}e0 - {cumulative[k]!r}e0, 0e0)"
        at = f"({k * step!r}e0 + {rest} * 2e0 / ({a!r}e0 + sqrt({a * a!r}e0 + {2.0 * slope!r}e0 * {rest})))"
        out = f"CASE WHEN {share} * {whole!r}e0 >= {cumulative[k + 1]!r}e0 THEN {out} ELSE {at} END" if out else at
    return f"least({out}, 1e0)"


def _position_sql(p: int) -> str:
    share = f"(((start + {p} * source_size)::DOUBLE + take_{p + 1}::DOUBLE / 2e0) / target)"
    cases = " ".join(f"WHEN {k} THEN {_inverse_sql(share, x)}" for k, x in enumerate(SCHEDULES))
    return f"CASE WHEN take_{p + 1} > 0 THEN round(CASE rank % 3 {cases} END, 9) END"


ORACLE_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY (source IS NULL), source COLLATE "C") - 1 AS rank FROM totals),
weighed AS (
  SELECT *, [5e0, 2e0, 1e0][(rank % 3 + 1)::INT] AS weight, (source_size * 3)::DOUBLE AS stop FROM ranked),
filled AS (
  SELECT *, sum(source_size) OVER ()::DOUBLE AS total,
    coalesce(sum(stop) OVER (ORDER BY stop / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS stopped,
    sum(weight) OVER (ORDER BY stop / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM weighed),
levels AS (SELECT *, (total - stopped) / open_weight AS level FROM filled),
open AS (SELECT level AS open_level FROM levels WHERE NOT weight * level >= stop ORDER BY stop / weight, rank LIMIT 1),
targets AS (
  SELECT source, source_size, rank,
    CASE WHEN weight * level >= stop THEN stop ELSE least(stop, weight * (SELECT open_level FROM open)) END AS target FROM levels),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.rank, t.target,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
passes AS (
  SELECT *, greatest(0, least(size, floor(target)::BIGINT - start)) AS take_1,
    greatest(0, least(size, floor(target)::BIGINT - (start + source_size))) AS take_2,
    greatest(0, least(size, floor(target)::BIGINT - (start + 2 * source_size))) AS take_3 FROM placed)
SELECT doc_id, size, source_size, target, (take_1 + take_2 + take_3)::BIGINT AS taken,
  POSITION_1 AS position, POSITION_2 AS position_2, POSITION_3 AS position_3 FROM passes
""".replace("POSITION_1", _position_sql(0)).replace("POSITION_2", _position_sql(1)).replace("POSITION_3", _position_sql(2))
