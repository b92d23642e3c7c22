"""Queries that write given tables to files and replay them as streams, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..sources import events as event_files
from ..sources import matrices
from ..sources.scratch import scratch_dir
from ..streaming import streams
from .catalogue import ORACLE_SQL, query
from .lexicon import table

#: Parts in which a table is replayed; each is a batch at least.
PARTS = 3


def _folder(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _parts(rows: DataFrame, seed: int = 7) -> list[DataFrame]:
    """The rows dealt to parts by a hash of them, so in no order."""
    part = F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in rows.columns]), F.lit(PARTS))
    return [rows.where(part == k) for k in range(PARTS)]


def _replayed(rows: DataFrame, label: str, build, mode: str) -> DataFrame:
    """What a stream of the rows has saved after each part of them was added to its folder, with the number of the batch."""
    spark, folder = rows.sparkSession, _folder(rows.sparkSession, label)
    for part in _parts(rows):
        part.write.mode("append").parquet(f"{folder}/in")
        stream = build(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
        streams.run_available(stream, f"{folder}/checkpoint", streams.saved_by_batch(f"{folder}/out"), mode)
    return streams.saved(spark, f"{folder}/out")


def _latest(rows: DataFrame, *keys: str) -> DataFrame:
    """The last update of each key."""
    values = [c for c in rows.columns if c not in (*keys, streams.BATCH)]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col(streams.BATCH)).alias("v")).select(*keys, "v.*")


@query("SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos, label::VARCHAR AS label, embedding[1]::DOUBLE AS first, embedding[len(embedding)]::DOUBLE AS last, len(embedding)::INT AS width FROM embeddings")
def matrix_files(spark, sf_dir):
    """The vectors, written as a matrix with its entries and read back by row ranges."""
    path = _folder(spark, "matrix")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), "vec_id", "label", "embedding")
    matrices.write_matrix(rows, path, "given", "none", "all")
    back = matrices.read_matrix(spark, path, "vec_id bigint, label string")
    return back.select("vec_id", "pos", "label", F.element_at("embedding", 1).cast("double").alias("first"), F.element_at("embedding", -1).cast("double").alias("last"), F.size("embedding").alias("width"))


@query("SELECT event_id, event_type AS event, user_id FROM events")
def event_stream_files(spark, sf_dir):
    """Events as frames: written by a stream, read back by a stream, each once."""
    folder = _folder(spark, "frames")
    data = F.to_json(F.struct("event_id", "user_id"))
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("event"), data.alias("data"))
    for part in _parts(rows):
        part.write.mode("append").parquet(f"{folder}/in")
        event_files.write_frames(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), f"{folder}/stream", f"{folder}/written")
        streams.run_available(event_files.stream_frames(spark, f"{folder}/stream"), f"{folder}/read", streams.saved_by_batch(f"{folder}/out"))
    frames = streams.saved(spark, f"{folder}/out").select(F.explode(text.sse_events("frame")).alias("e"))
    number = lambda name: F.get_json_object("e.data", f"$.{name}").cast("bigint").alias(name)
    return frames.select(number("event_id"), "e.event", number("user_id"))


@query("SELECT conv_id, turn, string_agg(text, '' ORDER BY turn) || 'x' AS arguments, 'call' || turn AS id FROM conversations GROUP BY conv_id, turn")
def stream_calls(spark, sf_dir):
    """Fragments of calls in no order, put together as a stream: the text of each turn in pieces of nine letters, and an end."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.regexp_extract_all("text", F.lit(r"(?s)(.{1,9})"), F.lit(1)), F.array(F.lit("x"))).alias("pieces"))
    parts = rows.select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("idx"), F.posexplode("pieces").alias("seq", "arguments")).withColumn("seq", F.col("seq").cast("bigint"))
    parts = parts.withColumn("id", F.when(F.col("seq") == 0, F.concat(F.lit("call"), F.col("idx").cast("string"))).otherwise("")).withColumn("name", F.lit(""))
    made = _latest(_replayed(parts, "calls", streams.assembled_calls, "update"), "stream_id", "idx")
    return made.select(F.col("stream_id").alias("conv_id"), F.col("idx").alias("turn"), "arguments", "id")


@query("SELECT conv_id AS stream_id, turn, CASE WHEN role = 'assistant' THEN text ELSE '' END AS content, CASE WHEN role <> 'assistant' THEN text ELSE '' END AS reasoning FROM conversations WHERE length(text) > 0")
def stream_deltas(spark, sf_dir):
    """Pieces of content and reasoning in no order, put together as a stream."""
    kind = F.when(F.col("role") == "assistant", "content").otherwise("reasoning")
    pieces = F.posexplode(F.regexp_extract_all("text", F.lit(r"(?s)(.{1,12})"), F.lit(1))).alias("seq", "piece")
    deltas = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("stream_id"), "turn", kind.alias("kind"), pieces)
    return _latest(_replayed(deltas.withColumn("seq", F.col("seq").cast("bigint")), "deltas", streams.assembled_content, "update"), "stream_id", "turn")


@query(f"SELECT key, row_number() OVER (PARTITION BY key ORDER BY seq) - 1 AS seq, median, baseline, delay FROM ({ORACLE_SQL['throttle_delay']})")
def stream_throttle(spark, sf_dir):
    """The adaptive delay of fifty streams of times, which come in no order."""
    times = table(spark, sf_dir, "events").select((F.col("user_id") % 50).cast("string").alias("key"), "event_id", F.col("value").alias("elapsed"))
    times = times.withColumn("seq", (F.row_number().over(W.partitionBy("key").orderBy("event_id")) - 1).cast("bigint")).select("key", "seq", "elapsed")
    made = _replayed(times, "times", lambda rows: streams.throttled(rows, patience_ms=0), "update")
    return made.select("key", "seq", "median", "baseline", F.round("delay", 9).alias("delay"))


@query("SELECT user_id, min(event_type) AS event_type, count(*) AS rows FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id")
def stream_ingest(spark, sf_dir):
    """Rows with new keys, added to a table exactly once from a stream that repeats them."""
    folder = _folder(spark, "ingest")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("word"), "event_type", F.col("event_id").cast("string").alias("desc"))
    for part in _parts(rows):
        part.write.mode("append").parquet(f"{folder}/in")
        streams.ingest(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), f"{folder}/checkpoint", f"{folder}/out", ("word", "event_type"))
    return streams.saved(spark, f"{folder}/out").groupBy(F.col("word").cast("bigint").alias("user_id")).agg(F.min("event_type").alias("event_type"), F.count(F.lit(1)).alias("rows"))


@query("""SELECT a.event_id AS id, b.event_id AS answer, b.event_id IS NULL AS timed_out
FROM events a LEFT JOIN events b ON b.event_id = a.event_id + 1 AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 30 SECONDS""")
def stream_unanswered(spark, sf_dir):
    """Requests with their answers, or as timed out, from two streams; a last row of each makes the time go on."""
    folder = _folder(spark, "answers")
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    asked = rows.select(F.col("event_id").alias("id"), F.col("ts").alias("sent"), F.col("event_type").alias("method"))
    told = rows.select((F.col("event_id") - 1).alias("id"), F.col("ts").alias("received"), F.col("event_id").alias("answer"))
    end = rows.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"))
    lasts = (end.select(F.lit(-1).cast("bigint").alias("id"), F.col("ts").alias("sent"), F.lit("").alias("method")), end.select(F.lit(-2).cast("bigint").alias("id"), F.col("ts").alias("received"), F.lit(-2).cast("bigint").alias("answer")))
    for some in ((asked, told), lasts):
        for side, name in zip(some, ("asked", "told")):
            side.write.mode("append").parquet(f"{folder}/{name}")
        both = streams.answered_or_not(*[spark.readStream.schema(side.schema).parquet(f"{folder}/{name}") for side, name in zip(some, ("asked", "told"))])
        streams.run_available(both, f"{folder}/checkpoint", streams.saved_by_batch(f"{folder}/out"))
    return streams.saved(spark, f"{folder}/out").select("id", "answer", "timed_out")
