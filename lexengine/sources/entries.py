"""Reading and writing dictionaries, word lists, embeddings and state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import written

_ITEM = "array<struct<forms: array<struct<form: string>>, form: string>>"
FORMS = (
    "struct<declension: array<struct<cases: array<struct<singular: string, plural: string>>>>, "
    f"indicative: {_ITEM}, subjunctive: {_ITEM}, optative: {_ITEM}, imperative: {_ITEM}, "
    "participles: array<struct<form: string>>, infinitives: array<struct<form: string>>>"
)
ENTRIES = f"pos bigint, word string, paradigm string, gender string, desc string, audio string, description string, translations map<string, array<string>>, forms {FORMS}, forms_json string"
WORDLIST = "word string, paradigm string, gender string, desc string, audio string, translations_engl array<string>, description string"
STATE = "phase string, done_prefixes array<string>, done_3letter array<string>, completed_words bigint"


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries from a JSON array or object of entries, with their position in the file.

    A missing file raises.  The file is one JSON document and so one row until it is exploded; convert it to
    Parquet once, with ``write_entries``.
    """
    document = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    rows = spark.sql("SELECT e.pos AS pos, to_json(e.value) AS j FROM {document}, LATERAL variant_explode(v) AS e", document=document)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in T._parse_datatype_string(ENTRIES) if f.name not in ("pos", "forms_json"))
    parsed = rows.select(F.col("pos").cast("bigint").alias("pos"), F.from_json("j", fields).alias("e"), F.get_json_object("j", "$.forms").alias("forms_json"))
    return parsed.select("pos", "e.*", "forms_json")


def write_entries(entries: DataFrame, path: str) -> None:
    entries.write.mode("overwrite").parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema: str, document: bool = False) -> DataFrame:
    """JSON rows of the schema, one a line, or with document one array a file; no rows where nothing has been written yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).option("multiLine", document).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_json(rows: DataFrame, path: str, mode: str = "overwrite", by: str | None = None) -> None:
    """JSON rows; mode append adds to what is there, by makes a folder for each value."""
    writer = rows.write.mode(mode)
    (writer.partitionBy(by) if by else writer).json(path)


def with_position(rows: DataFrame, *order: str) -> DataFrame:
    """Adds pos, the row's place in the given order (nulls first), without gathering rows in one task.

    Rows are range-partitioned, sorted, and written once with their partition and their place in it; the
    partitions' starts are counted from that table, so that both sides always speak of the same partitions.
    Rows of equal keys are ordered by a hash of the whole row, which also spreads a key with many rows.
    """
    by = [*[F.col(f"`{c}`") for c in order], F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    # the upper bits of this id are the partition, the lower 33 the row's place in it
    table = written(dealt.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.monotonically_increasing_id().alias("id")), "positions")
    part, within = F.shiftright("id", 33), F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = table.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    # one row for each partition
    starts = counts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    placed = table.withColumn("part", part).join(F.broadcast(starts), "part")
    return placed.select(*[F.col("row")[c].alias(c) for c in rows.columns], (F.col("start") + within).alias("pos"))


def state_row(spark: SparkSession, path: str) -> dict:
    """The ingest state, or the state before anything was done."""
    row = read_or_empty(spark, path, STATE).first()
    if row is None:
        return {"phase": "enumerate", "done_prefixes": [], "done_3letter": [], "completed_words": 0}
    return {"phase": row.phase, "done_prefixes": list(row.done_prefixes or []), "done_3letter": list(row.done_3letter or []), "completed_words": row.completed_words or 0}


def write_state(spark: SparkSession, path: str, state: dict) -> None:
    """Writes the ingest state, one small row."""
    spark.createDataFrame([(state["phase"], state["done_prefixes"], state.get("done_3letter", []), state.get("completed_words", 0))], STATE).coalesce(1).write.mode("overwrite").json(path)


def to_json_lines(rows: DataFrame) -> DataFrame:
    """Rows as JSON without null keys."""
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("value"))


def sse_frames(rows: DataFrame, event: str = "event", data: str = "data") -> DataFrame:
    """Rows as frames of an event stream."""
    return rows.select(F.concat(F.lit("event: "), F.col(event), F.lit("\ndata: "), F.col(data), F.lit("\n\n")).alias("value"))




def read_parquet_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
