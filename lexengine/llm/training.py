"""The labels that classifiers are trained on, and a bounded sample of their documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most labelled rows that a classifier is fitted on; taken in the order of a hash of their ids, so the same at every run.
MAX_TRAINING_ROWS = 6_000
HELD_OUT = 2


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def known(labels: DataFrame, target: str) -> DataFrame:
    """doc_id and label of the labels that may be learned from: none of a held-out id."""
    return labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col(target).cast("int").alias("label"))


def sampled(docs: DataFrame, labels: DataFrame, target: str, rare_first: bool = False, rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """text and label (0 or 1) of at most ``rows`` labels, none of them of a held-out id; ids may be of any type.

    With rare_first at most half of the sample has either label.  Several documents of one id are all in the sample.
    """
    usable = known(labels, target)
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("label")]
    if rare_first:
        half = rows // 2
        chosen = usable.where("label > 0").orderBy(*by_hash).limit(half).unionByName(usable.where("label <= 0").orderBy(*by_hash).limit(half))
    else:
        chosen = usable.orderBy(*by_hash).limit(rows)
    # at most MAX_TRAINING_ROWS rows of an id and a number
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("text").cast("string").alias("text"), (F.col("label") > 0).cast("int").alias("label"))
