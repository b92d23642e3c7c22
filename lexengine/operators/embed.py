"""Building the embedding table: entries with translations, their passages and vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.connectors import embed_column


def embeddable(entries: DataFrame) -> DataFrame:
    """Entries with at least one translation."""
    return entries.where(F.exists(F.map_values(F.coalesce("translations", F.create_map().cast("map<string,array<string>>"))), lambda x: F.size(F.coalesce(x, F.array().cast("array<string>"))) > 0))


def passages(entries: DataFrame) -> DataFrame:
    return embeddable(entries).withColumn("passage", text.passage("translations"))


def build(entries: DataFrame, embed: Callable[[list[str]], np.ndarray], batch: int = 32, zero_on_error: bool = False, dimension: int | None = None) -> DataFrame:
    """Entries with passage and embedding, one table, keyed by pos."""
    return embed_column(passages(entries), "passage", embed, batch=batch, zero_on_error=zero_on_error, dimension=dimension)
