"""Measures of a job that are taken while it runs: rows, sums, seconds and rate, without reading anything twice."""

from __future__ import annotations

import math
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Measure:
    """What passed through a DataFrame when it was written.

    measure = Measure("embed")
    with measure.running():
        measure.of(rows).write.parquet(path)
    measure.result(32)
    """

    def __init__(self, name: str) -> None:
        self.observation, self.seconds = Observation(name), 0.0

    def of(self, rows: DataFrame, **more: Column) -> DataFrame:
        """The rows, counted as they pass; more are further aggregates by name."""
        return rows.observe(self.observation, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in more.items()])

    @contextmanager
    def running(self) -> Iterator[None]:
        began = time.monotonic()
        try:
            yield
        finally:
            self.seconds += time.monotonic() - began

    def result(self, batch: int | None = None) -> dict[str, float]:
        """rows and further aggregates, seconds, rate (rows a second) and, for a batch size, batches; waits for the write."""
        found = dict(self.observation.get)
        found |= {"seconds": self.seconds, "rate": found["rows"] / self.seconds if self.seconds else 0.0}
        return found | ({"batches": math.ceil(found["rows"] / batch)} if batch else {})


def progress(query) -> list[dict]:
    """batch, rows, seconds and rate of each batch of a stream that had rows, from its progress."""
    done = [p for p in query.recentProgress if p["numInputRows"]]
    seconds = lambda p: p["batchDuration"] / 1000
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "seconds": seconds(p), "rate": p["numInputRows"] / seconds(p) if seconds(p) else 0.0} for p in done]
