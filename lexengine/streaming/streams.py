"""Streaming forms of ingestion and stream assembly: the same results as the batch operators, incrementally.

State is kept in RocksDB by ``transformWithState``.  Rows of a key may come in any order, within a batch and across batches: what is
next in line is folded, the rest waits in the state until the gap before it is filled, packed: a row of state costs a round trip.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.pace import LEAST, MOST, WINDOW, Pace, paced

#: State in RocksDB: a batch saves what it changed, not all there is, and rows aren't looked up once more to count them.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.join.stateFormatVersion": "3",
}
#: How long the state of a stream stays that gets no more rows.
FORGET_MS = 24 * 3600 * 1000
#: Response times that a row of state, or a frame that comes out, holds at most.
BLOCK = 65_536


def read_files(spark: SparkSession, folder: str, schema: str, kind: str = "parquet", files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(folder)


def _in_order(rows: Iterable[tuple], waiting: Iterable[tuple], next_: int) -> tuple[list[tuple], list[tuple]]:
    """The waiting and new rows (seq, ...) that follow ``next_`` without a gap, by seq, and the rest; a seq that was seen is left out."""
    known = {r[0]: r for r in waiting}
    for r in rows:
        if r[0] >= next_:
            known.setdefault(r[0], r)
    ready = []
    while next_ in known:
        ready.append(known.pop(next_))
        next_ += 1
    return ready, sorted(known.values(), key=lambda r: r[0])


def _packed(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The keys, and as ``pieces`` the rows of each key of a batch of rows: what is shuffled and met by the state is a row per key, not per piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple, list[tuple]] = {}
            at = zip(*(batch.column(c).to_pylist() for c in keys))
            for key, row in zip(at, zip(*(batch.column(c).to_pylist() for c in columns))):
                found.setdefault(key, []).append(row)
            if found:
                made = [pa.array(c, batch.schema.field(k).type) for k, c in zip(keys, zip(*found))]
                yield pa.RecordBatch.from_arrays([*made, pa.array([pickle.dumps(x) for x in found.values()], pa.binary())], names=[*keys, "pieces"])

    slim = rows.select(*keys, *columns)
    return slim.mapInArrow(run, T.StructType([*(slim.schema[k] for k in keys), T.StructField("pieces", T.BinaryType())]))


class _Assembly(StatefulProcessor):
    """Joins the pieces of each key in the order of seq, and keeps the last of other values that isn't empty.

    A key has one state, with what waits behind a gap in it, so that a batch reads and writes it once.
    """

    def __init__(self, keys: list[str], joined: list[str], last: list[str], forget_ms: int) -> None:
        self.keys, self.joined, self.last, self.forget_ms = keys, joined, last, forget_ms
        self.columns = [*joined, *last]

    def init(self, handle: StatefulProcessorHandle) -> None:
        texts = ", ".join(f"{c} string" for c in self.columns)
        self.done = handle.getValueState("done", f"next bigint, {texts}, waiting binary", self.forget_ms)

    def _fold(self, held: list[str], rows: list[tuple]) -> list[str]:
        n = len(self.joined)
        values = list(zip(*(r[2:] for r in rows))) or [()] * len(held)
        return [h + "".join(some) if i < n else next((x for x in reversed(some) if x), h) for i, (h, some) in enumerate(zip(held, values))]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        next_, *held, waiting = self.done.get() or (0, *[""] * len(self.columns), None)
        pieces = (piece for r in rows for piece in pickle.loads(r.pieces))
        ready, rest = _in_order(pieces, pickle.loads(waiting) if waiting else (), next_)
        held = self._fold(held, ready)
        if any(finish for _, finish, *_ in ready):
            self.done.clear()
        else:
            self.done.update((next_ + len(ready), *held, pickle.dumps(rest) if rest else None))
        # what waits is shown too, in its order, as the batch operator would
        yield Row(**dict(zip([*self.keys, *self.columns], [*key, *self._fold(held, rest)])))

    def close(self) -> None:
        pass


def _assembled(pieces: DataFrame, keys: list[str], joined: list[str], last: list[str], forget_ms: int) -> DataFrame:
    finish = F.col("finish").cast("boolean") if "finish" in pieces.columns else F.lit(False)
    tidy = pieces.select(*keys, F.col("seq").cast("bigint").alias("seq"), F.coalesce(finish, F.lit(False)).alias("finish"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (*joined, *last)])
    types = {f.name: f.dataType.simpleString() for f in tidy.schema}
    schema = ", ".join(f"{c} {types[c]}" for c in (*keys, *joined, *last))
    packed = _packed(tidy, keys, ["seq", "finish", *joined, *last])
    return packed.groupBy(*keys).transformWithState(_Assembly(keys, joined, last, forget_ms), schema, "Update", "ProcessingTime")


def assembled_calls(fragments: DataFrame, forget_ms: int = FORGET_MS) -> DataFrame:
    """Tool calls as they grow: per stream and index the id, name and arguments so far, after each batch of fragments.

    The seq of a stream and index counts from 0 without gaps; a seq that comes again is left out.  Where fragments have a column
    finish, the state of a call goes with the fragment that says so and has no gap before it; other states go after ``forget_ms``.
    """
    return _assembled(fragments, ["stream_id", "idx"], ["arguments"], ["id", "name"], forget_ms)


def assembled_content(deltas: DataFrame, forget_ms: int = FORGET_MS) -> DataFrame:
    """content and reasoning of each stream and turn as they grow, from deltas (stream_id, turn, seq, kind, piece)."""
    of = lambda kind: F.when(F.col("kind") == kind, F.col("piece")).otherwise("").alias(kind)
    kept = [F.col(c) for c in ("stream_id", "turn", "seq", "finish") if c in deltas.columns]
    return _assembled(deltas.select(*kept, of("content"), of("reasoning")), ["stream_id", "turn"], ["content", "reasoning"], [], forget_ms)


class _Throttle(StatefulProcessor):
    """The pace of each key after each of its response times, in the order of seq.

    What waits behind a gap is kept in blocks of at most ``BLOCK`` rows, as the bytes of two arrays; a time of nan stands for none.
    """

    def __init__(self, bounds: tuple[int, float, float], patience_ms: int, forget_ms: int) -> None:
        self.bounds, self.patience_ms, self.forget_ms = bounds, patience_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("pace", "next bigint, last array<double>, baseline double, delay double", self.forget_ms)
        self.waiting = handle.getListState("waiting", "seq binary, elapsed binary", self.forget_ms)

    def _take(self, key: tuple, next_: int, seqs: np.ndarray, times: np.ndarray, ready: int, pace: Pace) -> Iterator[pd.DataFrame]:
        out = []
        for seq, elapsed in zip(seqs[:ready].tolist(), times[:ready].tolist()):
            # a response without a time takes its place and changes nothing
            if elapsed == elapsed:
                pace, middle = paced(pace, elapsed, *self.bounds)
                out.append((*key, seq, middle, pace.baseline, pace.delay))
            if len(out) >= BLOCK:
                yield self._frame(out)
                out = []
        self.state.update((next_, list(pace.last), pace.baseline, pace.delay))
        blocks = [(seqs[i : i + BLOCK].tobytes(), times[i : i + BLOCK].tobytes()) for i in range(ready, len(seqs), BLOCK)]
        if blocks:
            self.waiting.put(blocks)
        else:
            self.waiting.clear()
        yield self._frame(out)

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["key", "seq", "median", "baseline", "delay"])
        return frame.astype({"seq": "int64", "median": "float64", "baseline": "float64", "delay": "float64"})

    def _held(self) -> tuple[int, Pace]:
        if (state := self.state.get()) is None:
            return 0, Pace(delay=self.bounds[1])
        next_, last, baseline, delay = state
        return next_, Pace(tuple(last), baseline, delay)

    def _waits(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(np.frombuffer(s, np.int64), np.frombuffer(e, np.float64)) for s, e in self.waiting.get()] if self.waiting.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        next_, pace = self._held()
        # frames of one key are cut at a number of rows, so that only all of them together have an order
        some = self._waits() + [(f["seq"].to_numpy(np.int64), f["elapsed"].to_numpy(np.float64)) for f in rows]
        # of equal seqs the first stays
        seqs, first = np.unique(np.concatenate([s for s, _ in some]), return_index=True)
        times = np.concatenate([e for _, e in some])[first]
        seqs, times = seqs[(new := seqs >= next_)], times[new]
        ready = int(np.count_nonzero(seqs == next_ + np.arange(len(seqs))))
        if ready < len(seqs) and self.patience_ms:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)
        yield from self._take(key, next_ + ready, seqs, times, ready, pace)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A gap that was not filled in time is passed over."""
        next_, pace = self._held()
        if some := self._waits():
            seqs, times = (np.concatenate(x) for x in zip(*some))
            yield from self._take(key, int(seqs[-1]) + 1, seqs, times, len(seqs), pace)

    def close(self) -> None:
        pass


def throttled(times: DataFrame, window: int = WINDOW, least: float = LEAST, most: float = MOST, patience_ms: int = 30_000, forget_ms: int = FORGET_MS) -> DataFrame:
    """The adaptive delay after each response time (key, seq, elapsed), by key, as ``operators.ingest.throttle`` gives it.

    The seq of a key counts from 0; rows behind a gap wait until it is filled, or for ``patience_ms`` (0: for as long as it takes).
    """
    tidy = times.select(F.col("key").cast("string").alias("key"), F.col("seq").cast("bigint").alias("seq"), F.col("elapsed").cast("double").alias("elapsed"))
    return tidy.groupBy("key").transformWithStateInPandas(_Throttle((window, least, most), patience_ms, forget_ms), "key string, seq bigint, median double, baseline double, delay double", "Update", "ProcessingTime")


def deduplicated(rows: DataFrame, key: tuple[str, ...], time: str | None = None, late: str = "1 day") -> DataFrame:
    """The first row of each key; with an event time the keys are forgotten after the watermark."""
    if time is None:
        return rows.dropDuplicates(list(key))
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(list(key))


def windowed_counts(events: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events by window and type with a watermark; ts may be a timestamp without zone."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def answered_or_not(requests: DataFrame, responses: DataFrame, patience: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """Requests (id, sent, method) with their responses (id, received, result) in time, or none; adds timed_out.

    A left outer join on two watermarked streams: a request comes out without answer when both watermarks have passed its time by the
    patience, and its state goes.  Rows are late, and left out, if they are behind the watermark, ``late`` behind the latest time.
    """
    asked = requests.withWatermark("sent", late)
    told = responses.withColumnRenamed("id", "response_id").withWatermark("received", late)
    near = (F.col("received") >= F.col("sent")) & (F.col("received") <= F.col("sent") + F.expr(f"INTERVAL {patience}"))
    return asked.join(told, (F.col("id") == F.col("response_id")) & near, "left_outer").withColumn("timed_out", F.col("response_id").isNull()).drop("response_id")


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Takes in all there is and stops; started again with the same checkpoint it goes on from there.

    An append stream may run batches without data, in which watermarks move on.  An update stream runs none: state that goes by
    processing time would ask for them without end.
    """
    conf = stream.sparkSession.conf
    own = STORE | {"spark.sql.streaming.noDataMicroBatches.enabled": str(mode != "update").lower()}
    before = {k: conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            conf.set(k, v)
        # a query takes a copy of the settings when it starts
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            conf.set(k, v) if v is not None else conf.unset(k)
    query.awaitTermination()
    return query


#: The column that names the folder of each batch.
BATCH = "batch_id"


def saved_by_batch(table: str) -> Callable[[DataFrame, int], None]:
    """Writes each batch to a folder of its own; a batch that comes again replaces what it wrote before, whole or not."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/{BATCH}={number}")

    return save


def saved(spark: SparkSession, table: str) -> DataFrame:
    """What ``saved_by_batch`` has written, with the number of its batch."""
    return spark.read.option("basePath", table).parquet(f"{table}/{BATCH}=*")


class _FirstOfKey(StatefulProcessor):
    """The first row of each key that is not known from the start."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.seen.update((True,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = not self.seen.exists()
        for frame in rows:
            if new and len(frame):
                new = False
                self.seen.update((True,))
                yield frame.head(1)

    def close(self) -> None:
        pass


def new_by_key(rows: DataFrame, key: tuple[str, ...], known: DataFrame | None = None) -> DataFrame:
    """The first row of each key that ``known`` doesn't hold; keys are state, so a batch costs what it brings.

    Null is a value of a key like any other.  known is read once, when the stream first starts.
    """
    if known is None:
        return rows.dropDuplicates(list(key))
    initial = known.select(*key).distinct().groupBy(*key)
    return rows.groupBy(*key).transformWithStateInPandas(_FirstOfKey(), rows.schema, "Append", "None", initialState=initial)


def ingest(stream: DataFrame, checkpoint: str, table: str, key: tuple[str, ...], known: DataFrame | None = None) -> StreamingQuery:
    """Adds rows with new keys to a table of batches, each row exactly once.

    A batch that was written but not finished is done again with the keys known before it, and replaces its folder.  ``saved``
    reads the table.
    """
    return run_available(new_by_key(stream, key, known), checkpoint, saved_by_batch(table))


def complete(stubs: DataFrame, checkpoint: str, table: str, results: Callable[[DataFrame], DataFrame], forms: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Phase two as a stream: each batch of new stubs is completed and saved before the next is taken, so a restart goes on from there.

    results takes stubs and gives the rows of all languages that ``operators.ingest.complete`` takes; forms gives their form rows.
    """
    from ..operators.ingest import KEY, complete_words

    def save(batch: DataFrame, number: int) -> None:
        rows = complete_words(batch, batch.limit(0).select(*KEY), results(batch), forms(batch) if forms else None)
        saved_by_batch(table)(rows, number)

    return run_available(new_by_key(stubs, KEY), checkpoint, save)
