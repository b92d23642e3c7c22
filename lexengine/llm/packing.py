"""Mixture-controlled packing: deficit round-robin over source queues fills windows of tokens to target proportions.

1. Tokens: each document becomes token ids and an end id, once; ids are written with the number of the task that made them and the
   tokens that its source has before it in that task.  Running sums over tasks then say where in its source's queue each document
   stands, so tokens are not shuffled: queues follow the order of the table.
2. Turns: each queue serves ``GRAIN`` tokens a turn.  A queue earns its share of every token that is packed and has its next turn
   as soon as it has earned what its turns so far have served; what it is short of or ahead by, under ``GRAIN`` tokens, is the
   deficit that it carries on.  Turn k of a queue of weight w is due at (k GRAIN + lag) / w, so the order of all turns is known
   without running them one by one: the place of a turn is the sum over queues of what their turns due before it serve.  Every
   task works it out for its own documents, and deficits carry over windows and over partitions alike.  Lags are
   spread over a turn, so that queues of one weight don't all have their turns at once.
3. Windows: all turns behind one another are cut every ``WINDOW`` tokens, so that only the last window is not full.

By default a queue's weight is its share of all tokens, so that all queues end together and every window has the mixture of the
whole; with ``targets`` sources get their own shares while they last, and then those that are left keep their proportions.

Sources of less than 1 / ``WINDOW`` of all tokens, under one token a window, share one queue, so that there are at most
``WINDOW`` + 1 queues (or those of the targets besides): that is what is broadcast.

Defined cases: null text is empty and has the end id only; null source is a source of its own; equal rows are packed each;
a document of any length is cut where turns and windows end; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Callable, Iterator, Mapping
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_text, materialise, only

WINDOW = 4096
#: Tokens of a turn.
GRAIN = 128
END_ID = 2
PAD_ID = 0
#: Chunks and pieces of them whose ids a worker remembers, about 150 MB, and the longest of them.
REMEMBERED, LONGEST = 600_000, 64
#: Tokens that are handed on at once.
SLAB_TOKENS = 2_000_000
#: Tasks whose running sums are made together.
TASK_BLOCK = 1024
#: Signs that upper and lower case, composition and classes of signs treat alike in every library: ASCII, Latin and common marks.
_PLAIN = regex.compile(r"[\t\n\r\x20-\x7e¡-įı-ňŊ-ž–—‘-„…]*+")

#: Patterns of which no match holds white space.
_WORD_PATTERNS = (r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",)


class _Remembered(dict):
    """A dictionary that makes what it lacks; beyond ``most`` entries it forgets all but its first, which are the commonest."""

    def __init__(self, make: Callable[[str], bytes | str], most: int) -> None:
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes | str:
        value = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= self.most:
                first = dict(islice(self.items(), self.most // 4))
                self.clear()
                self.update(first)
            self[key] = value
        return value


class Encoder:
    """Token ids of texts as bytes (of ``dtype``), as the tokenizer gives them without special tokens.

    Where the tokenizer's file says that texts are composed, lower-cased and cut by a pattern that no white space matches, and no
    more, its model gets the pattern's pieces one by one anyway.  Then plain texts are cut at white space, and the ids of chunks
    between it, and of the pieces in them, are remembered.  All other texts go to the tokenizer whole.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        parts = json.loads(definition)
        normal = [x["type"] for x in (parts.get("normalizer") or {}).get("normalizers", [])]
        first, *rest = (parts.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        byte_level = len(rest) == 1 and rest[0]["type"] == "ByteLevel" and not rest[0]["add_prefix_space"] and not rest[0]["use_regex"]
        cut = first.get("type") == "Split" and first["behavior"] == "Removed" and first["invert"] and first["pattern"].get("Regex") in _WORD_PATTERNS
        by_word = normal == ["NFC", "Replace", "Lowercase"] and byte_level and cut and parts["model"]["type"] == "BPE" and parts["model"].get("dropout") is None
        self.find = regex.compile(first["pattern"]["Regex"]).findall if by_word else None
        self.added = [t["content"] for t in parts.get("added_tokens", [])]
        self.known = _Remembered(self._chunk, REMEMBERED)
        # the model gets bytes as letters, those of each sign by themselves
        self.letters = _Remembered(lambda sign: "".join(u for u, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(sign)), REMEMBERED)
        self.tokenize, self.code = self.tokenizer.model.tokenize, "H" if self.dtype == "<u2" else "I"

    def _piece(self, piece: str) -> bytes:
        unit = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece))
        return array(self.code, [t.id for t in self.tokenize(unit)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isalpha():
            return self._piece(chunk)
        pieces = self.find(chunk)
        # a piece of a chunk is a chunk too
        return self._piece(chunk) if len(pieces) == 1 else b"".join(map(self.known.__getitem__, pieces))

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.find is None:
            return self.whole(texts)
        out = [b"".join(map(self.known.__getitem__, t.lower().split())) if _PLAIN.fullmatch(t) is not None and not any(a in t for a in self.added) else None for t in texts]
        others = iter(self.whole([t for t, ids in zip(texts, out) if ids is None]))
        return [next(others) if ids is None else ids for ids in out]


_encoders: dict[int, Encoder] = {}


def _encoder(definition: str) -> Encoder:
    """The encoder of this worker, kept from task to task."""
    key = hash(definition)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(definition)
    return _encoders[key]


def tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, source, ids (two bytes a token, or four for a vocabulary over 65,536), n, and where they were made: part and before.

    ``before`` is the number of tokens of the same source that the task ``part`` made before.
    """
    with open(tokenizer, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())
    slim = only(docs, "doc_id", "source", "text")
    slim = slim.select("doc_id", F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, part, served = _encoder(definition.value), TaskContext.get().partitionId(), {}
        end = np.array([END_ID], dtype=encoder.dtype).tobytes()
        for batch in batches:
            texts, sources = as_text(batch.column("text")), batch.column("source").to_pylist()
            low, ids, counts, before = 0, [], [], []
            total = 0
            for at in range(0, len(texts), 64):
                for raw, source in zip(encoder.encode(texts[at : at + 64]), sources[at : at + 64]):
                    ids.append(raw + end)
                    n = len(ids[-1]) // len(end)
                    counts.append(n)
                    before.append(served.get(source, 0))
                    served[source] = before[-1] + n
                    total += n
                if total >= SLAB_TOKENS or low + len(ids) == len(texts):
                    columns = [batch.column("doc_id").slice(low, len(ids)), batch.column("source").slice(low, len(ids)), pa.array([part] * len(ids), pa.int64()), pa.array(counts, pa.int64()), pa.array(before, pa.int64()), pa.array(ids, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "source", "part", "n", "before", "ids"])
                    low, ids, counts, before, total = low + len(ids), [], [], [], 0

    return slim.mapInArrow(run, f"doc_id {kind}, source string, part bigint, n bigint, before bigint, ids binary")


def lags(queues: int, grain: int = GRAIN) -> np.ndarray:
    """How much each queue has to earn before its first turn."""
    return np.arange(queues) * grain / queues


def turn_starts(queue: np.ndarray, turn: np.ndarray, totals: np.ndarray, weights: np.ndarray, grain: int = GRAIN) -> np.ndarray:
    """Tokens that all turns due before the given ones serve; of turns due together, the first queue's come first."""
    lag = lags(len(totals), grain)
    due = (turn * grain + lag[queue]) / weights[queue]
    out = np.zeros(len(turn), dtype=np.int64)
    for j, (total, weight, late) in enumerate(zip(totals.tolist(), weights.tolist(), lag.tolist())):
        last = -(-total // grain)
        n = np.clip(np.floor((due * weight - late) / grain), 0, last).astype(np.int64)

        def earlier(k: np.ndarray) -> np.ndarray:
            own = (k * grain + late) / weight
            return (own < due) | ((own == due) & (j < queue))

        # the estimate may be off by rounding; the comparison, which every task makes alike, decides
        while (less := (n > 0) & ~earlier(n - 1)).any():
            n -= less
        while (more := (n < last) & earlier(n)).any():
            n += more
        out += np.minimum(n * grain, total)
    return out


def cut(first: np.ndarray, n: np.ndarray, queue: np.ndarray, totals: np.ndarray, weights: np.ndarray, window: int = WINDOW, grain: int = GRAIN) -> tuple[np.ndarray, ...]:
    """Pieces of documents that take n tokens of their queue from first on: row, start in the document, length, place of all."""
    turns = (first + n - 1) // grain - first // grain + 1
    row = np.repeat(np.arange(len(n)), turns)
    turn = np.arange(len(row)) - np.repeat(np.cumsum(turns) - turns, turns) + (first // grain)[row]
    low, high = np.maximum(turn * grain, first[row]), np.minimum((turn + 1) * grain, (first + n)[row])
    place = turn_starts(queue[row], turn, totals, weights, grain) + low - turn * grain
    # a turn, no longer than a window, meets the end of one at most
    room = window - place % window
    split = np.repeat(np.arange(len(row)), 1 + (high - low > room))
    second = np.concatenate(([False], split[1:] == split[:-1])) if len(split) else np.zeros(0, dtype=bool)
    row, place, room, start, length = row[split], place[split], room[split], (low - first[row])[split], (high - low)[split]
    start, place = start + second * room, place + second * room
    length = np.where(second, length - room, np.minimum(length, room))
    # turns of one queue that follow each other in a window are one piece
    joined = (row[1:] == row[:-1]) & (place[:-1] + length[:-1] == place[1:]) & (place[1:] % window != 0)
    begins = np.flatnonzero(np.concatenate(([True], ~joined))) if len(row) else np.zeros(0, dtype=np.int64)
    length = np.add.reduceat(length, begins) if len(row) else length
    return row[begins], start[begins], length, place[begins]


def _queues(per_task: DataFrame, targets: Mapping[str | None, float] | None, window: int) -> list[tuple[str | None, bool, int, float]]:
    """(source, whether it is the shared queue, tokens, weight), by source, null last and the shared queue after all."""
    named = dict(targets or {})
    totals = per_task.groupBy("source").agg(F.sum("n").alias("n"))
    whole = totals.agg(F.sum("n")).first()[0] or 0
    listed = F.lit(False)
    if named:
        listed = F.coalesce(F.col("source").isin([s for s in named if s is not None]), F.lit(False)) | (F.col("source").isNull() if None in named else F.lit(False))
    own = (F.col("n") * window >= whole) | listed
    # at most ``window`` sources have so much, and targets are the caller's
    large = sorted(((r.source, r.n) for r in totals.where(own).collect()), key=lambda x: (x[0] is None, x[0] or ""))
    rest = whole - sum(n for _, n in large)
    free = sum(n for s, n in large if s not in named) + rest
    left = 1.0 - sum(named[s] for s, _ in large if s in named) if named else 1.0
    if any(w <= 0 for w in named.values()) or (free and left <= 0):
        raise ValueError("targets must be above 0, and leave something to sources that they don't name")
    found = [(s, False, n, named[s] if s in named else left * n / free) for s, n in large]
    return found + ([(None, True, rest, left * rest / free)] if rest else [])


def _starts(per_task: DataFrame, queues: list[tuple[str | None, bool, int, float]]) -> DataFrame:
    """part, source, queue, and where in the queue the part's tokens of the source begin."""
    spark = per_task.sparkSession
    listed = [(s, i) for i, (s, shared, _, _) in enumerate(queues) if not shared]
    # at most a row for each queue
    numbers = F.broadcast(spark.createDataFrame(listed, "named string, queue int"))
    rows = per_task.join(numbers, per_task["source"].eqNullSafe(numbers["named"]), "left").drop("named")
    rows = rows.withColumn("queue", F.coalesce("queue", F.lit(len(queues) - 1))).withColumn("block", F.floor(F.col("part") / TASK_BLOCK))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    within = rows.withColumn("within", before(W.partitionBy("queue", "part").orderBy(F.col("source").isNull(), "source")))
    parts = rows.groupBy("queue", "block", "part").agg(F.sum("n").alias("n"))
    blocks = parts.groupBy("queue", "block").agg(F.sum("n").alias("n"))
    parts = parts.withColumn("part_start", before(W.partitionBy("queue", "block").orderBy("part"))).drop("n")
    blocks = blocks.withColumn("block_start", before(W.partitionBy("queue").orderBy("block"))).drop("n")
    placed = within.join(parts, ["queue", "block", "part"]).join(blocks, ["queue", "block"])
    return placed.select(F.col("part").alias("in_part"), F.col("source").alias("of_source"), "queue", (F.col("within") + F.col("part_start") + F.col("block_start")).alias("begin"))


def pack(docs: DataFrame, tokenizer: str, targets: Mapping[str | None, float] | None = None, with_ids: bool = False, window: int = WINDOW, grain: int = GRAIN) -> DataFrame:
    """One row for each piece: doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    ``tokenizer`` is the path of a tokenizers file on the driver; targets are shares (0 to 1) of a window by source.
    """
    if not 0 < grain <= window:
        raise ValueError("a turn is at least a token and at most a window")
    made = materialise(tokens(docs, tokenizer), "pack-tokens")
    per_task = materialise(made.groupBy("part", "source").agg(F.sum("n").alias("n")), "pack-tasks")
    queues = _queues(per_task, targets, window)
    totals, weights = np.array([q[2] for q in queues], dtype=np.int64), np.array([q[3] for q in queues], dtype=float)
    # a few numbers for each task and source; Spark broadcasts them where the written table is small enough
    starts = materialise(_starts(per_task, queues), "pack-starts")
    placed = made.join(starts, (made["part"] == starts["in_part"]) & made["source"].eqNullSafe(starts["of_source"]))
    placed = placed.select("doc_id", "source", "queue", (F.col("begin") + F.col("before")).alias("first"), "n", "ids")
    kind = placed.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, n, queue = (batch.column(c).to_numpy().astype(np.int64) for c in ("first", "n", "queue"))
            row, start, length, place = cut(first, n, queue, totals, weights, window, grain)
            whole = [np.frombuffer(x, dtype=f"<u{len(x) // k}").astype("<u4") for x, k in zip(batch.column("ids").to_pylist(), n.tolist())]
            pieces = [whole[r][s : s + k] for r, s, k in zip(row.tolist(), start.tolist(), length.tolist())]
            columns = {
                "doc_id": batch.column("doc_id").take(pa.array(row)), "source": batch.column("source").take(pa.array(row)), "start": pa.array(start), "length": pa.array(length),
                "ids_crc32": pa.array([zlib.crc32(p) for p in pieces], pa.int64()), "doc_tokens": pa.array(n[row]), "sequence_id": pa.array(place // window), "offset": pa.array(place % window),
            }
            if with_ids:
                columns["ids"] = pa.array(pieces, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    schema = f"doc_id {kind}, source string, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return placed.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = PAD_ID) -> DataFrame:
    """sequence_id, n_tokens and ids of each window, from pieces with ids; padded to the window unless it has a power of two tokens."""
    one = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
    power = F.expr("bit_count(n_tokens) = 1")
    return one.withColumn("ids", F.when(power, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad_id), (F.lit(window) - F.col("n_tokens")).cast("int")))))
