"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters and digits, lower-cased.  A document and a benchmark item are compared when they
share a seed, a window of ``MIN_MATCH`` tokens found by running (Karp-Rabin) hashes; what of the document lies
in seeds of the item is tiled.  Tiling repeatedly marks the longest match that is still unmarked on both
sides, found by running hashes of windows of a length, until none of ``MIN_MATCH`` tokens is left.  Equal windows
are never paired one by one, so texts that repeat a word cost no more than others.  The share of the item's tokens
that tiles cover is its coverage, whatever their order in the document; from ``COVERAGE`` on the document
counts as holding the item.

The index of the benchmark is broadcast in blocks of at most ``BLOCK_CHARS`` characters of items; a larger
benchmark is taken in several blocks, each against all documents.  Documents are not shuffled.

Defined cases: null or empty texts hold nothing; an item without tokens is in no document; an item of fewer
tokens than ``MIN_MATCH`` is one seed as a whole; equal items are reported each; repeated rows are reported
each; an empty table gives no rows; further columns are ignored, and kept by ``drop_contaminated``.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_text, lean, only

MIN_MATCH = 5
COVERAGE = 0.5
#: Characters of benchmark items in an index; it takes about 6 times as many bytes.
BLOCK_CHARS = 8_000_000
_TOKEN = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: The base of running hashes, and its inverse modulo 2^64, by which windows at all places are brought to one.
_ODD = 0xD1342543DE82EF95
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def _rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """Running hashes of all windows of k ids."""
    h = np.zeros(len(ids) - k + 1, np.uint64)
    for i in range(k):
        h = h * _BASE + ids[i : len(ids) - k + 1 + i]
    return h


class Index:
    """Items' tokens as ids, and by window length their seeds: sorted hashes, each with the items and places that have it.

    All of it is arrays but the vocabulary, about 30 bytes a token and 100 a different token.
    """

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        found: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        for item_id, text in items:
            ids = np.array([self.vocabulary.setdefault(t, len(self.vocabulary) + 1) for t in tokens(text)], np.uint64)
            if not len(ids):
                continue
            k = min(MIN_MATCH, len(ids))
            found[k].append((_rolling(ids, k), len(self.items)))
            self.items.append((item_id, ids.astype(np.uint32)))
        self.size = np.array([len(ids) for _, ids in self.items], np.int64)
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for k, some in found.items():
            hashes = np.concatenate([h for h, _ in some])
            item = np.concatenate([np.full(len(h), i, np.int32) for h, i in some])
            place = np.concatenate([np.arange(len(h), dtype=np.int32) for h, _ in some])
            order = np.argsort(hashes, kind="stable")
            seeds, first = np.unique(hashes[order], return_index=True)
            self.seeds[k] = (seeds, np.append(first, len(hashes)), item[order], place[order])

    def held(self, text: str, coverage: float = 0.0) -> Iterator[tuple[int, np.ndarray]]:
        """Items that could be covered so far, each with the document's tokens that lie in seeds of it, in order, as ids; 0 between.

        A different window of the document covers at most its own length of an item wherever it is found, so an item
        with too few of them is left out, however many items share a window.
        """
        get = self.vocabulary.get
        found = [get(t, 0) for t in tokens(text)]
        if not any(found):
            return
        ids = np.array(found, np.uint64)
        for k, (seeds, first, item, _) in self.seeds.items():
            if len(ids) < k:
                continue
            h = _rolling(ids, k)
            at = np.minimum(np.searchsorted(seeds, h), len(seeds) - 1)
            where = np.flatnonzero(seeds[at] == h)
            if not len(where):
                continue
            used, seed = np.unique(at[where], return_inverse=True)
            n = first[used + 1] - first[used]
            rows = np.repeat(first[used] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            held, times = np.unique(item[rows], return_counts=True)
            able = held[np.minimum(times * k, self.size[held]) >= coverage * self.size[held]]
            # the used seeds of each item that is able, items one after another
            of = np.repeat(np.arange(len(used)), n)
            order = np.argsort(item[rows], kind="stable")
            items, of = item[rows][order], of[order]
            bounds = np.searchsorted(items, [able, able + 1])
            for i, low, high in zip(able.tolist(), *bounds.tolist()):
                wanted = np.zeros(len(used), bool)
                wanted[of[low:high]] = True
                starts = where[wanted[seed]]
                yield i, _segments(ids, starts, k)


def _segments(ids: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """The ids in windows of k that begin at ``starts``, with a 0 where they don't meet."""
    inside = np.zeros(len(ids) + 1, np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + k, -1)
    inside = np.cumsum(inside[:-1]) > 0
    # the token behind each stretch stands for what is left out
    keep = inside | np.concatenate(([False], inside[:-1]))
    return np.where(inside, ids, np.uint64(0))[keep]


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


class _Windows:
    """Karp-Rabin hashes of the windows of any length of a sequence, and which of its tokens are marked."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids, self.marked = ids, bytearray(len(ids))
        mixed = ids.astype(np.uint64) * _BASE
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed * _powers(len(ids), _ODD))))
            self.inverse = _powers(len(ids) + 1, _ODD_INVERSE)

    def free(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows of n tokens without a marked one."""
        marks = np.concatenate(([0], np.cumsum(np.frombuffer(self.marked, np.uint8), dtype=np.int64)))
        starts = np.flatnonzero(marks[n:] == marks[: len(marks) - n])
        return starts, (self.sums[starts + n] - self.sums[starts]) * self.inverse[starts]

    def is_free(self, start: int, n: int) -> bool:
        return self.marked.find(1, start, start + n) < 0

    def mark(self, start: int, n: int) -> None:
        self.marked[start : start + n] = b"\1" * n


def _mark_all(doc: _Windows, item: _Windows, n: int) -> int:
    """Marks the matches of n tokens that are free on both sides, in the order of places; their number."""
    (starts, hashes), (places, theirs) = doc.free(n), item.free(n)
    order = np.argsort(theirs, kind="stable")
    theirs, places = theirs[order], places[order]
    low = np.searchsorted(theirs, hashes, "left")
    high = np.searchsorted(theirs, hashes, "right")
    both = np.flatnonzero(low < high)
    # of windows of one hash in the item, those before ``next_`` are marked for good
    next_: dict[int, int] = {}
    found, reached, places = 0, -1, places.tolist()
    for i, begin, end in zip(starts[both].tolist(), low[both].tolist(), high[both].tolist()):
        if i < reached:
            continue
        p = next_.get(begin, begin)
        while p < end and not item.is_free(places[p], n):
            p += 1
        next_[begin] = p
        # equal hashes of different windows are told apart here
        while p < end and not (item.is_free(places[p], n) and np.array_equal(doc.ids[i : i + n], item.ids[places[p] : places[p] + n])):
            p += 1
        if p < end:
            doc.mark(i, n)
            item.mark(places[p], n)
            found, reached = found + 1, i + n
    return found


def tile(doc: np.ndarray, item: np.ndarray, least: int) -> list[int]:
    """Lengths of the greedy tiles: again and again the longest match that is free on both sides, the first in the document of equal
    ones, and of these the first in the item, until none of ``least`` tokens is left.

    A part of a free match is one too, so the longest length is found by halving; each step reads both sides once.
    """
    a, b, out = _Windows(doc), _Windows(item), []

    def any_free(n: int) -> bool:
        mine, theirs = a.free(n)[1], b.free(n)[1]
        return bool(len(mine) and len(theirs) and np.isin(theirs, mine).any())

    most = min(len(doc), len(item))
    while most >= least and any_free(least):
        low, high = least, most
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if any_free(middle) else (low, middle - 1)
        out += [low] * _mark_all(a, b, low)
        most = low - 1
    return out


def compare(text: str, index: Index, coverage: float = COVERAGE) -> list[tuple[int, float, int, int]]:
    """(item_id, coverage, number of tiles, longest tile) of the items that the text holds."""
    out = []
    for item, doc in index.held(text, coverage):
        item_id, ids = index.items[item]
        tiles = tile(doc, ids.astype(np.uint64), min(MIN_MATCH, len(ids)))
        share = sum(tiles) / len(ids)
        if tiles and share >= coverage:
            out.append((item_id, share, len(tiles), max(tiles)))
    return sorted(out, key=lambda x: (x[0] is None, x[0]))


def _blocks(benchmark: DataFrame) -> Iterator:
    """Broadcast indexes of the benchmark's blocks; one block unless its texts are over BLOCK_CHARS."""
    items = only(benchmark, "item_id", "text").where(F.col("text").isNotNull())
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n
    n = -(-chars // BLOCK_CHARS) or 1
    for k in range(n):
        # a block holds about BLOCK_CHARS characters
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield benchmark.sparkSession.sparkContext.broadcast(Index(sorted(((r.item_id, r.text) for r in block.collect()), key=lambda x: (x[0] is None, x[0], x[1]))))


def find(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles and longest, for each document and item that it holds."""
    slim = only(docs, "doc_id", "text")
    item_type = benchmark.schema["item_id"].dataType
    schema = T.StructType([slim.schema["doc_id"], T.StructField("item_id", item_type), *T._parse_datatype_string("coverage double, n_tiles int, longest int")])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def against(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(i, *x) for i, t in zip(batch.column("doc_id").to_pylist(), as_text(batch.column("text"))) for x in compare(t, index.value, coverage)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

        return slim.mapInArrow(lean(run), schema)

    out = None
    for index in _blocks(benchmark):
        part = against(index)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The documents that hold no item of the benchmark, with all their columns."""

    def without(rows: DataFrame, index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not compare(t, index.value, coverage) for t in as_text(batch.column("text"))], pa.bool_()))

        return rows.mapInArrow(lean(run), rows.schema)

    for index in _blocks(benchmark):
        docs = without(docs, index)
    return docs
