"""Source divergence audit: how far the words of each source of a language are from those of its other sources.

1. Terms: texts come as Arrow batches, whose UTF-8 bytes lie behind one another in one buffer.  A lookup table of 256 entries says
   which bytes belong to a term and another lower-cases A-Z, so starts and ends are the places where membership changes.  Slices
   are grouped by their xxhash and held against the bytes of their group's first; where two of one hash differ, bytes decide.
2. Counts: each task adds up (lang, source, term) in bounded tallies before anything is shuffled, with the number of documents
   that hold the term; one aggregation adds the tasks' rows.
3. Kept terms are those of at least ``MIN_DOCS`` documents of the language.
4. Divergences: a language's kept terms are dealt by hash to blocks of about ``BLOCK_ENTRIES`` counts.  A block is one CSR matrix,
   a row for each source of the language; for each source, ``reduceat`` over the rows gives the block's part of the differences from
   all others, zeros by closed form, and its first terms above the language's share.  Blocks' parts are added, and their terms ranked.

Shares are whole billionths, p = 1 + floor(10^9 (count + 5) / (N + 5 V)), taken by long division, so all sums are exact.

Defined cases: null text, lang and source are empty strings; a language without kept terms has pairs of value 0 and no term rows; a
group without terms has pairs like any other; a language of one source has no pairs; equal rows count each; equal values are ranked
by item in UTF-8 order; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, only

MIN_DOCS = 30
TOP_TERMS = 50
SMOOTHING = 5
SCALE = 10**9
#: Counts of a block: some megabytes in its task.
BLOCK_ENTRIES = 65_536
#: Bytes of text that are cut at once; a longer text is cut by itself.
SLAB_BYTES = 4_000_000
#: Different (lang, source, term) that a task holds before it hands them on.
TALLY_ROWS = 300_000
#: Shares of a language's terms when its totals are joined to them.
SALTS = 64

_BYTE = np.arange(256)
_UPPER = (_BYTE >= 0x41) & (_BYTE <= 0x5A)
#: Bytes of terms: letters, and all bytes of signs beyond ASCII.
IN_TERM = _UPPER | ((_BYTE >= 0x61) & (_BYTE <= 0x7A)) | (_BYTE >= 0x80)
LOWER = np.where(_UPPER, _BYTE + 32, _BYTE).astype(np.uint8)


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the terms of texts that lie behind one another; text i is data[offsets[i]:offsets[i + 1]]."""
    inside = IN_TERM[data]
    before = np.zeros(len(data), dtype=bool)
    after = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    after[:-1] = inside[1:]
    full = offsets[:-1] < offsets[1:]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def _places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All byte positions of slices, slice after slice."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)


def group_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest=xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """A number for each slice, equal for equal bytes only, and the first slice of each number."""
    raw = data.tobytes()
    hashes = np.fromiter((digest(raw[s:e]) for s, e in zip(starts.tolist(), ends.tolist())), dtype=np.uint64, count=len(starts))
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    lengths = ends - starts
    same = lengths == lengths[first][number]
    if same.all():
        mine, other = _places(starts, lengths), _places(starts[first][number], lengths)
        same = bool((data[mine] == data[other]).all())
    if not np.all(same):
        # two of one hash: number the slices by their bytes
        known: dict[bytes, int] = {}
        firsts: list[int] = []
        number = np.empty(len(starts), dtype=np.int64)
        for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
            k = known.setdefault(raw[s:e], len(known))
            if k == len(firsts):
                firsts.append(i)
            number[i] = k
        first = np.array(firsts, dtype=np.int64)
    return number, first


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different keys in order, and each value added up by key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return (keys[at], *[np.add.reduceat(v[order], at) for v in values])


class Tally:
    """Counts by (group, term) of one task, numbered as they come, with a bound on what is held."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.terms: dict[bytes, int] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.rows = 0

    def add(self, data: np.ndarray, offsets: np.ndarray, groups: list[tuple[str, str]]) -> None:
        numbers = np.array([self.groups.setdefault(g, len(self.groups)) for g in groups], dtype=np.int64)
        data = LOWER[data]
        starts, ends = boundaries(data, offsets)
        if not len(starts):
            return
        term, first = group_slices(data, starts, ends)
        doc = np.searchsorted(offsets, starts, side="right") - 1
        many = len(first)
        held, count = np.unique(doc * many + term, return_counts=True)
        key, counts, docs = _summed(numbers[held // many] * many + held % many, count, np.ones(len(held), dtype=np.int64))
        raw = data.tobytes()
        names = np.array([self.terms.setdefault(raw[s:e], len(self.terms)) for s, e in zip(starts[first].tolist(), ends[first].tolist())], dtype=np.int64)
        self.parts.append((key // many, names[key % many], counts, docs))
        self.rows += len(key)

    def merge(self) -> None:
        if len(self.parts) > 1:
            group, term, counts, docs = (np.concatenate(x) for x in zip(*self.parts))
            many = len(self.terms)
            key, counts, docs = _summed(group * many + term, counts, docs)
            self.parts = [(key // many, key % many, counts, docs)]
            self.rows = len(key)

    def flush(self) -> pa.RecordBatch:
        """All counts, and each group once with a null term; nothing is held after."""
        self.merge()
        groups = list(self.groups)
        listed = [(np.arange(len(groups)), np.full(len(groups), len(self.terms)), *[np.zeros(len(groups), dtype=np.int64)] * 2)]
        group, term, counts, docs = (np.concatenate(x) for x in zip(*(self.parts + listed)))
        langs, sources = (pa.array([g[i] for g in groups], pa.string()).take(pa.array(group)) for i in (0, 1))
        terms = pa.array([*self.terms, None], pa.binary()).take(pa.array(term))
        self.__init__()
        return pa.RecordBatch.from_arrays([langs, sources, terms, pa.array(counts), pa.array(docs)], names=["lang", "source", "term", "n", "docs"])


def _slabs(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last row, bytes and offsets of runs of texts."""
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None else np.zeros(0, dtype=np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + SLAB_BYTES, side="right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that hold it); each group also has a row of null term."""
    slim = only(docs, "lang", "source", "text")
    slim = slim.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in slim.columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            groups = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist()))
            for low, high, data, offsets in _slabs(batch.column("text").cast(pa.string())):
                tally.add(data, offsets, groups[low:high])
                if tally.rows > TALLY_ROWS:
                    tally.merge()
                    if 2 * tally.rows > TALLY_ROWS:
                        yield tally.flush()
        if tally.groups:
            yield tally.flush()

    found = slim.mapInArrow(run, "lang string, source string, term binary, n bigint, docs bigint")
    return found.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, total: np.ndarray | int, terms: int) -> np.ndarray:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)), exactly: long division, three digits at a time."""
    counts, over = np.asarray(counts), np.asarray(total) + SMOOTHING * terms
    if np.max(over, initial=0) >= 2**63 // 1000:
        counts, over = counts.astype(object), over.astype(object)
    whole, rest = (counts + SMOOTHING) // over, (counts + SMOOTHING) % over
    for _ in range(3):
        digits, rest = rest * 1000 // over, rest * 1000 % over
        whole = whole * 1000 + digits
    return (whole + 1).astype(np.int64)


def _csr(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, height: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row pointers, columns and values of a sparse matrix, row after row."""
    order = np.lexsort((columns, rows))
    return np.searchsorted(rows[order], np.arange(height + 1)), columns[order], values[order]


def _row_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the values of each row; reduceat would give an empty row its neighbour's first value."""
    out = np.zeros(len(starts) - 1, dtype=np.int64)
    full = starts[:-1] < starts[1:]
    if len(values):
        out[full] = np.add.reduceat(values, starts[:-1][full])
    return out


def block_divergences(rows: np.ndarray, columns: np.ndarray, counts: np.ndarray, totals: np.ndarray, terms: int, width: int) -> np.ndarray:
    """For each two sources, the sum over the block's terms of the difference of their shares.

    rows and columns number the block's sources and terms; totals has N of each source, terms is V, width the block's terms.
    """
    height = len(totals)
    starts, columns, counts = _csr(rows, columns, counts, height)
    row = np.repeat(np.arange(height), np.diff(starts))
    values = shares(counts, totals[row], terms)
    zero = shares(np.zeros(height, dtype=np.int64), totals, terms)
    out = np.zeros((height, height), dtype=np.int64)
    for a in range(height):
        own = np.full(width, zero[a])
        mine = slice(starts[a], starts[a + 1])
        own[columns[mine]] = values[mine]
        # as if all other sources had no term here: a's terms, then the rest of the block's
        bare = np.abs(values[mine][:, None] - zero[None, :]).sum(axis=0) if mine.stop > mine.start else np.zeros(height, dtype=np.int64)
        bare = bare + np.abs(zero[a] - zero) * (width - (mine.stop - mine.start))
        at = own[columns]
        out[a] = bare + _row_sums(np.abs(values - at) - np.abs(zero[row] - at), starts)
    return out


def block_terms(source: np.ndarray, names: list[str], counts: np.ndarray, lang_counts: np.ndarray, totals: np.ndarray, lang_total: int, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that are among a source's first ``TOP_TERMS`` of the block above the language's share, and their values."""
    value = shares(counts, totals[source], terms) - shares(lang_counts, lang_total, terms)
    above = np.flatnonzero((value > 0) & (counts > 0))
    if not len(above):
        return above, value
    encoded = [n.encode() for n in names]
    by_name = np.empty(len(names), dtype=np.int64)
    by_name[sorted(range(len(names)), key=encoded.__getitem__)] = np.arange(len(names))
    order = above[np.lexsort((by_name[above], -value[above], source[above]))]
    ranked = source[order]
    begins = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    place = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
    order = order[place < TOP_TERMS]
    return order, value


_PARTS = "lang string, source string, part string, item string, value bigint"


def _audit_block(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """One block of one language: left has its counts, right all sources of the language."""
    lang = key[0].as_py()
    sources = right.column("source").to_pylist()
    totals = np.array(right.column("total").to_pylist(), dtype=np.int64)
    terms, lang_total = right.column("terms")[0].as_py(), right.column("lang_total")[0].as_py()
    number = {s: i for i, s in enumerate(sources)}
    rows = np.array([number[s] for s in left.column("source").to_pylist()], dtype=np.int64)
    names = left.column("term").to_pylist()
    known: dict[str, int] = {}
    columns = np.array([known.setdefault(t, len(known)) for t in names], dtype=np.int64)
    counts = np.array(left.column("n").to_pylist(), dtype=np.int64)
    if len(rows):
        far = block_divergences(rows, columns, counts, totals, terms, len(known))
        chosen, value = block_terms(rows, names, counts, np.array(left.column("lang_n").to_pylist(), dtype=np.int64), totals, lang_total, terms)
    else:
        far, chosen, value = np.zeros((len(sources), len(sources)), dtype=np.int64), np.zeros(0, dtype=np.int64), rows
    a, b = np.nonzero(~np.eye(len(sources), dtype=bool))
    source = [sources[i] for i in a.tolist()] + [sources[i] for i in rows[chosen].tolist()]
    item = [sources[i] for i in b.tolist()] + [names[i] for i in chosen.tolist()]
    values = np.concatenate((far[a, b], value[chosen]))
    kind = ["pair"] * len(a) + ["term"] * len(chosen)
    return pa.table({"lang": pa.array([lang] * len(kind), pa.string()), "source": pa.array(source, pa.string()), "part": pa.array(kind, pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(values, pa.int64())})


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank."""
    counts = materialise(count_terms(docs), "audit-counts")
    found = counts.where("term is not null")
    kept = found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= MIN_DOCS).drop("docs")
    held = materialise(found.drop("docs").join(kept, ["lang", "term"]), "audit-kept")
    # added up by source first, so that a language with most of the rows is not one group
    by_source = held.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("entries"))
    by_lang = by_source.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("entries").alias("entries"))
    salt = F.pmod(F.xxhash64("term"), F.lit(SALTS))
    terms = held.groupBy("lang", salt.alias("salt")).agg(F.countDistinct("term").alias("terms")).groupBy("lang").agg(F.sum("terms").alias("terms"))
    langs = by_lang.join(terms, "lang").withColumn("blocks", F.ceil(F.col("entries") / BLOCK_ENTRIES).cast("int")).drop("entries")
    groups = counts.where("term is null").select("lang", "source").join(by_source.drop("entries"), ["lang", "source"], "left").join(langs, "lang", "left")
    zero = F.lit(0).cast("long")
    groups = groups.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "lang_total", "terms")], F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("block"))
    salted = langs.select("lang", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    # another seed than the salt's, so that blocks are even
    dealt = held.withColumn("salt", salt).join(salted, ["lang", "salt"]).select("lang", F.pmod(F.xxhash64("term", F.lit(1)), F.col("blocks")).cast("int").alias("block"), "source", "term", "n", "lang_n")
    parts = materialise(dealt.groupBy("lang", "block").cogroup(groups.groupBy("lang", "block")).applyInArrow(_audit_block, _PARTS), "audit-parts")
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    by_value = W.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(by_value))
    first = parts.where("part = 'term'").withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= TOP_TERMS)
    return pairs.unionByName(first)


ORACLE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
terms AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM terms GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
counts AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM terms t JOIN kept k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM counts GROUP BY lang, source),
groups AS (SELECT DISTINCT lang, source FROM docs),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * l.v))::BIGINT AS p,
    (1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v))::BIGINT AS q
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN langs l ON g.lang = l.lang
  LEFT JOIN totals t ON g.lang = t.lang AND g.source = t.source
  LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
tops AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item COLLATE "C")::INT AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM tops))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
