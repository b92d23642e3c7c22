"""Near-duplicates by HyperMinHash: compressed registers, banded, estimated, then confirmed on full sets.

1. Each text gives its set of 5-word shingles, a digest of the set, and 128 HyperMinHash registers (leading
   zeros and 10 mantissa bits), packed four to a band.
2. Texts of equal digests form a class with a number of its own, which stands for it from here on.  A third of
   all rows being one text costs one row after a partial aggregation.  Classes of one doc_id are linked.
3. Classes that share a band meet.  In a bucket of at most ``SMALL`` all meet each other; in a larger one each
   meets ``LEADERS`` leaders, the members whose bands are the most shared, found by an aggregation over salted
   rows.  So a bucket gives rows in proportion to its size.
4. Pairs are dropped whose sizes rule out the similarity, or whose collision-corrected estimate is below
   ``LEAST_ESTIMATE``; the rest are confirmed on the full sets.  Components come by star steps.
5. What is in a large bucket but not in its leaders' component could still be linked with a member that
   leads nothing.  These rows are held against all of that crowd: first by their registers, in cells of
   ``CELL_ROWS``, which tell the rows that have a likely partner in another component; then those alone by
   whole sets, in cells of bounded size that return links that join all components which any of the cell's
   pairs joins, fewer than rows.

A true link is lost only if none of 32 bands agrees: 5 in a million at similarity 0.75, less above; or if 128
registers estimate it below ``LEAST_ESTIMATE`` (4 standard errors below 0.75).

Defined cases: null or empty text has an empty set, is linked with nothing and is kept; rows of one doc_id
count as one document, of all their texts; ids may be numbers or text, and the smallest is so by their type's
order; a null doc_id is linked with nothing, its component is null, and it is kept; an empty table gives no
rows; further columns are ignored, and kept by ``keep_one``.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sketches
from .common import as_bytes, lean, materialise, only
from .components import components

PERCENT = 75
LEAST_ESTIMATE = 0.60
SMALL = 8
LEADERS = 4
#: Rows of registers, and shingles, that a cell of the crowd comparison holds of either side, about.
CELL_ROWS = 512
CELL_SHINGLES = 60_000

_SKETCH = "n_shingles long, h1 long, h2 long, bands array<long>"


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest and bands, per document; bands are null for empty sets."""
    slim = only(docs, "doc_id", "text")
    schema = T.StructType([slim.schema["doc_id"], *T._parse_datatype_string(_SKETCH)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, h1, h2, bands = [], [], [], []
            for data in as_bytes(batch.column("text")):
                hashes = sketches.shingle_set(data)
                digest = np.frombuffer(sketches.set_digest(hashes), "<i8")
                sizes.append(len(hashes))
                h1.append(int(digest[0]))
                h2.append(int(digest[1]))
                bands.append(sketches.bands(hashes) if len(hashes) else None)
            columns = [pa.array(sizes, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_shingles", "h1", "h2", "bands"])

    return slim.mapInArrow(lean(run), schema)


def _similar_sizes(n, m):
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def _members(reps: DataFrame) -> DataFrame:
    """band, key, rep, n and bucket size of the buckets with two members or more."""
    banded = reps.select("rep", "n", F.posexplode("bands").alias("band", "key"))
    # a table of its own, so that Spark can split the join's partition of a bucket that holds a third of all rows
    shared = materialise(banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "bucket-sizes")
    return banded.join(shared, ["band", "key"])


def _leaders(members: DataFrame) -> DataFrame:
    """The leaders of the large buckets: of each of ``LEADERS`` shares of the members, the one whose bands are the most shared."""
    large = members.where(F.col("size") > SMALL)
    shared = members.groupBy("rep").agg(F.sum("size").alias("shared"))
    ranked = large.join(shared, "rep").withColumn("share", F.pmod(F.xxhash64("rep"), F.lit(LEADERS)))
    return ranked.groupBy("band", "key", "share").agg(F.max(F.struct("shared", F.col("rep").alias("leader"), F.col("n").alias("leader_n"))).alias("best")).select("band", "key", "best.*")


def _pairs(members: DataFrame, leaders: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of similar sizes that meet in a bucket."""
    small = members.where(F.col("size") <= SMALL).groupBy("band", "key").agg(F.sort_array(F.collect_list(F.struct("rep", "n"))).alias("m"))
    ordered = small.select(F.explode(F.expr("flatten(transform(m, (x, i) -> transform(slice(m, i + 2, size(m)), y -> struct(x.rep as a, x.n as n, y.rep as b, y.n as m))))")).alias("p")).select("p.*")
    # one row per leader and bucket against the bucket's rows: at most LEADERS rows for each member
    led = members.where(F.col("size") > SMALL).join(leaders.select("band", "key", "leader", "leader_n"), ["band", "key"]).where("rep <> leader")
    first = F.col("rep") < F.col("leader")
    led = led.select(
        F.least("rep", "leader").alias("a"), F.when(first, F.col("n")).otherwise(F.col("leader_n")).alias("n"),
        F.greatest("rep", "leader").alias("b"), F.when(first, F.col("leader_n")).otherwise(F.col("n")).alias("m"),
    )
    return ordered.unionByName(led).where(_similar_sizes(F.col("n"), F.col("m"))).distinct()


def _likely(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs whose estimated similarity is at least ``LEAST_ESTIMATE``."""
    a = reps.select(F.col("rep").alias("a"), F.col("bands").alias("bands_a"))
    b = reps.select(F.col("rep").alias("b"), F.col("bands").alias("bands_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, sketches.BANDS) for c in ("bands_a", "bands_b"))
            likely = sketches.estimate(x, y, batch.column("n").to_numpy(), batch.column("m").to_numpy()) >= LEAST_ESTIMATE
            yield batch.select(["a", "b"]).filter(pa.array(likely))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "n", "m", "bands_a", "bands_b").mapInArrow(lean(run), "a long, b long")


class _Sets:
    """Shingle sets of the last texts seen."""

    def __init__(self, keep: int = 48) -> None:
        self.keep, self.sets = keep, OrderedDict()

    def get(self, key: int, data: bytes) -> np.ndarray:
        found = self.sets.pop(key, None)
        if found is None:
            found = sketches.shingle_set(data)
            if len(self.sets) >= self.keep:
                self.sets.popitem(last=False)
        self.sets[key] = found
        return found


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return bool(len(x) and len(y)) and 100 * both >= PERCENT * (len(x) + len(y) - both)


def _confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that are similar enough by their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets()
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            rows = zip(a, b, as_bytes(batch.column("text_a")), as_bytes(batch.column("text_b")))
            keep = [linked(sets.get(i, s), sets.get(j, t)) for i, j, s, t in rows]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(lean(run), "a long, b long")


def _compare_cell(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links that join the same components as all similar pairs of an outsider and a member: a spanning forest, fewer than rows."""
    sets = [sketches.shingle_set((t or "").encode()) for t in pdf["text"]]
    rep, comp, out = pdf["rep"].to_numpy(), pdf["component"].to_numpy(), pdf["outsider"].to_numpy()
    outside, inside = np.flatnonzero(out), np.flatnonzero(~out)
    rows: list[tuple[int, int]] = []
    if len(outside) and len(inside):
        # a shingle that only one row holds can't be shared: leave it out of the count matrix
        values, counts = np.unique(np.concatenate(sets), return_counts=True)
        values = values[counts > 1]
        size = np.array([len(s) for s in sets], float)
        step = max(1, 20_000_000 // max(1, len(values)))

        def matrix(some: np.ndarray) -> np.ndarray:
            out_ = np.zeros((len(some), len(values)), np.float32)
            for r, i in enumerate(some):
                if len(values):
                    at = np.minimum(np.searchsorted(values, sets[i]), len(values) - 1)
                    out_[r, at[values[at] == sets[i]]] = 1
            return out_

        # components of the cell, by number; root names the set that a component has been joined to so far
        number = np.unique(comp, return_inverse=True)[1]
        root = np.arange(number.max() + 1)
        for i0 in range(0, len(inside), step):
            some = inside[i0 : i0 + step]
            right = matrix(some)
            for o0 in range(0, len(outside), step):
                lot = outside[o0 : o0 + step]
                both = matrix(lot) @ right.T
                union = size[lot][:, None] + size[some][None, :] - both
                hit = (100 * both >= PERCENT * union) & (root[number[lot]][:, None] != root[number[some]][None, :]) & (both > 0)
                for r in np.flatnonzero(hit.any(axis=1)):
                    own, at = number[lot[r]], np.flatnonzero(hit[r])
                    # one hit of each set that is not joined yet
                    others, first = np.unique(root[number[some[at]]], return_index=True)
                    new = others != root[own]
                    rows += [(int(rep[lot[r]]), int(rep[some[i]])) for i in at[first[new]]]
                    root[np.isin(root, others[new])] = root[own]
    return pd.DataFrame(rows, columns=["a", "b"], dtype="int64")


def _screen_cell(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rows of a cell, outsiders and members, that are likely similar to one of another component by their registers."""
    registers = np.array(pdf["bands"].tolist(), "<i8").reshape(-1, sketches.BANDS).view("<u2")
    n, comp, out = pdf["n"].to_numpy(), pdf["component"].to_numpy(), pdf["outsider"].to_numpy()
    inside, likely = np.flatnonzero(~out), np.zeros(len(pdf), bool)
    for lot in np.array_split(np.flatnonzero(out), -(-int(out.sum()) * max(1, len(inside)) // 100_000) or 1):
        if not len(lot) or not len(inside):
            continue
        equal = np.zeros((len(lot), len(inside)), np.int16)
        for j in range(sketches.REGISTERS):
            equal += registers[lot, j][:, None] == registers[inside, j][None, :]
        a, b = n[lot][:, None], n[inside][None, :]
        c = sketches.collision_rate(a, b)
        hit = (equal / sketches.REGISTERS - c) / (1 - c) >= LEAST_ESTIMATE
        hit &= (100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b)) & (comp[lot][:, None] != comp[inside][None, :])
        likely[lot] |= hit.any(axis=1)
        likely[inside] |= hit.any(axis=0)
    return pd.DataFrame({"crowd": pdf["crowd"], "rep": pdf["rep"]})[likely]


def _cells(crowd: DataFrame, size, least: int, label: str) -> DataFrame:
    """Rows of crowds dealt to cells (crowd, r, c): each outsider meets each member once; a cell holds about ``least`` of ``size`` of either side."""
    count = F.greatest(F.lit(1), F.ceil(F.col("s") / F.lit(least))).cast("int")
    grid = crowd.groupBy("crowd").agg(F.sum(F.when(F.col("outsider"), size).otherwise(0)).alias("out_n"), F.sum(size).alias("all_n")).where("out_n > 0")
    grid = grid.withColumn("s", F.col("out_n")).withColumn("rows", count).withColumn("s", F.col("all_n")).withColumn("columns", count).select("crowd", "rows", "columns")
    placed = crowd.join(materialise(grid, label), "crowd")
    row, column = F.pmod(F.xxhash64("rep"), F.col("rows")).cast("int"), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("columns")).cast("int")
    everywhere = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = placed.where("outsider").select(*crowd.columns, row.alias("r"), everywhere("columns").alias("c"))
    # an outsider stands among the members too, to be held against the other outsiders
    other = placed.withColumn("outsider", F.lit(False)).select(*crowd.columns, everywhere("rows").alias("r"), column.alias("c"))
    return one.unionByName(other)


def _crowd_links(members: DataFrame, leaders: DataFrame, reps: DataFrame, texts: DataFrame, comps: DataFrame) -> DataFrame:
    """Links between members of large buckets outside their leaders' component and the rest of that crowd."""
    of = comps.select(F.col("node").alias("rep"), "component")
    top = leaders.groupBy("band", "key").agg(F.max(F.struct("shared", "leader")).alias("best")).select("band", "key", F.col("best.leader").alias("rep"))
    crowd_of = materialise(top.join(of, "rep", "left").select("band", "key", F.coalesce("component", "rep").alias("crowd")), "crowds-of-buckets")
    crowd = members.where(F.col("size") > SMALL).select("band", "key", "rep").join(crowd_of, ["band", "key"]).select("crowd", "rep").distinct()
    crowd = crowd.join(of, "rep", "left").withColumn("component", F.coalesce("component", "rep")).withColumn("outsider", F.col("component") != F.col("crowd"))
    crowd = materialise(crowd.join(reps.select("rep", "n"), "rep").select("crowd", "rep", "component", "outsider", "n"), "crowds")
    screened = _cells(crowd, F.lit(1), CELL_ROWS, "grid-of-rows").join(reps.select("rep", "bands"), "rep")
    likely = materialise(screened.groupBy("crowd", "r", "c").applyInPandas(_screen_cell, "crowd long, rep long").distinct(), "likely")
    some = materialise(crowd.join(likely, ["crowd", "rep"], "left_semi"), "likely-crowds")
    cells = _cells(some, F.col("n"), CELL_SHINGLES, "grid-of-shingles").drop("n").join(texts, "rep")
    return cells.groupBy("crowd", "r", "c").applyInPandas(_compare_cell, "a long, b long")


def _texts(docs: DataFrame, reps: DataFrame, several: DataFrame, meeting: DataFrame) -> DataFrame:
    """rep and a text of it, for the classes that meet others."""
    slim = only(docs, "doc_id", "text")
    wanted = reps.join(meeting, "rep", "left_semi").select("rep", F.col("least").alias("doc_id"), "h1", "h2")
    # nearly all ids have one set only, so that any text of the id is right; the others' texts are told apart by digest
    one = slim.join(wanted.join(several, "doc_id", "left_anti").select("rep", "doc_id"), "doc_id").select("rep", "text").dropDuplicates(["rep"])
    unclear = slim.join(several.select("doc_id"), "doc_id", "left_semi").select(F.struct("text").alias("doc_id"), "text")
    told = sketch(unclear).select("doc_id.text", "h1", "h2").join(wanted.join(several, "doc_id", "left_semi"), ["h1", "h2"])
    return materialise(one.unionByName(told.select("rep", "text").dropDuplicates(["rep"])), "texts")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, rep (the number of the class of equal sets) and component_id, one row per row of docs."""
    sketched = materialise(sketch(docs), "sketches")
    full = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = full.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    # numbers are given once, as the table is written
    reps = materialise(reps.withColumn("rep", F.monotonically_increasing_id()), "representatives")
    sets = full.groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("low"), F.max(F.struct("h1", "h2")).alias("high"))
    several = materialise(sets.where("low <> high").select("doc_id", "low"), "ids-of-several-sets")
    numbers = reps.select("h1", "h2", "rep")
    shared = full.select("doc_id", "h1", "h2").join(several, "doc_id").join(numbers.withColumnRenamed("rep", "a"), ["h1", "h2"])
    shared = shared.select("a", F.col("low.h1").alias("h1"), F.col("low.h2").alias("h2")).distinct().join(numbers.withColumnRenamed("rep", "b"), ["h1", "h2"]).select("a", "b")
    members = materialise(_members(reps), "buckets")
    texts = _texts(docs, reps, several, members.select("rep").distinct())
    leaders = materialise(_leaders(members), "leaders")
    links = materialise(_confirm(_likely(_pairs(members, leaders), reps), texts).unionByName(shared), "confirmed")
    comps = materialise(components(links), "components")
    further = materialise(_crowd_links(members, leaders, reps, texts, comps), "crowd-links")
    if not further.isEmpty():
        # join the components that the further links connect
        name = lambda c: F.coalesce(F.col(c), F.col(f"{c[-1]}"))
        named = further.join(comps.select(F.col("node").alias("a"), F.col("component").alias("comp_a")), "a", "left").join(comps.select(F.col("node").alias("b"), F.col("component").alias("comp_b")), "b", "left")
        extra = named.select(name("comp_a").alias("a"), name("comp_b").alias("b"))
        comps = materialise(components(extra.unionByName(comps.select(F.col("node").alias("a"), F.col("component").alias("b")))), "components")
    grouped = materialise(reps.select("h1", "h2", "rep", "least").join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")), "grouped")
    ids = materialise(grouped.groupBy("component").agg(F.min("least").alias("component_id")), "component-ids")
    named = grouped.join(ids, "component").select("h1", "h2", "rep", "component_id")
    out = full.select("doc_id", "n_shingles", "h1", "h2").join(named, ["h1", "h2"]).select("doc_id", "n_shingles", "rep", "component_id")
    rest = sketched.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("rep"), F.col("doc_id").alias("component_id"))
    return out.unionByName(rest)


def find_near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, per document."""
    return classes(docs).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without those that have a near copy of a smaller id, with all columns."""
    dropped = classes(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("dropped_id")).distinct()
    return docs.join(dropped, docs["doc_id"] == dropped["dropped_id"], "left_anti")
