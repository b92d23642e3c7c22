"""Embedding whitening from a tiled covariance.

1. Entries c become whole numbers x = floor(256 c); equal vectors are fitted once.  Vectors travel packed, each in the least of 1, 2,
   4 or 8 bytes an entry that holds it, so equal vectors have equal bytes.
2. Sums by dimension, exact, and with them the whole number next to each mean.  Vectors are centred by it before anything is
   multiplied; the rest of the mean, half a unit at most, is taken off exactly at the end.
3. Dimensions are cut into column blocks of ``TILE`` and vectors into row blocks of ``ROWS`` or so; each pair of column blocks is a
   tile key.  A vector's column blocks are shuffled to the tiles that they are part of by row block, each task multiplies the two
   column blocks of a tile for one row block, and products are summed per tile, cell by cell.
4. The assembled covariance, whole numbers over n^2, is as exact as doubles are; its eigenvectors are taken on the driver (d^2 numbers).

Products and sums are whole numbers in limbs of 32 bits, so the covariance and the components are the same at every run.

Defined cases: rows whose vector is null or holds null, infinite or NaN entries are dropped; entries beyond a long's range
are held at its ends; vectors of another length than that of most different ones (the longer of two as frequent) are dropped as well;
equal rows give equal results and count once in the fit; fewer than ``COMPONENTS`` dimensions have as many components; a component of
variance 0 (to rounding) has null whitened values, and with a trace of 0 explained is null; a deviation beyond a long is null (the
operator's own column is a decimal); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, only

SCALE = 256
COMPONENTS = 4
#: Least dimensions of a column block, and most column blocks: a vector's entries go to at most so many tiles.
TILE, MAX_BLOCKS = 32, 8
#: Vectors of a row block, about, for the least column blocks, two of which take 16 MB; fewer for wider ones.
ROWS = 32_768
#: Vectors that are cut into column blocks at once.
PIECE_ROWS = 8_192
#: Limbs of 32 bits; five hold sums of products of longs.
LIMBS = 5
#: Largest entries of which doubles multiply and add a row block exactly, and of which longs do.
_DOUBLE, _LONG = 1 << 18, 1 << 23


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """floor(256 c) as longs; beyond their range, its ends."""
    scaled = np.floor(values.astype(np.float64) * SCALE)
    edge = 2.0**63
    out = np.where(np.abs(scaled) < edge, scaled, 0).astype(np.int64)
    out[scaled >= edge] = np.iinfo(np.int64).max
    out[scaled <= -edge] = np.iinfo(np.int64).min
    return out


def packed(x: np.ndarray) -> list[bytes]:
    """Each row as bytes, behind one byte that says how many an entry takes."""
    high, low = x.max(axis=1, initial=0), x.min(axis=1, initial=0)
    size = np.full(len(x), 8)
    for k in (4, 2, 1):
        size[(high < 1 << (8 * k - 1)) & (low >= -(1 << (8 * k - 1)))] = k
    out: list[bytes] = [b""] * len(x)
    for k in (1, 2, 4, 8):
        rows = np.flatnonzero(size == k)
        raw, mark, width = x[rows].astype(f"<i{k}").tobytes(), bytes([k]), k * x.shape[1]
        for i, r in enumerate(rows.tolist()):
            out[r] = mark + raw[i * width : (i + 1) * width]
    return out


def unpacked(rows: list[bytes], dims: int) -> np.ndarray:
    """The rows, all of as many dimensions, as longs."""
    out = np.empty((len(rows), dims), dtype=np.int64)
    by_size: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        by_size.setdefault(r[0], []).append(i)
    for k, at in by_size.items():
        out[at] = np.frombuffer(b"".join([rows[i][1:] for i in at]), dtype=f"<i{k}").reshape(len(at), dims)
    return out


def _limbs(values: np.ndarray) -> list[list[int] | np.ndarray]:
    """Whole numbers, longs or Python's, in limbs from the lowest; only the last is signed."""
    out = []
    for k in range(LIMBS):
        last = k == LIMBS - 1
        out.append((values if last else values & 0xFFFFFFFF).astype(np.int64))
        values = values >> 32
    return out


def _joined(limbs) -> int:
    return sum(int(x) << (32 * k) for k, x in enumerate(limbs))


_LIMB_COLUMNS = [f"limb{k}" for k in range(LIMBS)]
_LIMB_SCHEMA = ", ".join(f"{c} bigint" for c in _LIMB_COLUMNS)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a^T b in whole numbers: by doubles or longs where they are exact, else by Python's."""
    if not len(a):
        return np.zeros((a.shape[1], b.shape[1]), dtype=np.int64)
    if a.dtype != object and b.dtype != object:
        # the products of a few rows at a time, so that neither kind overflows
        most = max(int(a.max()), -int(a.min()), int(b.max()), -int(b.min()), 1)
        if most <= _DOUBLE:
            step = max(1, (1 << 53) // most**2)
            return sum((a[i : i + step].astype(np.float64).T @ b[i : i + step].astype(np.float64)).astype(np.int64) for i in range(0, len(a), step))
        if most <= _LONG and len(a) * most**2 < 1 << 62:
            return a.T @ b
    return a.astype(object).T @ b.astype(object)


def packed_vectors(embeddings: DataFrame, *keys: str) -> DataFrame:
    """The keys, d (dimensions) and x (packed), for rows whose vector is whole and finite."""
    slim = only(embeddings, *keys, "embedding")
    vector = F.col("embedding").cast("array<double>")
    slim = slim.withColumn("embedding", vector).where("embedding is not null and forall(embedding, c -> c is not null and not isnan(c) and abs(c) < double('Infinity'))")
    types = {c: slim.schema[c].dataType.simpleString() for c in keys}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            values = column.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(lengths) - lengths
            x: list[bytes] = [b""] * len(lengths)
            for d in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == d)
                for r, p in zip(rows.tolist(), packed(whole_numbers(values[starts[rows][:, None] + np.arange(d)]))):
                    x[r] = p
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keys], pa.array(lengths, pa.int64()), pa.array(x, pa.binary())], names=[*keys, "d", "x"])

    return slim.mapInArrow(run, ", ".join([*[f"`{c}` {t}" for c, t in types.items()], "d bigint", "x binary"]))


def dimension_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """n and the sums by dimension of the vectors of the commonest length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("d").to_numpy()
            rows = batch.column("x").to_pylist()
            for d in np.unique(lengths).tolist():
                x = unpacked([rows[i] for i in np.flatnonzero(lengths == d).tolist()], d)
                limbs = [s.sum(axis=0) for s in _limbs(x)]
                # dimension -1 counts vectors, so that those of no dimension are counted too
                counted = [np.concatenate(([len(x) if k == 0 else 0], s)) for k, s in enumerate(limbs)]
                yield pa.RecordBatch.from_arrays([pa.array([d] * (d + 1), pa.int64()), pa.array(range(-1, d), pa.int64()), *[pa.array(c, pa.int64()) for c in counted]], names=["d", "dim", *_LIMB_COLUMNS])

    sums = fit.mapInArrow(run, f"d bigint, dim bigint, {_LIMB_SCHEMA}").groupBy("d", "dim").agg(*[F.sum(c).alias(c) for c in _LIMB_COLUMNS])
    sums = materialise(sums, "whiten-sums")
    commonest = sums.where("dim = -1").orderBy(F.col("limb0").desc(), F.col("d").desc()).first()
    if commonest is None:
        return 0, []
    rows = sums.where((F.col("d") == commonest.d) & (F.col("dim") >= 0)).orderBy("dim").collect()
    return commonest.limb0, [_joined([r[c] for c in _LIMB_COLUMNS]) for r in rows]


def _centred(x: np.ndarray, centre: list[int]) -> np.ndarray:
    """x less the centre; in Python's whole numbers where longs might not do."""
    wide = max(int(x.max(initial=0)), -int(x.min(initial=0)), *[abs(c) for c in centre], 0) >= 1 << 62
    return x.astype(object) - np.array(centre, dtype=object) if wide else x - np.array(centre, dtype=np.int64)


def _pack_block(x: np.ndarray) -> bytes:
    high, low = int(x.max(initial=0)), int(x.min(initial=0))
    k = next(k for k in (1, 2, 4, 8) if k == 8 or (high < 1 << (8 * k - 1) and low >= -(1 << (8 * k - 1))))
    return bytes([k]) + x.astype(f"<i{k}").tobytes()


def _unpack_block(cells: bytes, width: int) -> np.ndarray:
    return np.frombuffer(cells, dtype=f"<i{cells[0]}", offset=1).reshape(-1, width).astype(np.int64)


def tile_products(fit: DataFrame, n: int, centre: list[int], tile: int, rows: int) -> DataFrame:
    """i, j and the sum of products of the centred dimensions i and j, in limbs, for all tiles from the diagonal up."""
    dims = len(centre)
    column_blocks = -(-dims // tile)
    width = [min(tile, dims - c * tile) for c in range(column_blocks)]
    row_block = F.pmod(F.xxhash64("x"), F.lit(-(-n // rows))).cast("int")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the table that is read is a written one, so a task that is repeated gives its pieces the same names
        part, piece = TaskContext.get().partitionId(), 0
        for batch in batches:
            blocks, vectors = batch.column("row_block").to_numpy(), batch.column("x").to_pylist()
            for at in range(0, len(vectors), PIECE_ROWS):
                x, own = unpacked(vectors[at : at + PIECE_ROWS], dims), blocks[at : at + PIECE_ROWS]
                out: list[tuple[int, int, int, bytes]] = []
                for b in np.unique(own).tolist():
                    mine = x[own == b]
                    out += [(b, c, piece, _pack_block(mine[:, c * tile : (c + 1) * tile])) for c in range(column_blocks)]
                    piece += 1
                block, column, number, cells = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(column, pa.int32()), pa.array([part] * len(out), pa.int64()), pa.array(number, pa.int64()), pa.array(cells, pa.binary())], names=["row_block", "column_block", "part", "piece", "cells"])

    def multiply(key: tuple, group: pa.Table) -> pa.Table:
        a, b = key[1].as_py(), key[2].as_py()
        pieces: dict[int, dict[tuple[int, int], bytes]] = {a: {}, b: {}}
        for c, part, piece, cells in zip(*[group.column(k).to_pylist() for k in ("column_block", "part", "piece", "cells")]):
            pieces[c][part, piece] = cells
        total: np.ndarray | int = 0
        for p, cells in pieces[a].items():
            left = _centred(_unpack_block(cells, width[a]), centre[a * tile : a * tile + width[a]])
            right = left if a == b else _centred(_unpack_block(pieces[b][p], width[b]), centre[b * tile : b * tile + width[b]])
            total = total + product(left, right)
        i, j = np.meshgrid(np.arange(width[a]) + a * tile, np.arange(width[b]) + b * tile, indexing="ij")
        return pa.table([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), *[pa.array(v, pa.int64()) for v in _limbs(total.ravel())]], names=["i", "j", *_LIMB_COLUMNS])

    blocks = fit.select(row_block.alias("row_block"), "x").mapInArrow(cut, "row_block int, column_block int, part bigint, piece bigint, cells binary")
    # each column block goes to the tiles that it has with all others and itself
    keyed = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(column_blocks - 1))))
    keyed = keyed.select("row_block", F.least("column_block", "other").alias("tile_a"), F.greatest("column_block", "other").alias("tile_b"), "column_block", "part", "piece", "cells")
    products = keyed.groupBy("row_block", "tile_a", "tile_b").applyInArrow(multiply, f"i int, j int, {_LIMB_SCHEMA}")
    return products.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in _LIMB_COLUMNS])


@dataclass
class Model:
    """What whitens: vectors and variances of the components, and the exact sums of the fit."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    vectors: np.ndarray
    variances: np.ndarray
    explained: list[float | None]
    identity_error: float | None = None

    @property
    def dims(self) -> int:
        return len(self.sums)

    @property
    def centre(self) -> list[int]:
        return [(2 * s + self.n) // (2 * self.n) for s in self.sums]

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """(x - S / n) on each component, over the root of its variance; NaN where that is 0."""
        rest = np.array([float(Fraction(s, self.n) - c) for s, c in zip(self.sums, self.centre)])
        scale = np.where(self.variances > 0, 1 / np.sqrt(np.where(self.variances > 0, self.variances, 1)), np.nan)
        return (_centred(x, self.centre).astype(np.float64) - rest) @ self.vectors * scale

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2, exactly."""
        if not len(x):
            return []
        most = self.n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max(map(abs, self.sums), default=0)
        if most**2 * max(self.dims, 1) < 1 << 63:
            return ((self.n * x - np.array(self.sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
        return ((self.n * x.astype(object) - np.array(self.sums, dtype=object)) ** 2).sum(axis=1).tolist()


def fit(embeddings: DataFrame, components: int = COMPONENTS, tile: int | None = None, rows: int | None = None) -> Model | None:
    """The model of a table's different vectors; None if there are none.  A tile is at least an eighth of the dimensions."""
    different = materialise(packed_vectors(embeddings).distinct(), "whiten-fit")
    n, sums = dimension_sums(different)
    if not n:
        return None
    dims = len(sums)
    different = different.where(F.col("d") == dims)
    model = Model(n, sums, np.zeros((dims, dims)), np.zeros((dims, 0)), np.zeros(0), [])
    if not dims:
        return model
    tile = tile or max(TILE, -(-dims // MAX_BLOCKS))
    found = tile_products(different, n, model.centre, tile, rows or max(1, TILE * ROWS // tile)).collect()  # dims^2 numbers
    over = [s - n * c for s, c in zip(sums, model.centre)]
    for r in found:
        # whole numbers over n^2: the quotient is the double next to it
        model.covariance[r.i, r.j] = model.covariance[r.j, r.i] = (n * _joined([r[c] for c in _LIMB_COLUMNS]) - over[r.i] * over[r.j]) / (n * n)
    values, vectors = np.linalg.eigh(model.covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    trace = float(np.trace(model.covariance))
    model.vectors = vectors * signs
    model.variances = np.where(values > max(values[0], 0) * dims * np.finfo(float).eps * 4, values, 0.0)
    model.explained = [float(v) / trace if trace else None for v in model.variances]
    model.identity_error = _identity_error(different, model)
    return model


def _identity_error(different: DataFrame, model: Model) -> float | None:
    """The largest entry of the covariance of the whitened fit less the identity, over components that vary."""
    live = np.flatnonzero(model.variances > 0).tolist()
    if not live:
        return None
    dims, k = model.dims, len(live)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = model.whiten(unpacked(batch.column("x").to_pylist(), dims))[:, live]
            # the last row and column hold sums
            w = np.hstack([w, np.ones((len(w), 1))])
            i, j = np.meshgrid(range(k + 1), range(k + 1), indexing="ij")
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array((w.T @ w).ravel())], names=["i", "j", "s"])

    sums = np.zeros((k + 1, k + 1))
    for r in different.mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        sums[r.i, r.j] = r.s / model.n
    covariance = sums[:k, :k] - np.outer(sums[k, :k], sums[k, :k])
    return float(np.abs(covariance - np.eye(k)).max())


_SCHEMA = "n bigint, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"


def whiten(embeddings: DataFrame, components: int = COMPONENTS, key: str = "vec_id", tile: int | None = None, rows: int | None = None) -> DataFrame:
    """The key, n, deviation, whitened and explained (a number for each component) and identity_error, per row that is kept."""
    keyed = packed_vectors(embeddings, key)
    kind = keyed.schema[key].dataType.simpleString()
    model = fit(embeddings, components, tile, rows)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], f"`{key}` {kind}, {_SCHEMA}")
    shared = embeddings.sparkSession.sparkContext.broadcast(model)  # dims^2 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            x = unpacked(batch.column("x").to_pylist(), m.dims)
            whitened = [[None if np.isnan(v) else v for v in row] for row in m.whiten(x).tolist()]
            deviation = pa.array([v if v < 10**38 else None for v in m.deviations(x)], pa.decimal128(38, 0))
            columns = [batch.column(key), pa.array([m.n] * len(x), pa.int64()), deviation, pa.array(whitened, pa.list_(pa.float64())), pa.array([m.explained] * len(x), pa.list_(pa.float64())), pa.array([m.identity_error] * len(x), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "n", "deviation", "whitened", "explained", "identity_error"])

    return keyed.where(F.col("d") == model.dims).mapInArrow(run, f"`{key}` {kind}, {_SCHEMA}")


def by_component(embeddings: DataFrame) -> DataFrame:
    """One row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = whiten(embeddings).withColumn("each", F.explode(F.arrays_zip("whitened", "explained", F.expr("transform(whitened, (w, i) -> i + 1)").alias("component"))))
    return rows.select("vec_id", F.col("each.component").cast("int").alias("component"), "n", F.expr("try_cast(deviation as bigint)").alias("deviation"), F.col("each.whitened").alias("whitened"), F.col("each.explained").alias("explained"), "identity_error")
