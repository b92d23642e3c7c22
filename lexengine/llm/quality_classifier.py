"""Quality classifier: Bradley-Terry scores from preference pairs, thresholded by score quantile.

Each pair prefers a training document of label 1 to one of label 0.  A linear score is learned by logistic
loss on the difference of the two documents' features (Newton steps), over all pairs of all training rows.  The
score's quantile at the share of label 0 among the training rows is the threshold; it is mapped to 0.7, so
``predicted`` is a cut by score quantile, and scores stay between 0 and 1.

Labels are used of all rows whose crc32(doc_id) mod 4 is not 2, and of no others.  Features are made once on the
executors; each pass over them adds up arrays of a fixed size.  Defined cases: null or empty text is scored as a text of no words; without labels of both kinds
all scores are 0.5; equal texts have equal scores; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, materialise, only
from .quality_rules import FEATURES, text_stats
from .training import held_out, known

RIDGE = 1e-3
CUT = 0.7
STEPS, SETTLED = 40, 1e-7
#: Where scores are counted while weights are learned: steps and reach of the grid.
GRID, REACH = 8, 32
#: Sums are of whole numbers, in these units, so that they don't depend on the order of rows.
UNIT, UNIT_SQUARE = 2.0**20, 2.0**16
#: Scores are ordered in units of 2^-20, found in two passes: of 2^-8 within +-64, then within one of these.
COARSE, FINE, WIDEST = 8, 12, 64


def features(data: bytes) -> list[float]:
    """The quality rules' transformed ratios, and a few more of the whole text."""
    stats = text_stats(data)
    n, chars = stats[0], stats[1]
    lines = data.count(b"\n") + 1
    words = data.split()
    distinct = len(set(words))
    return [
        *stats[5:], min(1.0, (data.count(b"|") / (n + 20)) ** 0.5), min(1.0, ((data.count(b".") + data.count(b",")) / (n + 20)) ** 0.5),
        float(np.log1p(n)) / 10, distinct / (n + 20), lines / (n + 20), float(n < 10), (n / (chars + 20)) ** 0.5,
    ]


N_FEATURES = len(FEATURES) + 7


#: Sums over all training rows of what a function makes of some of them: (features, labels) to an array of whole numbers.
Total = Callable[[Callable[[np.ndarray, np.ndarray], np.ndarray]], np.ndarray]


def raw_scores(z: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Column by column, so that equal rows score equally in whatever batch they are."""
    out = np.zeros(len(z))
    for k, w in enumerate(weights):
        out += z[:, k] * w
    return out


def _whole(values: np.ndarray, unit: float) -> np.ndarray:
    return np.rint(values * unit).astype(np.int64)


def _on_grid(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place on the grid below each score, and the share of the place above."""
    at = np.clip((raw + REACH) * GRID, 0, 2 * REACH * GRID - 1e-6)
    low = np.floor(at).astype(np.int64)
    return low, at - low


def _moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.concatenate([[int((y == 0).sum()), int((y == 1).sum())], _whole(x, UNIT * 16).sum(axis=0), _whole(x * x, UNIT * 16).sum(axis=0)])


def _by_place(centre: np.ndarray, scale: np.ndarray, w: np.ndarray) -> Callable:
    """By label and place on the grid the number of rows and the sums of their features."""

    def run(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = (x - centre) / scale
        low, above = _on_grid(raw_scores(z, w))
        one = np.column_stack([np.ones(len(z)), z])
        held = np.zeros((2, 2 * REACH * GRID + 1, one.shape[1]), np.int64)
        np.add.at(held, (y, low), _whole(one * (1 - above)[:, None], UNIT))
        np.add.at(held, (y, low + 1), _whole(one * above[:, None], UNIT))
        return held

    return run


def _squares(centre: np.ndarray, scale: np.ndarray, w: np.ndarray, bend: np.ndarray) -> Callable:
    """By label the sums of products of features, each row weighted by ``bend`` of its label and place."""

    def run(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = (x - centre) / scale
        low, above = _on_grid(raw_scores(z, w))
        weight = bend[y, low] * (1 - above) + bend[y, low + 1] * above
        rows = [_whole(z * (weight * z[:, k])[:, None], UNIT_SQUARE) for k in range(len(w))]
        return np.array([[r[y == label].sum(axis=0) for r in rows] for label in (0, 1)])

    return run


def _counts(centre: np.ndarray, scale: np.ndarray, w: np.ndarray, within: list[int] | None) -> Callable:
    """How many scores there are in each coarse unit, or in each fine one of some coarse units."""

    def run(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = np.floor(np.clip(raw_scores((x - centre) / scale, w), -WIDEST, WIDEST - 2.0**-20) * 2.0 ** (COARSE + FINE)).astype(np.int64)
        coarse = (key >> FINE) + (WIDEST << COARSE)
        if within is None:
            return np.bincount(coarse, minlength=2 * WIDEST << COARSE)
        return np.concatenate([np.bincount(key[coarse == c] & (1 << FINE) - 1, minlength=1 << FINE) for c in within])

    return run


def _quantiles(total: Total, of: tuple, n: int, shares: list[float]) -> list[float]:
    """The scores at the shares of all rows, between two rows in proportion."""
    ranks = sorted({int(r) for s in shares for r in (np.floor(s * (n - 1)), np.ceil(s * (n - 1)))})
    ends = np.cumsum(total(_counts(*of, None)))
    units = [int(np.searchsorted(ends, r, side="right")) for r in ranks]
    within = sorted(set(units))
    fine = total(_counts(*of, within)).reshape(len(within), -1)
    at = {}
    for r, c in zip(ranks, units):
        inside = r - (int(ends[c - 1]) if c else 0)
        at[r] = (((c - (WIDEST << COARSE)) << FINE) + int(np.searchsorted(np.cumsum(fine[within.index(c)]), inside, side="right"))) * 2.0 ** -(COARSE + FINE)
    out = []
    for s in shares:
        low, share = int(np.floor(s * (n - 1))), s * (n - 1) % 1
        out.append(at[low] + (share * (at[low + 1] - at[low]) if share else 0.0))
    return out


def fit_by(total: Total) -> dict | None:
    """Weights and threshold by sums over all training rows; None without both labels.

    All pairs of a row of label 1 and a row of label 0 count.  The loss depends on a row by its features and its score, so pairs are
    summed by places of scores on a grid, each score dealt to the two places beside it: at steps of 1/8 this changes a pair's chance
    by at most 0.0002.
    """
    poor, good, *sums = total(_moments).tolist()
    n = poor + good
    if not poor or not good:
        return None
    mean, square = (np.array(x) / (UNIT * 16) / n for x in (sums[:N_FEATURES], sums[N_FEATURES:]))
    centre, scale = mean, np.maximum(np.sqrt(np.maximum(square - mean * mean, 0)), 1e-3)
    places = np.arange(2 * REACH * GRID + 1) / GRID - REACH
    chance = 1 / (1 + np.exp(-(places[:, None] - places[None, :])))  # of the first before the second
    curve = chance * (1 - chance)
    w = np.zeros(N_FEATURES)
    for _ in range(STEPS):
        held = total(_by_place(centre, scale, w)) / UNIT / np.array([poor, good])[:, None, None]
        (lose, lose_z), (win, win_z) = ((h[:, 0], h[:, 1:]) for h in held)
        gradient = ((chance - 1) @ lose) @ win_z - (win @ (chance - 1)) @ lose_z + RIDGE * w
        of_poor, of_good = total(_squares(centre, scale, w, np.array([win @ curve, curve @ lose]))) / UNIT_SQUARE
        cross = win_z.T @ curve @ lose_z
        step = np.linalg.solve(of_poor / poor + of_good / good - cross - cross.T + RIDGE * np.eye(N_FEATURES), gradient)
        w = w - step
        if abs(step).max() < SETTLED:
            break
    cut, low, high = _quantiles(total, (centre, scale, w), n, [poor / n, 0.25, 0.75])
    return {"centre": centre.tolist(), "scale": scale.tolist(), "weights": w.tolist(), "cut": cut, "spread": max(high - low, 1e-3)}


def fit(rows: list[tuple[list[float], int]]) -> dict | None:
    """The same from (features, label) rows in memory."""
    x = np.array([f for f, _ in rows], float).reshape(-1, N_FEATURES)
    y = np.array([label for _, label in rows], np.int64)
    return fit_by(lambda make: make(x, y))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), N_FEATURES)


def _total(rows: DataFrame) -> Total:
    """Sums over a table (features, label): each task adds up its rows, what comes to the driver is an array of a task."""

    def total(make: Callable) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = None
            for batch in batches:
                if batch.num_rows:
                    part = make(_matrix(batch.column("features")), batch.column("label").to_numpy().astype(np.int64))
                    found = part if found is None else found + part
            if found is not None:
                yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(found.tobytes(), 1)], pa.binary())], names=["sums"])

        # no rows make an array too
        out = make(np.empty((0, N_FEATURES)), np.empty(0, np.int64))
        for r in rows.mapInArrow(run, "sums binary").toLocalIterator(prefetchPartitions=True):
            out = out + np.frombuffer(zlib.decompress(r.sums), np.int64).reshape(out.shape)
        return out

    return total


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted, per document."""
    slim = only(docs, "doc_id", "text")
    kind = T.StructField("features", T.ArrayType(T.DoubleType()))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([features(t) for t in as_bytes(batch.column("text"))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), made], names=["doc_id", "features"])

    # once for training and scoring
    described = materialise(slim.mapInArrow(describe, T.StructType([slim.schema["doc_id"], kind])), "quality-features")
    model = fit_by(_total(materialise(described.join(known(labels, "quality"), "doc_id").select("features", (F.col("label") > 0).cast("int").alias("label")), "quality-training")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.full(batch.num_rows, 0.5)
            if model is not None and batch.num_rows:
                raw = raw_scores((_matrix(batch.column("features")) - np.array(model["centre"])) / np.array(model["scale"]), np.array(model["weights"]))
                at = (raw - model["cut"]) / model["spread"] + float(np.log(CUT / (1 - CUT)))
                scores = np.where(raw >= model["cut"], np.maximum(CUT, 1 / (1 + np.exp(-np.clip(at, -36.0, 36.0)))), 1 / (1 + np.exp(-np.clip(at, -36.0, 36.0))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = described.mapInArrow(run, T.StructType([slim.schema["doc_id"], T.StructField("score", T.DoubleType())]))
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
