"""Quality rules: base rules, then robust multivariate outliers by minimum covariance determinant.

Each document gives a vector of square-root ratios (symbols, capitals, digits, repeats ...).  For every
(language, source) group the share ``H`` of its rows is sought whose covariance, floors added, has the least
determinant:

1. Three starts need no chance: medians and quartile ranges alone, and with them the correlations of
   hyperbolic tangents and of spatial signs of the standardised rows.
2. A concentration step ranks the group's rows by Mahalanobis distance and takes mean and covariance of the
   nearest share.  Steps are repeated for all groups and starts until no determinant falls any more.
3. Of a group's starts that with the least determinant stays.  Its covariance is scaled by the consistency
   factor of the share, and a document is rejected beyond the chi-square quantile of ``TAIL``.

A step is one aggregation: rows are summed per (group, start, distance bin), bins are cumulated up to the share,
the last one in part, and their sums give the next mean and covariance, so no group is ever gathered in one task.

Defined cases: null or empty text has no words and fails the base rules; null lang or source are groups of
their own; a group of few rows is shrunk towards the estimate of all rows; equal rows count each by
itself; an empty table gives no rows; further columns are ignored by ``judge`` and kept by ``keep_good``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, lean, materialise, only

SYMBOLS = b"#*$%&|<>"
FEATURES = ("f_symbol", "f_upper", "f_digit", "f_bang", "f_adjacent", "f_repeat", "f_lines", "f_length")
P = len(FEATURES)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
#: Smallest standard deviation that a feature is taken to have; keeps degenerate features (all zero) from rejecting on noise,
#: and repeats below the base rules' limit from rejecting by themselves.
FLOOR = np.array([0.04, 0.06, 0.06, 0.05, 0.06, 0.10, 0.15, 0.06])
#: Share of a group that the estimate rests on.
H = 0.7
#: Steps end when no group's log determinant falls by more than this, or after so many; the least found is kept.
FALL = 1e-2
MOST_STEPS = 25
#: Weight, in rows, of the estimate of all rows in each group's.
PRIOR_ROWS = 60.0
#: Chance that a document of normally distributed statistics is rejected.
TAIL = 3e-6
#: Bins of distances to an octave.
BINS = 12
#: More groups than this are joined by a shuffle rather than broadcast (a row of models is about 3 KB).
MAX_BROADCAST_GROUPS = 5_000
#: Sums that a task holds before it hands them on.
MOST_SUMS = 50_000

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " + ", ".join(f"{f} double" for f in FEATURES)


def text_stats(data: bytes) -> tuple:
    """Counts and transformed statistics of one whole text."""
    words = data.split()
    n = len(words)
    packed = b"".join(words)
    chars = len(packed.decode("utf-8", "replace"))
    n_symbols = len(packed) - len(packed.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    n_dup = n_lines = 0
    for line in data.split(b"\n"):
        if not line.strip():
            continue
        n_lines += 1
        if line in seen:
            n_dup += 1
        else:
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    n_repeat = 0
    if len(set(windows)) < len(windows):
        counts = Counter(windows)
        covered = 0
        for i, w in enumerate(windows):
            if counts[w] > 1:
                n_repeat += i + 5 - max(covered, i)
                covered = i + 5
    adjacent = sum(map(bytes.__eq__, words, words[1:]))
    upper = len(packed) - len(packed.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digit = len(packed) - len(packed.translate(None, b"0123456789"))
    ratios = (
        n_symbols / (chars + 60), upper / (chars + 60), digit / (chars + 200), packed.count(b"!") / (chars + 60),
        adjacent / (n + 20), n_repeat / (n + 20), n_dup / (n_lines + 4), chars / (n + 1) / 100,
    )
    # multiples of 1/1024, so that sums do not depend on their order
    return (n, chars, n_symbols, n_dup, n_repeat, *(round(r**0.5 * 1024) / 1024 for r in ratios))


def _stats_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema, keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [text_stats(x) for x in as_bytes(batch.column("text"))]
        columns = [batch.column(c) for c in keep]
        columns += [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * (len(schema) - len(keep)), list(schema)[len(keep) :])]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def stats(docs: DataFrame, *keep: str) -> DataFrame:
    """One row per document: the kept columns, the counts and the transformed statistics."""
    from pyspark.sql.pandas.types import to_arrow_schema

    source = docs.select(*[F.col(f"`{c}`") for c in keep], *([] if "text" in keep else ["text"]))
    schema = T.StructType([source.schema[c] for c in keep] + list(T._parse_datatype_string(STATS)))
    arrow = to_arrow_schema(schema)
    names = list(keep)
    return source.mapInArrow(lean(lambda it: _stats_batches(it, arrow, names)), schema)


def chi_square(x: float, freedom: int) -> float:
    """The chi-square distribution function, for an even number of degrees of freedom."""
    term = total = 1.0
    for k in range(1, freedom // 2):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def chi_square_quantile(share: float, freedom: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, freedom) < share else (low, mid)
    return high


#: Makes the covariance of the nearest share that of all rows, where these are normally distributed.
CONSISTENCY = H / chi_square(chi_square_quantile(H, P), P + 2)
#: Squared Mahalanobis distance beyond which a document is rejected.
CUTOFF = chi_square_quantile(1 - TAIL, P)


def estimate(n: float, sums, products) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance from a count, sums and sums of products."""
    mean = np.array(sums, float) / max(n, 1e-9)
    cov = np.zeros((P, P))
    for (i, j), v in zip(PAIRS, products):
        cov[i, j] = cov[j, i] = v / max(n, 1e-9) - mean[i] * mean[j]
    return mean, cov


def shape(cov: np.ndarray) -> np.ndarray:
    """The covariance made consistent for the share, with the floors added; always invertible."""
    return cov * CONSISTENCY + np.diag(FLOOR**2)


def log_determinant(cov: np.ndarray) -> float:
    return float(np.linalg.slogdet(shape(cov))[1])


GROUP = "g string"
#: The group of all rows; that of a language and source is a JSON object.
ALL = "all"
MODELS = f"{GROUP}, models array<struct<n: double, sums: array<double>, products: array<double>, mean: array<double>, inverse: array<double>, size: double>>, fall double"


def _distance(x: list[Column], mean: Column, inverse: Column) -> Column:
    gap = [a - mean[i] for i, a in enumerate(x)]
    total = F.lit(0.0)
    for i, j in PAIRS:
        total = total + gap[i] * gap[j] * inverse[i * P + j] * (1.0 if i == j else 2.0)
    return total


def group_of(lang: str = "lang", source: str = "source") -> Column:
    """The name of a row's group; null languages and sources are told from all others."""
    return F.to_json(F.struct(F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source")))


def _with_model(rows: DataFrame, models: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(models) if models.count() <= MAX_BROADCAST_GROUPS else models, "g", "left")


Known = Callable[[np.ndarray, list], list[tuple[np.ndarray, np.ndarray]]]


def _summed(rows: DataFrame, models: DataFrame, column: str, measure: Known) -> DataFrame:
    """n, sums and products of (group, start, bin): measure gives, for some rows of one group, a bin and a vector of each by start.

    Rows are summed within each task before they are shuffled.
    """
    few = models.count() <= MAX_BROADCAST_GROUPS
    held = rows.sparkSession.sparkContext.broadcast({r.g: r[column] for r in models.select("g", column).collect()}) if few else None
    rows = rows if few else _with_model(rows, models.select("g", column))
    schema = f"{GROUP}, start int, bin int, n long, sums array<double>, products array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            keys, values = list(total), np.array(list(total.values())).reshape(-1, 1 + P + len(PAIRS))
            total.clear()
            columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32()))]
            columns += [pa.array(values[:, 0].astype(np.int64)), pa.array(values[:, 1 : 1 + P].tolist(), pa.list_(pa.float64())), pa.array(values[:, 1 + P :].tolist(), pa.list_(pa.float64()))]
            return pa.RecordBatch.from_arrays(columns, names=["g", "start", "bin", "n", "sums", "products"])

        for batch in batches:
            x = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in FEATURES])
            groups: dict[str, list[int]] = {}
            for i, g in enumerate(batch.column("g").to_pylist()):
                groups.setdefault(g, []).append(i)
            for g, at in groups.items():
                model = held.value[g] if few else batch.column(column)[at[0]].as_py()
                for start, (bins, vectors) in enumerate(measure(x[at], model)):
                    values = np.column_stack([np.ones(len(at)), vectors, *[vectors[:, i] * vectors[:, j] for i, j in PAIRS]])
                    order = np.argsort(bins, kind="stable")
                    cuts = np.flatnonzero(np.diff(bins[order], prepend=-1))
                    for b, v in zip(bins[order][cuts].tolist(), np.add.reduceat(values[order], cuts, axis=0)):
                        key = (g, start, b)
                        total[key] = total[key] + v if key in total else v
            if len(total) > MOST_SUMS:
                yield flush()
        yield flush()

    sums = lambda c, n: F.array(*[F.sum(F.col(c)[i]) for i in range(n)]).alias(c)
    return rows.mapInArrow(lean(run), schema).groupBy("g", "start", "bin").agg(F.sum("n").alias("n"), sums("sums", P), sums("products", len(PAIRS)))


def _as_model(n: float, sums, products, mean: np.ndarray, spread: np.ndarray, size: float) -> dict:
    """spread is the matrix that distances are measured by; size the log determinant, infinite before the first step."""
    return {"n": float(n), "sums": list(map(float, sums)), "products": list(map(float, products)), "mean": mean.tolist(), "inverse": np.linalg.inv(spread).ravel().tolist(), "size": size}


def _start(rows: DataFrame) -> DataFrame:
    """Each group's starts; exact quartiles and sums, so that they depend on the rows alone."""
    # statistics are multiples of 1/1024, so a quartile keeps few different values
    at = rows.groupBy("g").agg(F.array(*[F.percentile(f, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))) for f in FEATURES]).alias("quartiles"))
    at = materialise(at, "quality-quartiles")

    def placed(quartiles) -> tuple[np.ndarray, np.ndarray]:
        q = np.array([list(x) for x in quartiles], float)
        return q[:, 1], np.sqrt(((q[:, 2] - q[:, 0]) / 1.349) ** 2 + FLOOR**2)

    def measure(x: np.ndarray, quartiles) -> list[tuple[np.ndarray, np.ndarray]]:
        centre, scale = placed(quartiles)
        z = (x - centre) / scale
        sign = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
        # rounded, so that sums don't depend on their order
        return [(np.zeros(len(x), int), np.round(v * 2**16) / 2**16) for v in (np.tanh(z), sign)]

    made = _summed(rows, at, "quartiles", measure).groupBy("g").agg(F.sort_array(F.collect_list(F.struct("start", "n", "sums", "products"))).alias("made"))
    made = _with_model(made, at)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                centre, scale = placed(r.quartiles)
                tanh, sign = r.made
                t = estimate(tanh["n"], tanh["sums"], tanh["products"])[1]
                d = np.sqrt(np.maximum(np.diag(t), 1e-6))
                shapes = [np.eye(P), t / np.outer(d, d), P * estimate(sign["n"], [0.0] * P, sign["products"])[1]]
                zero = ([0.0] * P, [0.0] * len(PAIRS))
                models = [_as_model(0, *zero, centre, s * np.outer(scale, scale) + np.diag(FLOOR**2), float("inf")) for s in shapes]
                out.append((r.g, models, float("inf")))
            yield pd.DataFrame(out, columns=["g", "models", "fall"])

    return made.mapInPandas(lean(run), MODELS)


def _step(rows: DataFrame, models: DataFrame) -> DataFrame:
    """One concentration step of all groups and starts; ``fall`` is the most that a determinant of the group fell."""

    def measure(x: np.ndarray, models) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for m in models:
            gap = x - np.array(m["mean"])
            d = np.einsum("ij,jk,ik->i", gap, np.array(m["inverse"]).reshape(P, P), gap)
            out.append((np.minimum(np.log2(np.maximum(d, 0) + 1) * BINS, 1e6).astype(int), x))
        return out

    bins = _summed(rows, models, "models", measure)
    one = W.partitionBy("g", "start")
    before = F.coalesce(F.sum("n").over(one.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    wanted = F.ceil(F.col("every") * H)
    near = bins.withColumn("before", before).withColumn("every", F.sum("n").over(one)).where(F.col("before") < wanted)
    part = F.least(F.lit(1.0), (wanted - F.col("before")) / F.col("n"))  # of the bin that the share ends in
    kept = near.withColumn("part", part).groupBy("g", "start").agg(
        F.sum(F.col("part") * F.col("n")).alias("n"), F.array(*[F.sum(F.col("part") * F.col("sums")[i]) for i in range(P)]).alias("sums"), F.array(*[F.sum(F.col("part") * F.col("products")[i]) for i in range(len(PAIRS))]).alias("products")
    )
    grouped = kept.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("start", "n", "sums", "products"))).alias("next"))
    grouped = _with_model(grouped, models.select("g", "models"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                models, fall = [], 0.0
                for new, old in zip(r.next, r.models):
                    mean, cov = estimate(new["n"], new["sums"], new["products"])
                    size = log_determinant(cov)
                    if size < old["size"]:
                        fall = max(fall, old["size"] - size)
                        models.append(_as_model(new["n"], new["sums"], new["products"], mean, shape(cov), size))
                    else:
                        models.append({k: list(v) if k not in ("n", "size") else v for k, v in old.items()})
                out.append((r.g, models, fall))
            yield pd.DataFrame(out, columns=["g", "models", "fall"])

    return grouped.mapInPandas(lean(run), MODELS)


def concentrated(rows: DataFrame) -> DataFrame:
    """The least determinant of each group that steps from the starts reach: group, n, sums, products and size."""
    models = materialise(_start(rows), "quality-models")
    for _ in range(MOST_STEPS):
        models = materialise(_step(rows, models), "quality-models")
        if (models.agg(F.max("fall").alias("fall")).first().fall or 0.0) <= FALL:
            break
    return models.select("g", F.array_min(F.transform("models", lambda m: F.struct(m["size"].alias("size"), m["n"].alias("n"), m["sums"].alias("sums"), m["products"].alias("products")))).alias("m")).select("g", "m.*")


def fit(docs: DataFrame, statistics: DataFrame | None = None) -> DataFrame:
    """MCD models, one row per (lang, source), as a scratch table; statistics may hold what stats(docs, "lang", "source") gives."""
    if statistics is None:
        statistics = materialise(stats(only(docs, "text", "lang", "source"), "lang", "source"), "quality-stats")
    rows = statistics.where("n_words > 0").select(group_of().alias("g"), *FEATURES)
    best = concentrated(rows.unionByName(rows.withColumn("g", F.lit(ALL))))
    whole = best.where(F.col("g") == ALL).first()  # one row, none if there are no rows
    prior = (whole.n, list(whole.sums), list(whole.products)) if whole else (0.0, [0.0] * P, [0.0] * len(PAIRS))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pm, pc = estimate(*prior)
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                mean, cov = estimate(r.n, r.sums, r.products)
                k = PRIOR_ROWS / (PRIOR_ROWS + r.n)
                gap = mean - pm
                mean, cov = mean * (1 - k) + pm * k, cov * (1 - k) + pc * k + np.outer(gap, gap) * k * (1 - k)
                out.append((r.g, mean.tolist(), np.linalg.inv(shape(cov)).ravel().tolist()))
            yield pd.DataFrame(out, columns=["g", "mean", "inverse"])

    return materialise(best.mapInPandas(lean(run), f"{GROUP}, mean array<double>, inverse array<double>"), "quality-models")


def _verdict(rows: DataFrame, models: DataFrame) -> DataFrame:
    slim = models.select("g", "mean", "inverse")
    rows = rows.withColumn("g", group_of())
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    d2 = F.coalesce(_distance([F.col(f) for f in FEATURES], F.col("mean"), F.col("inverse")), F.lit(0.0))
    judged = _with_model(rows, slim).withColumn("base_failed", failed).withColumn("distance", F.sqrt(F.greatest(d2, F.lit(0.0))))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= CUTOFF**0.5)).drop("g", "mean", "inverse")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, counts, base_failed, kept and the Mahalanobis distance of every document."""
    statistics = materialise(stats(only(docs, "doc_id", "text", "lang", "source"), "doc_id", "lang", "source"), "quality-stats")
    out = _verdict(statistics, fit(docs, statistics))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns; texts are not shuffled while the models fit a broadcast."""
    models = fit(docs)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[F.col(f"`{c}`") for c in ("text", "lang", "source")])
    judged = _verdict(stats(packed, "row", "lang", "source"), models)
    return judged.where("kept").select(*[F.col("row")[c].alias(c) for c in docs.columns])
