"""Toxicity: cumulative-link ordinal regression of severity grades on sparse text features.

Features are the distinct lower-cased words of a text, stripped of punctuation, and the stems (first 5, 6 and 7
bytes) that its words share, once, twice and three times or more: in a language that builds words, it is the stem
that tells.  Weights are given to at most ``VOCABULARY`` of them, chosen by chi-square on the training texts.
P(grade > k) = sigmoid(w.x - theta_k) with one weight vector and ordered thresholds (theta_k = theta_0 + sums of
exponentials), fitted by maximum likelihood.  Outputs are the expected severity, that is the sum of the exceedance
probabilities, the likeliest grade, and whether the chance of grade 1 or above reaches the cut: the least chance that
at most ``FALSE_ALARMS`` of the training texts that aren't toxic reach when they are scored by weights they had no part in.

The labels have no grades, only toxic 0 or 1.  Grades of the toxic training rows come from their terciles
of the number of telling features (with a training log odds of at least ``TELLING``): 1 light to 3 heavy; grade 0
is not toxic.

Trained on at most ``training.MAX_TRAINING_ROWS`` labelled rows, half of them toxic where there are so many.
Features are counted in Spark; what comes to the driver is the vocabulary, and which of it each text has.
All texts are scored whole.  Defined cases: null or empty text has no features, and the severity of the
intercept; without labels of both kinds severity is 0; equal texts score equally; ids may be numbers or text;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, materialise, only
from .training import sampled

VOCABULARY = 2_000
TELLING = 3.0
LEAST_TEXTS = 5
GRADES = 3
#: Pull of weights towards 0; weights stay at or above 0, so that harmless words can't outweigh toxic ones in long texts.
LASSO = 3e-4
#: Share of the other training texts that may be taken for toxic; the cut follows from it, between these bounds.
FALSE_ALARMS, LEAST_CUT, MOST_CUT = 0.0075, 0.05, 0.5
#: Parts of the training rows, each scored by weights that the others gave, from which the cut is taken.
FOLDS = 3
#: Bytes of a word's beginning that make a stem, and how many times of it are told apart.
STEMS = (5, 6, 7)
MOST_TIMES = 3
_EDGES = b".,;:!?\"'()[]{}#$%&*|<>-_~"


def tokens(data: bytes) -> list[bytes]:
    return [w for w in (w.strip(_EDGES) for w in data.lower().split()) if w]


def features(data: bytes) -> set[str]:
    """Words, and stems with how many of the text's words have them; bytes as latin-1, so that cut letters stay apart."""
    words = Counter(tokens(data))
    out = {w.decode("latin-1") for w in words}
    stems: Counter[bytes] = Counter()
    for w, n in words.items():
        for size in STEMS:
            if len(w) > size:
                stems[w[:size]] += n
    for stem, n in stems.items():
        out.update(f"{stem.decode('latin-1')}~{k}" for k in range(1, min(n, MOST_TIMES) + 1))
    return out


def chi_square(a, b, n1: int, n0: int):
    """How much a feature of a toxic and b other texts tells; numbers or columns."""
    gap, pool = a / n1 - b / n0, (a + b) / (n1 + n0)
    return gap * gap / (pool * (1 - pool) + 1e-9)


def _is_telling(a: int, b: int, n1: int, n0: int) -> bool:
    # in a fair share of the toxic texts too, not something rare that some copies repeat
    return a >= max(LEAST_TEXTS, 0.02 * n1) and np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1)) >= TELLING


def distinct(data: bytes) -> str:
    """The features of a text, sorted, one a line."""
    return "\n".join(sorted(features(data)))


def fit(rows: list[tuple[str, int]]) -> dict | None:
    """Weights by feature, and thresholds, from (features a line, label) rows in memory; None without both labels."""
    # texts of equal features count once
    sets = {text: label for text, label in sorted(rows)}
    inside, outside = Counter(), Counter()
    for text, label in sets.items():
        (inside if label else outside).update(text.split("\n"))
    n1 = sum(sets.values())
    n0 = len(sets) - n1
    if not n1 or not n0:
        return None
    counted = [(f, inside[f], outside[f]) for f in inside.keys() | outside.keys() if inside[f] + outside[f] >= LEAST_TEXTS]
    best = sorted(counted, key=lambda x: (-chi_square(x[1], x[2], n1, n0), x[0]))[:VOCABULARY]
    index = {f: i for i, (f, _, _) in enumerate(best)}
    held = [(sorted(index[f] for f in text.split("\n") if f in index), label) for text, label in sets.items()]
    return fit_sparse(held, [f for f, _, _ in best], [_is_telling(a, b, n1, n0) for _, a, b in best])


def fit_from(docs: DataFrame, labels: DataFrame) -> dict | None:
    """The same from tables: features are made and counted on the executors."""
    spark = docs.sparkSession

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([sorted(features(t)) for t in as_bytes(batch.column("text"))], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([made, batch.column("label").cast(pa.int32())], names=["features", "label"])

    sample = sampled(docs, labels, "toxic", rare_first=True).mapInArrow(make, "features array<string>, label int")
    # texts of equal features count once
    sample = materialise(sample.groupBy("features").agg(F.max("label").alias("label")), "toxicity-sample")
    counts = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    if not n1 or not n0:
        return None
    counted = sample.select(F.explode("features").alias("feature"), "label").groupBy("feature").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    best = counted.where(F.col("a") + F.col("b") >= LEAST_TEXTS).orderBy(chi_square(F.col("a"), F.col("b"), n1, n0).desc(), "feature").limit(VOCABULARY).collect()
    index = spark.sparkContext.broadcast({r.feature: i for i, r in enumerate(best)})

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [sorted(index.value[f] for f in some if f in index.value) for some in batch.column("features").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.list_(pa.int32())), batch.column("label")], names=["at", "label"])

    held = sorted((list(r["at"]), r.label) for r in sample.mapInArrow(find, "at array<int>, label int").collect())
    return fit_sparse(held, [r.feature for r in best], [_is_telling(r.a, r.b, n1, n0) for r in best])


def fit_sparse(rows: list[tuple[list[int], int]], vocabulary: list[str], telling: list[bool]) -> dict:
    """Weights and thresholds from the features that each row has, by their number, and its label."""
    toxic = np.array([label == 1 for _, label in rows], bool)
    tell = np.array(telling, bool)
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    for r, (at, _) in enumerate(rows):
        x[r, at] = 1
    heavy = x[:, tell].sum(axis=1)
    cuts = np.quantile(heavy[toxic], [1 / 3, 2 / 3])
    grade = np.where(toxic, 1 + (heavy > cuts[0]) + (heavy > cuts[1]), 0)
    w, theta = maximum_likelihood(x, grade)
    weights = {v: float(a) for v, a in zip(vocabulary, w) if abs(a) > 1e-4}
    # words and stems apart, as bytes; a stem's weights are summed up to each number of times
    stems: dict[bytes, list[float]] = {}
    for name, weight in sorted(weights.items()):
        stem, mark, times = name.rpartition("~")
        if mark and times.isdigit():
            some = stems.setdefault(stem.encode("latin-1"), [0.0] * MOST_TIMES)
            for k in range(int(times) - 1, MOST_TIMES):
                some[k] += weight
    words = {v.encode("latin-1"): a for v, a in weights.items() if not v.rpartition("~")[1]}
    return {"weights": weights, "words": words, "stems": stems, "theta": theta.tolist(), "cut": _cut(x, grade)}


def maximum_likelihood(x: np.ndarray, grade: np.ndarray, steps: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Weights, none below 0, and thresholds that make the grades likeliest, with ``LASSO`` on the weights; by Adam."""
    n, width = x.shape
    w, gaps, base = np.zeros(width), np.zeros(GRADES - 1), 0.0
    state = [np.zeros(width + GRADES), np.zeros(width + GRADES)]
    for step in range(1, steps + 1):
        theta = base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        exceed = 1 / (1 + np.exp(-np.clip((x @ w.astype(np.float32)).astype(float)[:, None] - theta, -40, 40)))
        bound = np.concatenate([np.ones((n, 1)), exceed, np.zeros((n, 1))], 1)
        p = np.maximum(bound[np.arange(n), grade] - bound[np.arange(n), grade + 1], 1e-12)
        slope = np.concatenate([np.zeros((n, 1)), exceed * (1 - exceed), np.zeros((n, 1))], 1)
        upper, lower = slope[np.arange(n), grade] / p, slope[np.arange(n), grade + 1] / p
        d_eta = -(upper - lower) / n
        d_theta = np.array([((grade == k + 1) * upper - (grade == k) * lower).sum() / n for k in range(GRADES)])
        d_gaps = np.exp(gaps) * np.array([d_theta[k + 1 :].sum() for k in range(GRADES - 1)])
        gradient = np.concatenate([x.T @ d_eta.astype(np.float32) + LASSO, d_gaps, [d_theta.sum()]])
        state[0] = 0.9 * state[0] + 0.1 * gradient
        state[1] = 0.999 * state[1] + 0.001 * gradient**2
        move = 0.08 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-8)
        w, gaps, base = np.maximum(w - move[: len(w)], 0.0), gaps - move[len(w) : -1], base - move[-1]
    return w, base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def _cut(x: np.ndarray, grade: np.ndarray) -> float:
    """The chance of grade 1 or above from which a text is called toxic."""
    # rows come sorted by features and label; a fixed shuffle deals them to folds
    fold = np.random.default_rng(0).permutation(len(x)) % FOLDS
    chance = np.zeros(len(x))
    for k in range(FOLDS):
        rest = fold != k
        if not (grade[rest] > 0).any() or not (grade[rest] == 0).any():
            return MOST_CUT
        # features that no row of the rest has keep their weight of 0 anyway
        live = np.flatnonzero(x[rest].any(axis=0))
        w, theta = maximum_likelihood(x[rest][:, live], grade[rest], 250)
        chance[fold == k] = 1 / (1 + np.exp(-np.clip(x[fold == k][:, live] @ w - theta[0], -40, 40)))
    others = np.sort(chance[grade == 0])[::-1]
    # the next above the first that is one too many
    over = others[min(int(FALSE_ALARMS * len(others)), len(others) - 1)]
    return float(min(max(np.nextafter(over, 1), LEAST_CUT), MOST_CUT))


def severity(data: bytes, model: dict | None) -> tuple[float, int, bool]:
    """Expected severity, likeliest grade, and whether the chance of grade 1 or above reaches the cut."""
    if model is None:
        return 0.0, 0, False
    words, stems = model["words"], model["stems"]
    eta, found = 0.0, Counter()
    for w, n in Counter(tokens(data)).items():
        eta += words.get(w, 0.0)
        for size in STEMS:
            if len(w) > size and w[:size] in stems:
                found[w[:size]] += n
    # sums of a stem's weights, by how often it is there
    eta += sum(stems[stem][min(n, MOST_TIMES) - 1] for stem, n in sorted(found.items()))
    exceed = [1 / (1 + np.exp(-min(max(eta - t, -40.0), 40.0))) for t in model["theta"]]
    bound = [1.0, *exceed, 0.0]
    chances = [a - b for a, b in zip(bound, bound[1:])]
    return float(sum(exceed)), int(np.argmax(chances)), bool(exceed[0] >= model["cut"])


def grade(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, expected_severity, severity (0 to 3) and toxic, per document."""
    model = fit_from(docs, labels)
    slim = only(docs, "doc_id", "text")
    schema = T.StructType([slim.schema["doc_id"], *T._parse_datatype_string("expected_severity double, severity int, toxic boolean")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [severity(x, model) for x in as_bytes(batch.column("text"))]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.float64(), pa.int32(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "expected_severity", "severity", "toxic"])

    return slim.mapInArrow(run, schema)
