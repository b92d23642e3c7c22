"""Small gradient-boosted trees for binary labels: numpy only, exact splits, a few thousand rows."""

from __future__ import annotations

import numpy as np


def _leaf(g: np.ndarray, h: np.ndarray, l2: float) -> float:
    return float(-g.sum() / (h.sum() + l2))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, l2: float, least: int):
    """A tree as nested (feature, threshold, left, right) tuples with float leaves."""
    if depth == 0 or len(g) < 2 * least:
        return _leaf(g, h, l2)
    best = (1e-6, 0, 0.0)
    whole = g.sum() ** 2 / (h.sum() + l2)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, gs, hs = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
        gain = gs**2 / (hs + l2) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + l2) - whole
        allowed = np.zeros(len(v), bool)
        allowed[least - 1 : len(v) - least] = v[least - 1 : len(v) - least] < v[least : len(v) - least + 1]
        if allowed.any():
            i = int(np.argmax(np.where(allowed, gain, -np.inf)))
            if gain[i] > best[0]:
                best = (float(gain[i]), f, float((v[i] + v[i + 1]) / 2))
    if best[0] <= 1e-6:
        return _leaf(g, h, l2)
    left = x[:, best[1]] <= best[2]
    return (best[1], best[2], _grow(x[left], g[left], h[left], depth - 1, l2, least), _grow(x[~left], g[~left], h[~left], depth - 1, l2, least))


def _apply(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, t, left, right = tree
    below = x[:, f] <= t
    out = np.empty(len(x))
    out[below], out[~below] = _apply(left, x[below]), _apply(right, x[~below])
    return out


def margin(trees: list, x: np.ndarray, rate: float) -> np.ndarray:
    return rate * sum((_apply(t, x) for t in trees), np.zeros(len(x)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, l2: float = 1.0, least: int = 8) -> list:
    trees: list = []
    f = np.zeros(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        tree = _grow(x, p - y, p * (1 - p), depth, l2, least)
        trees.append(tree)
        f += rate * _apply(tree, x)
    return trees


def margin_of_row(trees: list, row: list[float], rate: float) -> float:
    """The margin of one row; plain Python, faster than numpy for single candidates."""
    total = 0.0
    for t in trees:
        while not isinstance(t, float):
            t = t[2] if row[t[0]] <= t[1] else t[3]
        total += t
    return rate * total


def calibrate(margins: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Platt scaling by Newton steps: probability = 1 / (1 + exp(-(a * margin + b)))."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(a * margins + b)))
        r, w = p - y, np.maximum(p * (1 - p), 1e-9)
        g = np.array([(r * margins).sum() + 1.0 * (a - 1), r.sum() + 1.0 * b])
        hess = np.array([[(w * margins * margins).sum() + 1.0, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1.0]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(a), float(b)
