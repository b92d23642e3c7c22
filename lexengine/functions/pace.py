"""The pace of requests, as a rule on (state, response time)."""

from __future__ import annotations

from typing import NamedTuple

WINDOW, LEAST, MOST = 20, 0.05, 2.0


class Pace(NamedTuple):
    """The last response times, the median of the first full window of them (None before), and the delay."""

    last: tuple[float, ...] = ()
    baseline: float | None = None
    delay: float = LEAST


def paced(state: Pace, elapsed: float, window: int = WINDOW, least: float = LEAST, most: float = MOST) -> tuple[Pace, float]:
    """The state after one more response, and the upper median of the last ``window`` times.

    While the median is above twice the baseline each response makes the delay half as long again, and below 1.3 of it a fifth
    shorter; a baseline of 0 changes nothing.
    """
    last = (*state.last, elapsed)[-window:]
    middle = sorted(last)[len(last) // 2]
    if state.baseline is None:
        return Pace(last, middle if len(last) == window else None, state.delay), middle
    ratio = middle / state.baseline if state.baseline else 2.0
    delay = min(state.delay * 1.5, most) if ratio > 2.0 else max(state.delay * 0.8, least) if ratio < 1.3 else state.delay
    return Pace(last, state.baseline, delay), middle
