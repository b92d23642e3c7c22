"""Personal data: base patterns, and further candidates that boosted trees judge by format and context.

High-recall generators propose overlapping spans (addresses in prose, phone numbers without a plus, long
card-like numbers, social security numbers, bank account numbers, IPv6).  Gradient-boosted trees score each
span by its format (digits, separators, check digits) and its context (words before it, neighbours),
Platt scaling turns scores into probabilities on held-out examples, and per kind the lowest threshold
that keeps ``PRECISION`` on those examples selects.  Of overlapping selected spans the likelier stays.
There are no labelled spans in the tables, so trees are trained on a fixed, seeded set of composed
examples (``EXAMPLES`` per kind), which no input changes.

Base spans always stay.  Spans are in code points, end exclusive, found in the whole text.  Defined cases:
null text is empty; equal texts give equal spans; further columns are ignored by ``find_pii`` and kept by
``redact``, where null text stays null; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import boosting
from .common import as_bytes, lean, only

# Fixed values of the base kinds.
BASE = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(rb"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(rb"[0-9](?:\x20?[0-9]|-[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_COUNTRY = re.compile(rb"\+[0-9]{1,3}[\x20.-]?\Z")
_NOT_DIGIT = bytes(i for i in range(256) if not 48 <= i <= 57)

#: Kinds that the generators propose.
MORE = ("address", "national", "digits", "ssn", "iban", "ip6")
KINDS = (*BASE, *MORE)
GENERATORS = (
    re.compile(rb"@|[\[(]at[\])]"),  # the sign of an address; proposals() takes what stands on both sides of it
    re.compile(rb"(?<![0-9A-Za-z+.])\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9A-Za-z])"),
    re.compile(rb"(?<![0-9A-Za-z.])[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{1,7}(?![0-9A-Za-z])"),
    re.compile(rb"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    re.compile(rb"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
    re.compile(rb"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
)
# Around the sign of an address: what ends a name in prose, and the domain behind a spelt-out sign.
_WIDE = bytes(i for i in range(256) if i not in b"\t\n\v\f\r @<>()[],;:\"|")
_SPELT = re.compile(rb"\x20?[A-Za-z0-9-]+(?:(?:\x20?[\[(]dot[\])]\x20?|\.)[A-Za-z0-9-]+)+")
#: Words before a span that speak for or against it; text, in natural order.
FOR = b"address call card contact credit e-mail email fax iban ip account mail mobile phone social ssn tel telephone visa write".split()
AGAINST = b"article build code commit edition id invoice isbn item model no number order page part price ref revision serial ticket time total tracking version year".split()
PRECISION = 0.95
EXAMPLES = 400
RATE = 0.3


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d -= 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _mod97(text: bytes) -> bool:
    s = text.replace(b" ", b"")
    s = s[4:] + s[:4]
    try:
        return int("".join(str(int(chr(c), 36)) for c in s)) % 97 == 1
    except ValueError:
        return False


def _name_before(data: bytes, floor: int, at: int, signs: bytes) -> int:
    """Start of the run of signs that ends at ``at``, never before ``floor``."""
    return floor + len(data[floor:at].rstrip(signs))


def _emails(data: bytes) -> list[tuple[int, int, int]]:
    out, end, seen, at = [], 0, 0, data.find(b"@")
    while at >= 0:
        # a sign is no part of a name, so no name reaches back over the sign before
        start = _name_before(data, max(end, seen), at, _LOCAL) if at > end else at
        m = _DOMAIN.match(data, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            end = m.end()
        seen = at + 1
        at = data.find(b"@", max(at + 1, end))
    return out


def _base(data: bytes) -> list[tuple[int, int, int]]:
    found = _emails(data) if b"@" in data else []
    for m in _IP.finditer(data):
        if all(len(p) <= 3 and int(p or b"0") <= 255 for p in (x.lstrip(b"0") for x in m[0].split(b"."))):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(data):
        if m.end() - m.start() >= 14:
            digits = m[0].translate(None, b" -")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if b"+" in data:
        for m in _PHONE.finditer(data):
            if 10 <= len(m[0].translate(None, _NOT_DIGIT)) <= 15:
                found.append((m.start(), 3, m.end()))
    return found


def features(data: bytes, kind: int, start: int, end: int) -> list[float]:
    """Format and context of one proposed span."""
    span = data[start:end]
    digits = span.translate(None, _NOT_DIGIT)
    before = data[max(0, start - 48) : start].lower()
    words = re.findall(rb"[a-z]+(?:-[a-z]+)?", before)[-4:]
    seps = {c for c in span if c in b" .-()"}
    return [
        *[float(kind == k) for k in range(len(MORE))],
        float(len(digits)), float(len(span)), float(len(seps)),
        float(sum(span.count(bytes([c])) for c in b" .-")),
        float(13 <= len(digits) <= 19 and luhn(digits)), float(kind == 4 and _mod97(span)),
        float(any(w in FOR for w in words)), float(any(w in AGAINST for w in words)),
        float(words[-1] in FOR if words else 0), float(words[-1] in AGAINST if words else 0),
        float(before[-1:].isspace() or not before), float(before.rstrip()[-1:] in (b":", b"=", b"#")), float(before.rstrip()[-1:] in b"#$\xc2" and bool(before)),
        float(data[end : end + 1].isalnum()), float(span.count(b"@")), float(not span.isascii()), float(digits[:1] in (b"0", b"1")),
        float(len(set(digits)) <= 2), float(span.count(b":")), float(bool(_COUNTRY.search(before))),
    ]


def composer(rng: random.Random) -> Callable[[int, bool], tuple[str, str, str]]:
    """A maker of examples: from a kind, and whether it is personal data, the text before the span, the span, and the text after it."""
    num = lambda n, first="123456789": rng.choice(first) + "".join(rng.choice("0123456789") for _ in range(n - 1))
    name = lambda: "".join(rng.choice("abcdefghilmnoprstuvé") for _ in range(rng.randint(4, 10)))
    plain = lambda: name().replace("é", "e")

    def checked(n: int) -> str:
        s = num(n - 1)
        return next(s + str(c) for c in range(10) if luhn((s + str(c)).encode()))

    def iban(good: bool) -> str:
        body = "".join(rng.choice("0123456789") for _ in range(18))
        check = 98 - int(body + "131400") % 97
        return f"DE{check if good else (check + 5) % 97:02d}{body}"

    def fours(s: str, sep: str) -> str:
        return sep.join(s[i : i + 4] for i in range(0, len(s), 4))

    good = {
        0: [lambda: f"{name()}.{num(2)}@{plain()}.com", lambda: f"{plain()} [at] {plain()} [dot] org", lambda: f"{name()}@mail.{plain()}.net"],
        1: [lambda: f"({num(3)}) {num(3)}-{num(4)}", lambda: f"{num(3)}-{num(3)}-{num(4)}", lambda: f"{num(3)}.{num(3)}.{num(4)}", lambda: f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}"],
        2: [lambda: checked(16), lambda: fours(checked(16), " "), lambda: fours(checked(16), "-")],
        3: [lambda: f"{num(3)}-{num(2)}-{num(4)}"],
        4: [lambda: iban(True), lambda: fours(iban(True), " ")],
        5: [lambda: ":".join(f"{rng.randrange(65536):x}" for _ in range(8))],
    }
    bad = {
        0: [lambda: f"{plain()} (at) {plain()}.{plain()}", lambda: f"¡@{plain()}.{plain()}"],
        1: [lambda: num(10), lambda: f"{num(3)}.{num(3)}.{num(4)}", lambda: f"{num(3)} {num(3)} {num(4)}"],
        2: [lambda: num(13), lambda: num(18), lambda: fours(num(16), " "), lambda: num(16)],
        3: [lambda: f"{num(3)}-{num(2)}-{num(4)}"],
        4: [lambda: iban(False), lambda: f"AB{num(2)}{num(12)}"],
        5: [lambda: ":".join(f"{rng.randrange(60):02d}" for _ in range(4)), lambda: ":".join(num(2) for _ in range(5))],
    }
    pro = [w.decode() for w in FOR]
    con = [w.decode() for w in AGAINST]

    def make(kind: int, y: bool) -> tuple[str, str, str]:
        span = rng.choice((good if y else bad)[kind])()
        if y:
            lead = rng.choice(pro) if rng.random() < (0.55 if kind in (0, 2, 4, 5) or span[0] == "+" else 0.95) else plain()
        else:
            lead = rng.choice(con) if rng.random() < 0.6 else plain()
        return f"{plain()} {plain()} {lead}{rng.choice([' ', ': ', ' # ' if not y else ' '])}", span, f"{rng.choice([' ', '. ', ', '])}{plain()}"

    return make


def _examples() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Composed examples: features, labels and kinds; seeded, the same on every run."""
    make = composer(random.Random(20))
    rows, labels, kinds = [], [], []
    for kind in range(len(MORE)):
        for i in range(EXAMPLES):
            before, span, after = make(kind, i % 2 == 1)
            text, start, end = f"{before}{span}{after}".encode(), len(before.encode()), len(f"{before}{span}".encode())
            for s, e in proposals(text, kind):
                if s < end and start < e:
                    rows.append(features(text, kind, s, e))
                    labels.append(i % 2)
                    kinds.append(kind)
                    break
    return np.array(rows), np.array(labels, float), np.array(kinds)


def _held_out(y: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Which examples calibrate and set thresholds: every fourth of each kind and label."""
    held = np.zeros(len(y), bool)
    for kind in range(len(MORE)):
        for label in (0, 1):
            held[np.flatnonzero((kinds == kind) & (y == label))[3::4]] = True
    return held


@lru_cache(maxsize=1)
def model() -> tuple[list, float, float, tuple[float, ...]]:
    """Trees, Platt's two numbers, and the threshold of each kind."""
    x, y, kinds = _examples()
    held = _held_out(y, kinds)
    trees = boosting.fit(x[~held], y[~held], rate=RATE)
    m = boosting.margin(trees, x[held], RATE)
    a, b = boosting.calibrate(m, y[held])
    p = 1 / (1 + np.exp(-(a * m + b)))
    thresholds = []
    for kind in range(len(MORE)):
        own, truth = p[kinds[held] == kind], y[held][kinds[held] == kind]
        good = [t for t in np.unique(own) if t >= 0.5 and truth[own >= t].mean() >= PRECISION]
        thresholds.append(float(min(good, default=2.0)))
    return trees, a, b, tuple(thresholds)


def proposals(data: bytes, kind: int) -> Iterator[tuple[int, int]]:
    """Start and end of what one generator proposes; each byte is looked at a bounded number of times."""
    if kind:
        if kind != 5 or data.count(b":") >= 3:
            yield from (m.span() for m in GENERATORS[kind].finditer(data))
        return
    floor = 0
    for m in GENERATORS[0].finditer(data):
        s, e = m.span()
        if m[0] == b"@":
            start, tail = _name_before(data, floor, s, _WIDE), _DOMAIN.match(data, e)
        else:
            left = s - (data[s - 1 : s] == b" ")
            start, tail = (_name_before(data, floor, left, _LOCAL), _SPELT.match(data, e)) if left >= floor else (s, None)
            s = left
        floor = e
        if tail and start < s:
            yield start, tail.end()
            floor = tail.end()


def _within(spans: list[tuple[int, int, int]]):
    """A test whether any of the spans, sorted by start, holds all of a stretch."""
    starts, ends = [s for s, _, _ in spans], list(accumulate((e for _, _, e in spans), max))

    def test(s: int, e: int) -> bool:
        i = bisect_right(starts, s)
        return i > 0 and ends[i - 1] >= e

    return test


def _likeliest(taken: list[tuple[float, int, int, int]]) -> list[tuple[int, int, int]]:
    """Of overlapping spans the likelier ones: (minus the probability, start, kind, end) in, (start, kind, end) out."""
    out: list[tuple[int, int, int]] = []  # by start; no two overlap
    for _, s, kind, e in sorted(taken):
        i = bisect_right(out, (s, len(KINDS), 0))
        if (i == 0 or out[i - 1][2] <= s) and (i == len(out) or e <= out[i][0]):
            out.insert(i, (s, kind, e))
    return out


def _more(data: bytes, base: list[tuple[int, int, int]], fitted: tuple) -> list[tuple[int, int, int]]:
    trees, a, b, thresholds = fitted
    known = _within(base)
    taken: list[tuple[float, int, int, int]] = []
    for kind in range(len(MORE)):
        for s, e in proposals(data, kind):
            if known(s, e):
                continue
            z = a * boosting.margin_of_row(trees, features(data, kind, s, e), RATE) + b
            p = 1 / (1 + np.exp(-min(max(z, -500.0), 500.0)))
            if p >= thresholds[kind]:
                taken.append((-p, s, len(BASE) + kind, e))
    return _likeliest(taken)


def spans_of(data: bytes, fitted: tuple) -> tuple[list, list]:
    """Base spans, and all spans, as (start, kind, end) in bytes, sorted."""
    base = sorted(_base(data))
    return base, sorted(base + _more(data, base, fitted))


def _spell(data: bytes, spans: list[tuple[int, int, int]]) -> str:
    out, at, points = [], 0, 0
    ascii_only = data.isascii()
    for s, kind, e in spans:
        if not ascii_only:
            points += len(data[at:s].decode("utf-8", "replace"))
            at, s, e = s, points, points + len(data[s:e].decode("utf-8", "replace"))
        out.append(f"{KINDS[kind]}:{s}:{e}")
    return ",".join(out)


def scan(data: bytes, fitted: tuple) -> tuple:
    base, every = spans_of(data, fitted)
    return (*[sum(k == i for _, k, _ in base) for i in range(4)], hashlib.sha256(_spell(data, base).encode()).hexdigest(), _spell(data, every))


SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, their digest and all spans, per document."""
    from pyspark.sql.pandas.types import to_arrow_schema

    slim = only(docs, "doc_id", "text")
    schema = T.StructType([slim.schema["doc_id"], *T._parse_datatype_string(SCHEMA)])
    arrow = to_arrow_schema(schema)
    fitted = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(x, fitted) for x in as_bytes(batch.column("text"))]
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 6, list(arrow)[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(arrow[0].type), *columns], schema=arrow)

    return slim.mapInArrow(lean(run), schema)


def redact_bytes(data: bytes, fitted: tuple) -> bytes:
    """The text with each span, or run of overlapping spans, replaced by the first one's kind in brackets."""
    _, spans = spans_of(data, fitted)
    if not spans:
        return data
    out, at = [], 0
    for s, kind, e in spans:
        if s < at:
            at = max(at, e)
            continue
        out += [data[at:s], b"[" + KINDS[kind].upper().encode() + b"]"]
        at = e
    return b"".join([*out, data[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced in text, and n_chars, where there is one, made to fit."""
    fitted = model()
    schema = docs.schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.cast(f.type) for c, f in zip(batch.columns, arrow)]
            texts = [None if x is None else redact_bytes(x, fitted).decode("utf-8", "replace") for x in batch.column("text").cast(pa.binary()).to_pylist()]
            columns[arrow.get_field_index("text")] = pa.array(texts, arrow.field("text").type)
            n = arrow.get_field_index("n_chars")
            if n >= 0:
                columns[n] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(arrow[n].type)
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.mapInArrow(lean(run), schema)
