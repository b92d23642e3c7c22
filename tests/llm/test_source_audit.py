"""The source divergence audit against counting in plain Python."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexengine.llm import registry, source_audit
from lexengine.llm.common import table

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    """(lang, source, part, item, value, rank) of (lang, source, text) rows."""
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in rows):
        found = TERM.findall(text.translate(LOWER))
        groups.add((lang, source))
        counts[lang, source].update(found)
        held[lang].update(set(found))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = {t for t, n in held[lang].items() if n >= 30}
        sources = sorted(s for x, s in groups if x == lang)
        of = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        whole = {t: sum(of[s][t] for s in sources) for t in kept}

        def share(c):
            total = sum(c.values())
            return {t: 1 + 10**9 * (n + 5) // (total + 5 * len(kept)) for t, n in c.items()}

        p, q = {s: share(c) for s, c in of.items()}, share(whole)
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if of[s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(found) if part == "pair" or k < 50}
    return out


def audited(spark, rows):
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    got = [tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in source_audit.audit(docs).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_query_equals_plain_counting(spark, sf):
    rows = [(r.lang, r.source, r.text) for r in table(spark, sf, "documents").collect()]
    got = registry.QUERIES["op13_source_audit"](spark, sf)
    assert {tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in got.collect()} == brute(rows)


def test_many_sources_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(source_audit, "BLOCK_ENTRIES", 50)
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(900):
        lang = "ab"[rng.integers(2)]
        source = f"s{int(rng.integers(12)) if rng.random() < 0.6 else 0}"
        words = [f"Wort{'abcdefghijklmnopqrstuvwxyz'[int(i) % 26]}{'äöü'[int(i) % 3]}{'x' * (int(i) // 26)}" for i in rng.zipf(1.3, 30) % 90]
        rows.append((lang, source, " ".join(words)))
    assert audited(spark, rows) == brute(rows)


def test_odd_rows(spark):
    # no kept terms, null and empty everything, equal rows, ties, one source alone, a long text, terms beyond ASCII
    rows = [(None, None, None), ("", "a", ""), ("xx", "b", "no term is held often"), ("xx", "c", None), ("xx", "d", "\x00\x7f09 ][")]
    rows += [("yy", "a", "Alpha beta-Beta é漢字")] * 20 + [("yy", None, "alpha BETA z")] * 20 + [("yy", "", "ALPHA gamma")] * 20
    rows += [("zz", "only", "same same words")] * 40 + [("zz", "only", "long " * 50_000)]
    assert audited(spark, rows) == brute(rows)
    assert audited(spark, []) == set()
    clashing = spark.createDataFrame([(1, "yy", "a", "x", 1, "t")], "doc_id long, lang string, source string, text string, n long, term string").withColumns({c: F.lit(1) for c in ("docs", "block", "total", "rank", "a.b")})
    assert source_audit.audit(clashing).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abZ é漢.\x00[{`@9", max_size=12), max_size=8))
def test_boundaries_equal_the_pattern(texts):
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    data = source_audit.LOWER[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    starts, ends = source_audit.boundaries(data, offsets)
    found = [data[s:e].tobytes().decode() for s, e in zip(starts, ends)]
    assert found == [w for t in texts for w in TERM.findall(t.translate(LOWER))]


@pytest.mark.parametrize("digest", [lambda b: 7, lambda b: len(b), lambda b: b[0]])
def test_slices_of_one_hash_are_told_apart_by_bytes(digest):
    words = ["ab", "cd", "ab", "abc", "x", "cd", "abd"]
    data = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
    starts, ends = source_audit.boundaries(data, np.array([0, len(data)]))
    number, first = source_audit.group_slices(data, starts, ends, digest)
    assert [words[first[k]] for k in number] == words and len(first) == len(set(words))


def test_shares_are_exact_at_any_size():
    for total in (10**6, 10**14, 3 * 10**17):
        counts = np.array([0, 1, 12_345, total // 3, total], dtype=np.int64)
        assert source_audit.shares(counts, total, 1000).tolist() == [1 + 10**9 * (int(c) + 5) // (total + 5000) for c in counts]
