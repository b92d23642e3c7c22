"""Packing against the tokenizer's own ids, and its order of turns against serving them one by one."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexengine.llm import packing, registry
from lexengine.llm.common import table

PATH = public_tokenizers.path("word_bpe_49k.json")
DEFINITION = open(PATH, encoding="utf-8").read()


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def ids_of(plain, text):
    return [*plain.encode(text or "", add_special_tokens=False).ids, 2]


def check(plain, docs, pieces, window=packing.WINDOW):
    """Every id lies in one piece, and windows are filled without gaps."""
    texts = defaultdict(Counter)
    for d in docs:
        texts[d.doc_id][tuple(ids_of(plain, d.text))] += 1
    windows, cover = defaultdict(list), defaultdict(Counter)
    for p in pieces:
        assert 0 < p.length <= window
        windows[p.sequence_id].append((p.offset, p.length))
        held = [ids for ids in texts[p.doc_id] if len(ids) == p.doc_tokens and zlib.crc32(np.array(ids[p.start : p.start + p.length], dtype="<u4").tobytes()) == p.ids_crc32]
        assert held
        cover[p.doc_id].update(range(p.start, p.start + p.length))
    for doc_id, found in texts.items():
        expected = Counter()
        for ids, n in found.items():
            for i in range(len(ids)):
                expected[i] += n
        assert cover[doc_id] == expected
    ends = {}
    for k, parts in windows.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        ends[k] = at
    assert sorted(ends) == list(range(len(ends)))
    assert all(n == window for k, n in ends.items() if k < len(ends) - 1)


def test_query_packs_every_id_once(spark, sf, plain):
    docs = table(spark, sf, "documents").select("doc_id", "text", "source").collect()
    pieces = registry.QUERIES["op12_packing"](spark, sf).collect()
    check(plain, docs, pieces)
    # every full window has the mixture of the whole, but for turns that are carried
    total, by_window = Counter(), defaultdict(Counter)
    for p in pieces:
        total[p.source] += p.length
        by_window[p.sequence_id][p.source] += p.length
    whole = sum(total.values())
    for k in range(max(by_window)):
        for s, n in total.items():
            assert abs(by_window[k][s] - n / whole * packing.WINDOW) <= 1.5 * packing.GRAIN


def served_one_by_one(totals, weights, grain):
    """The order of turns: each time the queue whose next turn is due first."""
    done, order, late = [0] * len(totals), [], [j * grain / len(totals) for j in range(len(totals))]
    while any(d * grain < t for d, t in zip(done, totals)):
        j = min((j for j in range(len(totals)) if done[j] * grain < totals[j]), key=lambda j: (np.float64(done[j] * grain + late[j]) / weights[j], j))
        order.append((j, done[j]))
        done[j] += 1
    return order


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 400), st.sampled_from([None, 0.1, 0.25, 1 / 3, 1.0])), min_size=1, max_size=6), st.sampled_from([1, 3, 7, 16]))
def test_turns_stand_where_serving_them_puts_them(queues, grain):
    totals = np.array([t for t, _ in queues])
    weights = np.array([float(t) if w is None else w for t, w in queues])
    at, expected = 0, {}
    for j, k in served_one_by_one(totals.tolist(), weights.tolist(), grain):
        expected[j, k] = at
        at += min(grain, totals[j] - k * grain)
    keys = list(expected)
    got = packing.turn_starts(np.array([j for j, _ in keys]), np.array([k for _, k in keys]), totals, weights, grain)
    assert got.tolist() == [expected[k] for k in keys]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(1, 60), min_size=1, max_size=8), min_size=1, max_size=4), st.sampled_from([(16, 4), (16, 16), (10, 3)]))
def test_pieces_cover_documents_and_places(queues, sizes):
    window, grain = sizes
    totals = np.array([sum(q) for q in queues])
    first = np.concatenate([np.cumsum(q) - q for q in queues])
    n, queue = np.concatenate(queues), np.repeat(np.arange(len(queues)), [len(q) for q in queues])
    row, start, length, place = packing.cut(first, n, queue, totals, totals.astype(float), window, grain)
    assert sorted(p for a, k in zip(place, length) for p in range(a, a + k)) == list(range(totals.sum()))
    assert all(a % window + k <= window for a, k in zip(place, length))
    for i, k in enumerate(n):
        assert sorted(x for r, s, m in zip(row, start, length) if r == i for x in range(s, s + m)) == list(range(k))


TEXTS = st.text(alphabet=st.one_of(st.sampled_from("aZ0'sé ßÅﬁΣς́İ漢😀\t\n\x00  <|>.,-"), st.characters(max_codepoint=0x250)), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, max_size=5))
def test_ids_equal_the_tokenizers(texts):
    encoder = packing._encoder(DEFINITION)
    texts = [*texts, "don't I'LL 've <|endoftext|> it's", ""]
    assert [np.frombuffer(x, dtype=encoder.dtype).tolist() for x in encoder.encode(texts)] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_tokenizers_of_other_kinds_are_used_whole():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, own = packing.Encoder(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    texts = ["Some words, and  more.", "", "été\n"]
    assert encoder.find is None
    assert [np.frombuffer(x, dtype=encoder.dtype).tolist() for x in encoder.encode(texts)] == [own.encode(t, add_special_tokens=False).ids for t in texts]


def test_odd_rows(spark, plain):
    rows = [(1, None, None), (2, "", "a"), (2, "", "a"), (3, "word " * 9000, None), (None, "a null id", "a"), (5, "two rows", "b"), (5, "of one id", "b"), (6, "漢字 and more", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("n", "part", "queue", "ids", "a.b", "start")})
    check(plain, docs.collect(), packing.pack(docs, PATH).collect())
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_small_sources_share_a_queue_and_targets_hold(spark, plain):
    rows = [(i, "some words of text here " * 12, f"s{i % 40}" if i % 2 else "big") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    # window of 16: sources under a sixteenth of all tokens share a queue
    pieces = packing.pack(docs, PATH, window=16, grain=4).collect()
    check(plain, docs.collect(), pieces, 16)
    pieces = packing.pack(docs, PATH, targets={"big": 0.25}, window=64, grain=8).collect()
    check(plain, docs.collect(), pieces, 64)
    held = Counter()
    for p in pieces:
        if p.source == "big":
            held[p.sequence_id] += p.length
    assert all(abs(held[k] - 16) <= 12 for k in range(200))
    with pytest.raises(ValueError):
        packing.pack(docs, PATH, targets={"big": 1.5})


def test_sequences_are_padded_unless_a_power_of_two(spark, plain):
    docs = spark.createDataFrame([(i, "ab cd ef " * i, "s") for i in range(1, 40)], "doc_id long, text string, source string")
    whole = sorted(x for d in docs.collect() for x in ids_of(plain, d.text))
    made = packing.sequences(packing.pack(docs, PATH, with_ids=True, window=64, grain=16), 64).orderBy("sequence_id").collect()
    assert sorted(x for r in made for x in r.ids[: r.n_tokens]) == whole
    assert all(len(r.ids) == 64 and r.n_tokens == 64 for r in made[:-1])
    last = made[-1]
    assert len(last.ids) == (last.n_tokens if last.n_tokens & (last.n_tokens - 1) == 0 else 64)
