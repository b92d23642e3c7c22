import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexengine.operators import chat, ingest
from lexengine.streaming import streams


def _folder(spark, rows, schema, path, files=3):
    spark.createDataFrame(rows, schema).repartition(files).write.parquet(str(path))
    return str(path)


FRAGMENT = "stream_id bigint, idx bigint, seq bigint, id string, name string, arguments string"


def _appended(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture
def small_frames(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "100")
    yield
    spark.conf.set(name, before)


def test_calls_out_of_order_grow_to_the_batch_result(spark, tmp_path, small_frames):
    # fragments are shuffled over frames of 100 rows and over batches; one is sent twice
    rng = np.random.default_rng(0)
    rows = [(s, i, k, f"c{k}" if k % 50 == 0 else "", "f" if k == 3 else None, f"{k};") for s in (1, 2) for i in (0, 1) for k in range(400)]
    order = rng.permutation(len(rows))
    folder, cp, seen = str(tmp_path / "in"), str(tmp_path / "cp"), {}

    def keep(batch, _):
        for r in batch.collect():
            seen[r.stream_id, r.idx] = (r.id, r.name, r.arguments)

    for part in np.array_split(order, 3):
        _appended(spark, folder, [rows[i] for i in part], FRAGMENT)
        streams.run_available(streams.assembled_calls(streams.read_files(spark, folder, FRAGMENT)), cp, keep, "update")
        # after each batch it is what the batch operator makes of what has come
        batch = {(r.stream_id, r.idx): (r.id, r.name, r.arguments) for r in chat.assemble_calls(spark.read.parquet(folder)).collect()}
        assert {k: v[2] for k, v in seen.items()} == {k: v[2] for k, v in batch.items()}
    assert seen == batch
    _appended(spark, folder, rows[5:6], FRAGMENT)
    streams.run_available(streams.assembled_calls(streams.read_files(spark, folder, FRAGMENT)), cp, keep, "update")
    assert seen == batch


def _state_rows(spark, cp, variable):
    return spark.read.format("statestore").option("stateVarName", variable).load(cp).count()


def test_state_of_finished_calls_goes(spark, tmp_path):
    schema = FRAGMENT + ", finish boolean"
    folder, cp, seen = str(tmp_path / "in"), str(tmp_path / "cp"), {}

    def run():
        streams.run_available(streams.assembled_calls(streams.read_files(spark, folder, schema)), cp, lambda b, _: seen.update({r.stream_id: r.arguments for r in b.collect()}), "update")

    _appended(spark, folder, [(s, 0, k, "", "", str(k), k == 2) for s in (1, 2) for k in (0, 2) if not (s, k) == (2, 2)], schema)
    run()
    assert _state_rows(spark, cp, "done") == 2
    _appended(spark, folder, [(1, 0, 1, "", "", "1", False), (2, 0, 1, "", "", "1", False)], schema)
    run()
    assert seen == {1: "012", 2: "01"} and _state_rows(spark, cp, "done") == 1


def test_content_matches_batch(spark, tmp_path):
    schema = "stream_id bigint, turn bigint, seq bigint, kind string, piece string"
    rng = np.random.default_rng(5)
    rows = [(s, t, k, ["content", "reasoning"][(k + s) % 2], f"<{k}>") for s in range(4) for t in range(2) for k in range(9)]
    folder, cp, seen = str(tmp_path / "in"), str(tmp_path / "cp"), {}
    for part in np.array_split(rng.permutation(len(rows)), 2):
        _appended(spark, folder, [rows[i] for i in part], schema)
        streams.run_available(streams.assembled_content(streams.read_files(spark, folder, schema)), cp, lambda b, _: seen.update({(r.stream_id, r.turn): (r.content, r.reasoning) for r in b.collect()}), "update")
    assert seen == {(r.stream_id, r.turn): (r.content, r.reasoning) for r in chat.assemble_content(spark.read.parquet(folder)).collect()}


def test_throttle_matches_batch_in_any_order(spark, tmp_path, small_frames):
    rng = np.random.default_rng(1)
    times = {"a": [float(rng.random() * (4 if i > 60 else 1) + 0.1) for i in range(250)], "zero": [0.0] * 20 + [1.0] * 30, "null": [None if i % 3 == 0 else 0.5 + i % 4 for i in range(90)]}
    rows = [(k, i, t) for k, some in times.items() for i, t in enumerate(some)]
    schema = "key string, seq bigint, elapsed double"
    folder, cp, got = str(tmp_path / "in"), str(tmp_path / "cp"), []
    for part in np.array_split(rng.permutation(len(rows)), 3):
        _appended(spark, folder, [rows[i] for i in part], schema)
        streams.run_available(streams.throttled(streams.read_files(spark, folder, schema), patience_ms=0), cp, lambda b, _: got.extend(b.collect()), "update")
    key = lambda r: (r.key, r.seq, r.median, r.baseline, r.delay)
    assert sorted(map(key, got), key=str) == sorted(map(key, ingest.throttle(spark.createDataFrame(rows, schema)).collect()), key=str)


def test_what_waits_behind_a_gap_is_packed(spark, tmp_path, small_frames, monkeypatch):
    # a row of state costs a round trip: 5,000 waiting times are a few blocks of it, and 500 waiting pieces a part of their key's
    schema, folder, cp, got = "key string, seq bigint, elapsed double", str(tmp_path / "in"), str(tmp_path / "cp"), []
    run = lambda: streams.run_available(streams.throttled(streams.read_files(spark, folder, schema), patience_ms=0), cp, lambda b, _: got.extend(b.collect()), "update")
    rows = [("a", i, None if i % 7 == 0 else 0.5 + i % 4) for i in range(5001)]
    _appended(spark, folder, rows[1:], schema)
    run()
    assert got == [] and 1 <= _state_rows(spark, cp, "waiting") <= 5
    _appended(spark, folder, rows[:1] + rows[5:9], schema)
    run()
    key = lambda r: (r.key, r.seq, r.median, r.baseline, r.delay)
    assert sorted(map(key, got), key=str) == sorted(map(key, ingest.throttle(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert _state_rows(spark, cp, "waiting") == 0

    folder, cp, seen = str(tmp_path / "pieces"), str(tmp_path / "cp2"), {}
    run = lambda: streams.run_available(streams.assembled_calls(streams.read_files(spark, folder, FRAGMENT)), cp, lambda b, _: seen.update({r.stream_id: r.arguments for r in b.collect()}), "update")
    _appended(spark, folder, [(1, 0, k, "", "", f"{k};") for k in range(1, 501)], FRAGMENT)
    run()
    state = spark.read.format("statestore").option("stateVarName", "done").load(cp).select("value.value.next", F.length("value.value.waiting") > 0).collect()
    assert [tuple(r) for r in state] == [(0, True)]
    _appended(spark, folder, [(1, 0, 0, "", "", "0;")], FRAGMENT)
    run()
    assert seen == {1: "".join(f"{k};" for k in range(501))}


def test_gaps_are_passed_over_in_time(spark, tmp_path):
    schema = "key string, seq bigint, elapsed double"
    folder, cp, got = str(tmp_path / "in"), str(tmp_path / "cp"), []
    for rows in ([("a", 0, 1.0), ("a", 2, 2.0), ("a", 3, 3.0)], [("b", 0, 1.0)], [("c", 0, 1.0)]):
        _appended(spark, folder, rows, schema)
        streams.run_available(streams.throttled(streams.read_files(spark, folder, schema), patience_ms=1), cp, lambda b, _: got.extend((r.key, r.seq) for r in b.collect()), "update")
    assert sorted(x for x in got if x[0] == "a") == [("a", 0), ("a", 2), ("a", 3)]


STUB = "word string, paradigm string, desc string"


def test_ingest_goes_on_after_a_restart(spark, tmp_path):
    folder, table, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    _appended(spark, folder, [("a", "1", "n"), ("a", "1", "n"), (None, "1", "n"), (None, "1", "n")], STUB)
    streams.ingest(streams.read_files(spark, folder, STUB), cp, table, ingest.KEY)
    _appended(spark, folder, [("a", "1", "n"), ("b", "1", "n")], STUB)
    streams.ingest(streams.read_files(spark, folder, STUB), cp, table, ingest.KEY)
    assert sorted(str(r.word) for r in streams.saved(spark, table).collect()) == ["None", "a", "b"]


@pytest.mark.parametrize("with_known", [False, True])
def test_a_crash_between_writing_and_checkpoint_adds_nothing(spark, tmp_path, monkeypatch, with_known):
    folder, table, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    known = spark.createDataFrame([("k", "1", "n"), (None, "2", "n")], STUB) if with_known else None
    _appended(spark, folder, [("a", "1", "n"), ("b", "1", "n"), ("k", "1", "n"), (None, "2", "n")], STUB)
    run = lambda: streams.ingest(streams.read_files(spark, folder, STUB), cp, table, ingest.KEY, known)
    run()
    save = streams.saved_by_batch

    def crashing(table):
        def each(batch, number):
            save(table)(batch, number)
            raise RuntimeError("lost after writing")

        return each

    _appended(spark, folder, [("c", "1", "n"), ("a", "1", "n"), ("k", "1", "n")], STUB)
    monkeypatch.setattr(streams, "saved_by_batch", crashing)
    with pytest.raises(Exception, match="lost after writing"):
        run()
    monkeypatch.setattr(streams, "saved_by_batch", save)
    run()
    run()
    assert sorted(str(r.word) for r in streams.saved(spark, table).collect()) == (["a", "b", "c"] if with_known else ["None", "a", "b", "c", "k"])


def test_phase_two_saves_as_it_goes(spark, tmp_path):
    folder, table, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    asked = []

    def results(stubs):
        asked.append(sorted(r.word for r in stubs.collect()))
        if asked[-1] == ["c"] and asked.count(["c"]) == 1:
            raise RuntimeError("the service is down")
        return stubs.select("word", "paradigm", F.lit("miks").alias("lang"), F.lit(0).alias("n"), F.array(F.upper("word")).alias("translations"))

    for rows in ([("a", "1", "n"), ("b", "1", "n")], [("c", "1", "n"), ("a", "1", "n")]):
        _appended(spark, folder, rows, STUB)
    run = lambda: streams.complete(streams.read_files(spark, folder, STUB), cp, table, results)
    with pytest.raises(Exception, match="service is down"):
        run()
    assert sorted(r.word for r in streams.saved(spark, table).collect()) == ["a", "b"]
    run()
    assert asked == [["a", "b"], ["c"], ["c"]]
    assert sorted((r.word, r.translations["miks"][0]) for r in streams.saved(spark, table).collect()) == [("a", "A"), ("b", "B"), ("c", "C")]


def test_unanswered_requests_come_out_as_timed_out(spark, tmp_path):
    t = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    sent, told, cp, got = str(tmp_path / "sent"), str(tmp_path / "told"), str(tmp_path / "cp"), []
    asked, answer = "id bigint, sent timestamp, method string", "id bigint, received timestamp, result string"

    def run():
        both = streams.answered_or_not(streams.read_files(spark, sent, asked), streams.read_files(spark, told, answer))
        streams.run_available(both, cp, lambda b, _: got.extend((r.id, r.result, r.timed_out) for r in b.collect()))

    _appended(spark, sent, [(1, t(0), "a"), (2, t(1), "b"), (3, t(2), "c")], asked)
    _appended(spark, told, [(1, t(30), "one"), (3, t(33), "late"), (9, t(5), "nobody asked")], answer)
    run()
    assert got == [(1, "one", False)]
    # time goes on
    _appended(spark, sent, [(-1, t(1000), None)], asked)
    _appended(spark, told, [(-2, t(1000), None)], answer)
    run()
    run()
    assert sorted(got, key=str) == [(1, "one", False), (2, None, True), (3, None, True)]


def test_windows_match_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    folder = str(tmp_path / "in")
    events.repartition(3).write.parquet(folder)
    got = {}

    def keep(batch, _):
        for r in batch.collect():
            got[r.start, r.event_type] = r.n

    stream = spark.readStream.schema(events.schema).parquet(folder)
    streams.run_available(streams.windowed_counts(stream, late="10000 days"), str(tmp_path / "cp"), keep, "update")
    batch = events.groupBy(F.window(F.col("ts").cast("timestamp"), "10 minutes").alias("w"), "event_type").count().select("w.start", "event_type", "count")
    assert got == {(r.start, r.event_type): r["count"] for r in batch.collect()}


def test_deduplicated(spark, tmp_path):
    folder = _folder(spark, [("a",), ("a",), ("b",)], "word string", tmp_path / "in")
    rows = []
    streams.run_available(streams.deduplicated(streams.read_files(spark, folder, "word string"), ("word",)), str(tmp_path / "cp"), lambda b, _: rows.extend(b.collect()))
    assert sorted(r.word for r in rows) == ["a", "b"]
