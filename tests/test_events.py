"""The event stream source and sink: frames cut anywhere are read once, repeated batches add nothing."""

import json

import pytest
from pyspark.sql import functions as F

from lexengine.functions import text
from lexengine.sources import events, paths
from lexengine.streaming import streams

ENDS = {"newline": "\n", "return": "\r\n"}


def frame(k, end="\n"):
    return f"event: e{k % 3}{end}data: {json.dumps({'k': k, 'x': 'ā' * (k % 7)}, ensure_ascii=False)}{end}{end}"


def taken(spark, folder, cp, seen, most=None, step=events.BYTES_PER_TASK):
    def keep(batch, _):
        seen.extend(batch.orderBy("file", "at").collect())

    streams.run_available(events.stream_frames(spark, folder, step, most), cp, keep)


def numbers(rows):
    return [json.loads(r.frame.split("data: ")[1])["k"] for r in rows]


@pytest.mark.parametrize("end", ENDS)
def test_cut_at_any_byte(tmp_path, end):
    whole = "".join(frame(k, ENDS[end]) for k in range(4)).encode()
    store, name = paths.opened(str(tmp_path / "a"))
    bounds = [0]
    for k in range(4):
        bounds.append(bounds[-1] + len(frame(k, ENDS[end]).encode()))
    for cut in range(len(whole) + 1):
        (tmp_path / "a").write_bytes(whole[:cut])
        last = events.last_end(store, name, cut)
        assert last == max(b for b in bounds if b <= cut)
        for step in (1, 10, 40, 1000):
            parts = list(events.ranges(store, name, 0, last, step))
            got = [f for p in parts for f in events.frames(store, name, p.start, p.stop, p.last)]
            assert [at for at, _ in got] == bounds[: bounds.index(last)]


def test_readings_of_any_size(tmp_path, monkeypatch):
    whole = "".join(frame(k, "\r\n" if k % 2 else "\n") for k in range(30)).encode()
    (tmp_path / "a").write_bytes(whole + b"event: x\ndata: unfin")
    store, name = paths.opened(str(tmp_path / "a"))
    for chunk in (1, 2, 3, 7, 50):
        monkeypatch.setattr(events, "_CHUNK", chunk)
        last = events.last_end(store, name, (tmp_path / "a").stat().st_size)
        assert last == len(whole)
        assert len(list(events.frames(store, name, 0, last, last))) == 30


def test_a_stream_reads_each_frame_once_and_goes_on(spark, tmp_path):
    folder, cp, seen = tmp_path / "in", str(tmp_path / "cp"), []
    folder.mkdir()
    whole = "".join(map(frame, range(20))).encode()
    cuts = [0, 3, 40, 41, 300, 301, len(whole) - 1, len(whole)]
    for a, b in zip(cuts, cuts[1:]):
        with open(folder / "one", "ab") as f:
            f.write(whole[a:b])
        if b == 300:
            (folder / "two").write_bytes(frame(100).encode() + b"data: half")
        taken(spark, str(folder), cp, seen)
    assert numbers(r for r in seen if r.file.endswith("one")) == list(range(20))
    assert numbers(r for r in seen if r.file.endswith("two")) == [100]
    assert numbers(events.read_frames(spark, str(folder), 64).orderBy("file", "at").collect()) == [*range(20), 100]


def test_batches_are_bounded_and_ranges_split(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    (folder / "one").write_text("".join(map(frame, range(50))))
    query = streams.run_available(events.stream_frames(spark, str(folder), 64, 200), str(tmp_path / "cp"), lambda b, _: seen.append(b.orderBy("at").collect()))
    while not query.recentProgress or numbers(x for s in seen for x in s)[-1:] != [49]:
        streams.run_available(events.stream_frames(spark, str(folder), 64, 200), str(tmp_path / "cp"), lambda b, _: seen.append(b.orderBy("at").collect()))
    assert numbers(x for s in seen for x in s) == list(range(50))
    assert max(sum(len(r.frame) + 2 for r in s) for s in seen) <= 220


def test_frames_are_parsed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a").write_text("event: a\ndata: {\"x\": 1}\n\n" + "event: b\r\ndata: {broken\r\n\r\n" + "data: [DONE]\n\n" + "event: c\ndata: 3\n\n")
    rows = events.read_frames(spark, str(tmp_path / "in")).select("at", F.explode(text.sse_events("frame")).alias("e")).orderBy("at").select("e.event", "e.data").collect()
    assert [(r.event, r.data) for r in rows] == [("a", '{"x": 1}'), ("c", "3")]


def test_written_batches_are_read_back(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "event string, data string"
    spark.createDataFrame([("a", "1"), (None, "two\nlines"), ("b", "3")], schema).coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    events.write_frames(stream(), out, str(tmp_path / "cp"))
    read = lambda: [r.frame for r in events.read_frames(spark, out).collect()]
    assert sorted(read()) == ["data: two\ndata: lines", "event: a\ndata: 1", "event: b\ndata: 3"]
    events.write_frames(stream(), out, str(tmp_path / "cp"))
    assert len(read()) == 3
    # the checkpoint is lost: batch 0 is written again, and adds nothing
    events.write_frames(stream(), out, str(tmp_path / "another"))
    assert len(read()) == 3
    assert len(list((tmp_path / "out").glob("*.sse"))) == 1


def test_commit_and_abort(tmp_path):
    writer = events.EventWriter(str(tmp_path))
    for n in "abc":
        paths.write_bytes(str(tmp_path / f"{n}.sse"), [frame(1).encode()])
    size = len(frame(1).encode())
    made = {n: events.Written(i, f"{n}.sse", size) for i, n in enumerate("abc")}
    writer.abort([made["a"], None], 0)
    writer.commit([made["b"], None], 0)
    writer.commit([made["c"]], 0)
    assert [n.rpartition("/")[2] for n, _ in events.streams_at(str(tmp_path))] == ["b.sse"]
    assert not (tmp_path / "a.sse").exists() and not (tmp_path / "c.sse").exists()
