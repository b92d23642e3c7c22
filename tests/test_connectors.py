import http.client
import json
import threading
import time
import urllib.parse
from concurrent.futures import CancelledError

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexengine.functions import text
from lexengine.operators import ingest, rerank
from lexengine.sources import entries as sources
from lexengine.sources import matrices as matrices_source
from lexengine.sources.connectors import RpcClient, Settings, Throttle, embed_column, fetch, fetch_pages, http_reranker


class Answer:
    def __init__(self, body):
        self.body = body

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False

    def read(self):
        return self.body.encode()


def test_requests_have_parameters_and_forms():
    seen = []
    open_url = lambda request, timeout: (seen.append(request), Answer("ok"))[1]
    assert fetch("http://x/s", params={"s": "ā b", "dia": "d"}, open_url=open_url) == "ok"
    fetch("http://x/more?a=1", params={"b": 2}, form={"word": "wūnda", "numb": "3"}, open_url=open_url)
    fetch("http://x", body={"q": 1}, open_url=open_url)
    assert seen[0].full_url == "http://x/s?" + urllib.parse.urlencode({"s": "ā b", "dia": "d"}) and seen[0].data is None
    assert seen[1].full_url == "http://x/more?a=1&b=2" and urllib.parse.parse_qs(seen[1].data.decode()) == {"word": ["wūnda"], "numb": ["3"]}
    assert seen[1].headers["Content-type"] == "application/x-www-form-urlencoded" and json.loads(seen[2].data) == {"q": 1}


def test_throttle_bounds_what_is_in_flight_and_keeps_order():
    lock, now, most = threading.Lock(), [0], [0]

    def call(x):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.002)
        with lock:
            now[0] -= 1
        return x * 2

    assert list(Throttle(3, least=0.0).run(call, range(40))) == [2 * i for i in range(40)]
    assert 1 < most[0] <= 3


def test_throttle_follows_the_same_rule_as_the_batch_operator(spark):
    rng = np.random.default_rng(1)
    times = [float(rng.random() * (4 if 60 < i < 100 else 1) + 0.1) for i in range(150)]
    throttle, want = Throttle(), []
    for t in times:
        throttle.record(t)
        want.append(throttle.pace.delay)
    rows = spark.createDataFrame([("a", i, t) for i, t in enumerate(times)] + [("b", i, 1.0) for i in range(30)] + [("b", 99, None)], "key string, seq bigint, elapsed double")
    got = ingest.throttle(rows).orderBy("key", "seq").collect()
    assert [r.delay for r in got if r.key == "a"] == pytest.approx(want) and len(got) == 180 and len(set(want)) > 5


def test_each_attempt_is_timed_by_itself():
    # answers take 0.1 s, and every other attempt fails; the waits between attempts don't count
    now, attempts = [0.0], [0]

    def wait(seconds):
        now[0] += seconds

    class Answer:
        def __enter__(self):
            now[0] += 0.1
            return self

        def __exit__(self, *_):
            pass

        def read(self):
            return b"ok"

    def open_url(request, timeout):
        attempts[0] += 1
        if attempts[0] % 2:
            now[0] += 30.0
            raise [OSError("down"), http.client.IncompleteRead(b"")][attempts[0] // 2 % 2]
        return Answer()

    throttle = Throttle(1, wait=wait, clock=lambda: now[0])
    assert [fetch("http://x", wait=wait, open_url=open_url, pace=throttle) for _ in range(60)] == ["ok"] * 60
    assert attempts[0] == 120 and throttle.pace.delay == 0.05 and throttle.pace.baseline == pytest.approx(0.1)


def test_pages_are_fetched_with_forms(spark):
    stubs = spark.createDataFrame([("a", "1", "n"), ("b", "", "n"), ("c", "2", None)], "word string, paradigm string, desc string")
    asked = ingest.form_requests(stubs, "http://x/more", "d")
    got = fetch_pages(asked, lambda url, form: f"{url} {form['word']}{form['numb']}{form['dia']}", least=0.0).collect()
    assert sorted(r.html for r in got) == ["http://x/more a1d", "http://x/more c2d"]
    plain = fetch_pages(ingest.search_requests(spark.createDataFrame([("ab",)], "prefix string"), "http://x", "d"), lambda url: url[-5:], least=0.0).first()
    assert plain.prefix == "ab" and plain.html == "dia=d"


def test_reranker_may_ask_for_the_best_only(monkeypatch):
    from lexengine.sources import connectors

    bodies = []
    monkeypatch.setattr(connectors, "fetch", lambda url, body, headers, timeout: (bodies.append(body), '{"results": [{"index": 1, "relevance_score": 0.5}]}')[1])
    assert http_reranker(Settings(), top_n=1)("q", ["a", "b"]) == [(1, 0.5)] and http_reranker(Settings())("q", ["a", "b"]) == [(1, 0.5)]
    assert [b["top_n"] for b in bodies] == [1, 2]


def test_failures_of_services_fall_back_and_programming_errors_do_not(spark):
    rows = spark.createDataFrame([(1, "q", 1, 0, 0, "d")], "qid bigint, query string, rank int, batch bigint, index bigint, doc string")

    def down(query, docs):
        raise OSError("down")

    def wrong(query, docs):
        return [(0, undefined_name)]  # noqa: F821

    assert rerank.score_batches(rows, down).first().relevance is None
    with pytest.raises(Exception, match="undefined_name"):
        rerank.score_batches(rows, wrong).collect()
    with pytest.raises(Exception, match="undefined_name"):
        embed_column(rows, "doc", lambda texts: undefined_name, zero_on_error=True, dimension=2).collect()  # noqa: F821


def test_rpc():
    sent = []
    client = RpcClient(lambda m: sent.append(json.loads(m)))
    answers = {"initialize": {"serverInfo": {"name": "s"}}, "tools/list": {"tools": [{"name": "lookup"}]}, "tools/call": [1]}

    def serve(message):
        told = json.loads(message)
        sent.append(told)
        if "id" in told:
            client.receive(json.dumps({"jsonrpc": "2.0", "id": told["id"], "result": answers[told["method"]]}))

    client._send = serve
    assert client.connect("me", "1")["serverInfo"] == {"name": "s"} and client.tool("lookup") == {"name": "lookup"} and client.tool("none") is None
    assert client.call_tool("lookup", {"word": "x"}) == [1] and [m.get("id") for m in sent] == [1, None, 2, 3]
    told = []
    client.on("progress", told.append)
    client.receive('{"jsonrpc": "2.0", "method": "progress", "params": {"n": 1}}')
    client.receive('{"jsonrpc": "2.0", "method": "unknown"}')
    client.receive('{"jsonrpc": "2.0", "method": "tools/list", "params": {"tools": []}}')
    assert told == [{"n": 1}] and client.tools == []
    client._send = lambda m: None
    # answers out of order, an error, an answer nobody waits for, and one that never comes
    a, b, c = (client.request("m", {"i": i}) for i in range(3))
    client.receive('{"jsonrpc": "2.0", "id": 5, "result": "b"}')
    client.receive('{"jsonrpc": "2.0", "id": 4, "error": {"message": "no"}}')
    client.receive('{"jsonrpc": "2.0", "id": 77, "result": 0}')
    assert b.result(1) == "b" and isinstance(a.exception(1), ValueError)
    client.close()
    with pytest.raises(CancelledError):
        c.result(1)

    def broken(_):
        raise OSError("down")

    client._send = broken
    assert isinstance(client.request("m").exception(1), OSError)


def test_state_and_matrices(spark, tmp_path):
    state = {"phase": "complete", "done_prefixes": ["aa"], "done_3letter": ["aab"], "completed_words": 7}
    sources.write_state(spark, str(tmp_path / "state"), state)
    assert sources.state_row(spark, str(tmp_path / "state")) == state
    matrices = [np.random.default_rng(i).random((n, 4), np.float32) for i, n in enumerate((5, 3))]
    for name, m in zip("ab", matrices):
        np.save(tmp_path / f"{name}.npy", m)
    rows = matrices_source.read_npy(spark, str(tmp_path / "*.npy")).orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(8)) and np.allclose([r.embedding for r in rows], np.vstack(matrices)) and [r.row for r in rows] == [0, 1, 2, 3, 4, 0, 1, 2]


def test_trial_run(spark):
    words = spark.createDataFrame([("buttan", "1", "n"), ("buttans", "1", "n"), ("wundan", "2", "n")], "word string, paradigm string, desc string")
    search = lambda asked: words.join(asked.withColumnRenamed("word", "asked"), words["word"].startswith(F.col("asked")))
    results = lambda stubs: stubs.select("word", "paradigm", F.lit("miks").alias("lang"), F.lit(0).alias("n"), F.array(F.upper("word")).alias("translations"))
    got = ingest.trial(search, results, spark).orderBy("word").collect()
    assert [(r.word, r.translations) for r in got] == [("buttan", {"miks": ["BUTTAN"]}), ("wundan", {"miks": ["WUNDAN"]})] and len(ingest.TRIAL_WORDS) == 5


def test_messages(spark):
    table = {"de": {"hits": "{count} Treffer {count}", "a": "x"}, "lt": {"hits": "{count} rasta", "a": ""}}
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    say = lambda lang, key: one(text.message(table, F.lit(lang), F.lit(key), {"count": F.lit("3")}))
    assert say("lt", "hits") == "3 rasta" and say("fr", "hits") == "3 Treffer {count}" and say("lt", "a") == "x" and say("lt", "none") == "none"
    assert [one(text.reader_language(F.lit(x))) for x in ("lt-LT", "de", "CH", "fr", "en-US", "", None)] == ["lt", "de", "de", "lt", "de", "de", "de"]
    assert one(text.shown(F.lit("<b>&"))) == "&lt;b&gt;&" and one(text.broken_lines(F.lit("a\nb"))) == "a<br>b"
    made = json.loads(one(text.completion(F.lit(None).cast("string"), F.lit("m"), F.lit('a"b}'), F.lit("stop"), F.lit(2), F.lit(3))))
    assert made["id"] == "chatcmpl-none" and made["choices"] == [{"index": 0, "message": {"role": "assistant", "content": 'a"b}', "tool_calls": []}, "finish_reason": "stop"}] and made["usage"]["total_tokens"] == 5
    assert one(text.result_row(F.lit(3), F.lit("wūnda"), F.lit("n"), F.lit("m"), F.lit("W" * 50), F.lit(0.5))) == f"{3:2d}. {'wūnda':20s} [{'n m':10s}] {'W' * 40:40s} | {0.5:.4f}"
