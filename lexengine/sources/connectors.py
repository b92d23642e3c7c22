"""Model and web connectors as injectable functions, with deterministic stand-ins for use without a network."""

from __future__ import annotations

import http.client
import inspect
import json
import os
import threading
import time
import urllib.error
import urllib.parse
import urllib.request
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial
from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pace import LEAST, MOST, WINDOW, Pace, paced

Embed = Callable[[list[str]], np.ndarray]
Rerank = Callable[[str, list[str]], list[tuple[int, float]]]


@dataclass(frozen=True)
class Settings:
    """Addresses and models, from the environment unless given."""

    embed_url: str = field(default_factory=lambda: os.environ.get("EMBED_URL", ""))
    embed_model: str = field(default_factory=lambda: os.environ.get("EMBED_MODEL", ""))
    rerank_url: str = field(default_factory=lambda: os.environ.get("RERANK_URL") or os.environ.get("EMBED_URL", ""))
    rerank_model: str = field(default_factory=lambda: os.environ.get("RERANK_MODEL") or os.environ.get("EMBED_MODEL", ""))
    api_key: str = field(default_factory=lambda: os.environ.get("RERANK_API_KEY") or os.environ.get("EMBED_API_KEY", ""), repr=False)
    timeout: float = 120.0
    query_prefix: str = ""


#: What a service may fail with: no connection, an error status, or an answer that is not what was agreed.  Other errors are the caller's.
FAILURES = (OSError, ValueError, KeyError)


def fetch(
    url: str, body: dict | None = None, headers: dict | None = None, retries: int = 3, timeout: float = 30.0, wait: Callable[[float], None] = time.sleep, open_url=urllib.request.urlopen,
    params: dict | None = None, form: dict | None = None, pace: Throttle | None = None,
) -> str:
    """A response's text; server and network failures, and broken answers, are tried again after 5, 10, 20 ... seconds, client failures raise at once.

    params are added to the address; a body is posted as JSON, a form as form fields.  With a pace each attempt waits for its delay
    and is timed by itself, without the waits between attempts.
    """
    if params:
        url = f"{url}{'&' if '?' in url else '?'}{urllib.parse.urlencode(params)}"
    data, kind = (urllib.parse.urlencode(form).encode(), "application/x-www-form-urlencoded") if form is not None else (None if body is None else json.dumps(body).encode(), "application/json")

    def attempt() -> str:
        request = urllib.request.Request(url, data=data, headers={"Content-Type": kind, **(headers or {})})
        with open_url(request, timeout=timeout) as response:
            return response.read().decode()

    for again in range(retries):
        try:
            return pace.request(attempt) if pace else attempt()
        except urllib.error.HTTPError as e:
            if e.code < 500 or again == retries - 1:
                raise
        except (OSError, http.client.HTTPException):
            if again == retries - 1:
                raise
        wait(5.0 * 2**again)
    raise ValueError("retries must be at least 1")


class Throttle:
    """Paces the requests of one task: a bound on what is in flight, and a delay that follows the response times by ``functions.pace``."""

    def __init__(self, concurrency: int = 4, window: int = WINDOW, least: float = LEAST, most: float = MOST, wait: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> None:
        self.concurrency, self._bounds = concurrency, (window, least, most)
        self.pace, self._lock, self._wait, self._clock = Pace(delay=least), threading.Lock(), wait, clock

    def record(self, elapsed: float) -> None:
        with self._lock:
            self.pace, _ = paced(self.pace, elapsed, *self._bounds)

    def request(self, call: Callable):
        """One attempt: waits for the delay, calls, and records how long the answer took; an attempt that fails is not recorded."""
        self._wait(self.pace.delay)
        began = self._clock()
        out = call()
        self.record(self._clock() - began)
        return out

    def run(self, call: Callable, items: Iterable) -> Iterator:
        """call(item) of each item, in order, with at most ``concurrency`` of them in flight."""
        items = iter(items)
        with ThreadPoolExecutor(self.concurrency) as pool:
            flying = deque(pool.submit(call, x) for x in islice(items, self.concurrency))
            while flying:
                out = flying.popleft().result()
                flying.extend(pool.submit(call, x) for x in islice(items, 1))
                yield out


def http_embedder(settings: Settings) -> Embed:
    """An embedding service that takes {model, input, normalized} and gives {data: [{embedding}]}."""

    def embed(texts: list[str]) -> np.ndarray:
        answer = json.loads(fetch(f"{settings.embed_url}/v1/embeddings", {"model": settings.embed_model, "input": texts, "normalized": True}, {"Authorization": f"Bearer {settings.api_key}"}, timeout=settings.timeout))
        return np.array([x["embedding"] for x in answer["data"]], np.float32)

    return embed


def http_reranker(settings: Settings, top_n: int | None = None) -> Rerank:
    """A rerank service that takes {model, query, documents, top_n} and gives {results: [{index, relevance_score}]}.

    Without top_n it is asked for the scores of all documents; with it, the others come back without score.
    """

    def rerank(query: str, documents: list[str]) -> list[tuple[int, float]]:
        body = {"model": settings.rerank_model, "query": query, "documents": documents, "top_n": len(documents) if top_n is None else top_n, "return_documents": False}
        answer = json.loads(fetch(f"{settings.rerank_url}/v1/rerank", body, {"Authorization": f"Bearer {settings.api_key}"}, timeout=settings.timeout))
        return [(r["index"], r["relevance_score"]) for r in answer["results"]]

    return rerank


def hash_embedder(dimension: int = 64) -> Embed:
    """A stand-in: each word adds a signed unit at a hashed place; vectors have unit length."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension), np.float32)
        for row, text in enumerate(texts):
            for word in text.lower().split():
                h = xxhash.xxh3_64_intdigest(word)
                out[row, h % dimension] += 1.0 if h >> 63 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-10)

    return embed


def overlap_reranker() -> Rerank:
    """A stand-in: the share of the query's words that a document holds."""

    def rerank(query: str, documents: list[str]) -> list[tuple[int, float]]:
        words = set(query.lower().split())
        return [(i, len(words & set(d.lower().split())) / max(1, len(words))) for i, d in enumerate(documents)]

    return rerank


def embed_column(rows: DataFrame, column: str, embed: Embed, into: str = "embedding", batch: int = 32, zero_on_error: bool = False, dimension: int | None = None) -> DataFrame:
    """Adds the embedding of a text column; the embedder is called with batches.  Failures raise, or give zeros."""
    text = F.coalesce(F.col(column), F.lit(""))

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out: list[np.ndarray] = []
            texts = part.tolist()
            for at in range(0, len(texts), batch):
                lot = texts[at : at + batch]
                try:
                    out += list(np.asarray(embed(lot), np.float32))
                except FAILURES:
                    if not zero_on_error or not dimension:
                        raise
                    out += [np.zeros(dimension, np.float32)] * len(lot)
            yield pd.Series(out, index=part.index, dtype=object)

    return rows.withColumn(into, run(text))


def fetch_pages(requests: DataFrame, get: Callable[..., str], concurrency: int = 4, least: float = 0.05, most: float = 2.0) -> DataFrame:
    """The requests with html, the answer to each row's url, or to its url and form (a map) where there is one.

    Each task keeps ``concurrency`` requests in flight at most, at the pace of a ``Throttle``; so a cluster keeps that many
    times its tasks, which the number of partitions bounds.  A get that takes ``pace``, as ``fetch`` does, is given it, and times
    each of its attempts; else each call of get is timed.
    """
    columns = requests.columns
    posts = "form" in columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        throttle = Throttle(concurrency, least=least, most=most)
        own = "pace" in inspect.signature(get).parameters

        def ask(row) -> str:
            call = partial(get, row.url, dict(row.form)) if posts and row.form is not None else partial(get, row.url)
            return call(pace=throttle) if own else throttle.request(call)

        for frame in frames:
            yield frame.assign(html=list(throttle.run(ask, frame.itertuples(index=False))))

    return requests.mapInPandas(run, T.StructType([*requests.schema.fields, T.StructField("html", T.StringType())]))


class RpcClient:
    """A JSON-RPC 2.0 client: send takes a message as JSON text; receive is given every message that comes in.

    Requests are numbered from 1 and wait until their answer is received; notifications go to the handler of their method.
    """

    def __init__(self, send: Callable[[str], None]) -> None:
        self._send, self._next, self._lock = send, 0, threading.Lock()
        self._waiting: dict[int, Future] = {}
        self._handlers: dict[str, Callable[[dict], None]] = {}
        self.tools: list[dict] = []

    def request(self, method: str, params: dict | None = None) -> Future:
        """A future of the result; an error answer, or a failure to send, is its exception."""
        with self._lock:
            self._next += 1
            number, answer = self._next, Future()
            self._waiting[number] = answer
        try:
            self._send(json.dumps({"jsonrpc": "2.0", "id": number, "method": method, "params": params or {}}))
        except OSError as e:
            self._waiting.pop(number, None)
            answer.set_exception(e)
        return answer

    def notify(self, method: str, params: dict | None = None) -> None:
        self._send(json.dumps({"jsonrpc": "2.0", "method": method, "params": params or {}}))

    def on(self, method: str, handler: Callable[[dict], None]) -> None:
        self._handlers[method] = handler

    def receive(self, message: str) -> None:
        told = json.loads(message)
        if told.get("id") is not None and "method" not in told:
            answer = self._waiting.pop(told["id"], None)
            if answer is not None and "error" in told:
                answer.set_exception(ValueError(told["error"].get("message", "error")))
            elif answer is not None:
                answer.set_result(told.get("result"))
        elif "method" in told:
            if told["method"] == "tools/list":
                self.tools = told.get("params", {}).get("tools", [])
            handler = self._handlers.get(told["method"])
            if handler is not None:
                handler(told.get("params", {}))

    def connect(self, name: str, version: str, timeout: float = 30.0) -> dict:
        """The handshake: what the server says of itself; its tools are kept."""
        info = self.request("initialize", {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}, "sampling": {}}, "clientInfo": {"name": name, "version": version}}).result(timeout)
        self.notify("notifications/initialized")
        self.tools = (self.request("tools/list").result(timeout) or {}).get("tools", [])
        return info

    def call_tool(self, name: str, arguments: dict, timeout: float = 30.0):
        return self.request("tools/call", {"name": name, "arguments": arguments}).result(timeout)

    def tool(self, name: str) -> dict | None:
        return next((t for t in self.tools if t["name"] == name), None)

    def close(self) -> None:
        """Requests without an answer are given up."""
        while self._waiting:
            self._waiting.popitem()[1].cancel()


def http_chat(settings: Settings, url: str, model: str, wait: Callable[[float], None] = time.sleep) -> Callable[[list[dict]], str]:
    """A chat service; its reasoning is taken where there is one, else its content.  Tried three times, two seconds apart."""

    def call(messages: list[dict]) -> str:
        for attempt in range(3):
            try:
                answer = json.loads(fetch(f"{url}/chat/completions", {"model": model, "messages": messages}, {"Authorization": f"Bearer {settings.api_key}"}, retries=1, timeout=300.0))
                message = answer["choices"][0]["message"]
                return message.get("reasoning_content") or message.get("content") or ""
            except urllib.error.HTTPError:
                if attempt == 2:
                    raise
                wait(2.0)
        return ""

    return call
