"""URL filters: a broadcast trie over reversed host labels, then path segments.

A rule is a host and a path, with a verdict.  It fits its host and all subdomains, if the url's path starts
with the rule's path; the longest rule that fits decides, allow and block alike (more host labels first,
then the longer path).  A url that no rule fits gets the default verdict.

The trie is built on the driver from rules of at most ``MAX_CHARS`` characters (about 300 bytes of memory a rule of 30)
and broadcast; larger lists are refused there and go through ``judge_by_join``, which joins each url's host suffixes and
whole path segments with the rules'.

Defined cases: null url, or one without ``://``, has empty host and path and the default verdict (an empty
host fits no rule); of equal rules with both verdicts, block holds; equal urls give equal rows; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, only

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
DEFAULT = "allow"
MAX_CHARS = 6_000_000
#: Shares of the urls of a key in judge_by_join: most urls have the suffix com.
SALTS = 16
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Trie:
    """Host labels from the last to the first; each host node may hold a trie of path segments."""

    __slots__ = ("hosts", "paths")

    def __init__(self) -> None:
        self.hosts: dict[str, Trie] = {}
        self.paths: dict | None = None  # segment -> node; "" holds [(rest of the path, rule, verdict)], longest first

    def add(self, host: str, path: str, verdict: str) -> None:
        node = self
        for label in reversed(host.split(".")):
            node = node.hosts.setdefault(label, Trie())
        if node.paths is None:
            node.paths = {}
        *whole, rest = path.split("/")
        at = node.paths
        for segment in whole:
            at = at.setdefault("/" + segment, {})
        ends = at.setdefault("", [])
        # block before allow, so that the first of equal rules is the one that holds
        ends.append((rest, host + path, verdict))
        ends.sort(key=lambda x: (-len(x[0]), x[0], x[2] != "block"))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest rule that fits, and its verdict."""
        if not host:
            return None
        node, found = self, None
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.hosts.get(label)
            if node is None:
                break
            if node.paths is not None:
                found = self._longest(node.paths, segments) or found
        return found

    @staticmethod
    def _longest(at: dict, segments: list[str]) -> tuple[str, str] | None:
        found = None
        for i, segment in enumerate(segments):
            for rest, rule, verdict in at.get("", ()):
                if segment.startswith(rest):
                    found = (rule, verdict)
                    break
            at = at.get("/" + segment) if i < len(segments) - 1 else None
            if at is None:
                break
        return found


def build(rules: Iterable[tuple[str, str, str]]) -> Trie:
    trie, chars = Trie(), 0
    for host, path, verdict in rules:
        chars += len(host) + len(path)
        if chars > MAX_CHARS:
            raise ValueError(f"rules of more than {MAX_CHARS} characters; use judge_by_join")
        trie.add(host, path, verdict)
    return trie


def host_and_path(url: str) -> tuple[str, str]:
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    end = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    host, slash, path = rest[:end].partition("/")
    return host.translate(_UPPER), slash + path


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, the rule that decides and the verdict, per page."""
    trie = pages.sparkSession.sparkContext.broadcast(build(rules))
    slim = only(pages, "page_id", "url")
    kind = slim.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = trie.value.match
        for batch in batches:
            split = [host_and_path(u) for u in as_text(batch.column("url"))]
            found = [match(h, p) or (None, default) for h, p in split]
            columns = [[h for h, _ in split], [p for _, p in split], [r for r, _ in found], [v for _, v in found]]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *[pa.array(c, pa.string()) for c in columns]], names=["page_id", "host", "path", "rule", "verdict"])

    return slim.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


def judge_by_join(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """The same for any number of rules (columns host, path, verdict).

    A rule's key is its host and the whole segments of its path; a url's are its host suffixes with each of its path's
    beginnings of whole segments, so that a suffix that most urls have is spread by paths, and by salt.
    """
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    slim = only(pages, "page_id", "url")
    slim = slim.withColumn("rest", F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^([^?#]*)", 1))
    host = F.translate(F.regexp_extract("rest", r"(?s)^([^/]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    urls = slim.select("page_id", "url", host.alias("host"), F.regexp_extract("rest", r"(?s)^[^/]*(.*)$", 1).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    whole = lambda path: F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    starts = F.transform(F.sequence(F.lit(0), F.size(whole("path"))), lambda i: F.array_join(F.slice(whole("path"), 1, i), "/"))
    keyed = urls.select("host", "path").where("host <> ''").distinct().withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int"))
    keyed = keyed.withColumn("suffix", F.explode(suffixes)).withColumn("start", F.explode(starts))
    listed = rules.select(F.col("host").alias("suffix"), F.col("path").alias("rule_path"), "verdict", F.array_join(whole("path"), "/").alias("start"))
    listed = listed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # equal starts may come from paths of "" and "/" alike, so the whole path is compared too
    fit = keyed.join(listed, ["suffix", "start", "salt"]).where(F.col("path").startswith(F.col("rule_path")))
    length = F.struct(F.length("suffix"), F.length("rule_path"), F.col("verdict") == "block", F.concat("suffix", "rule_path").alias("rule"), "verdict")
    best = fit.groupBy("host", "path").agg(F.max(length).alias("best"))
    joined = urls.join(best, ["host", "path"], "left")
    return joined.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


ORACLE_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^([^?#]*)', 1, 's') ELSE '' END AS rest FROM pages),
urls AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/]*(.*)$', 1, 's') AS path FROM parts),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/' END AS rule FROM urls)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""
