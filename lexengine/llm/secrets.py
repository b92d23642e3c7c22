"""Secret scans: base patterns, and novelty of strings in sensitive contexts by dictionary-primed zstandard.

A candidate is a string of letters, digits and a few signs, with a letter at least, that follows a
sensitive word within a short distance.  Its novelty is what it adds to the compressed size of the text
around it, when the compressor is primed with a dictionary of common identifiers and words: bytes per
byte.  Strings that the surroundings or the dictionary explain cost little; incompressible ones are
reported as spans of kind ``novel``, unless a base span already covers them.  One without digits is
measured behind ``PROSE`` too, so that a word is not novel for want of letters around it; random letters
of one case cost no more than words do and are not told from them.

A long candidate is measured all along, in windows of ``WINDOW`` bytes at most: in longer ones even random
letters and digits compress below ``NOVELTY``, as their alphabet is small.  Each run of novel windows is a
span, with the windows at its ends that are novel in part.

Spans are in code points, end exclusive, found in the whole text.  Defined cases: null text is empty and
has no spans; equal texts give equal spans; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import as_bytes, only

KINDS = ("assign", "access", "hex", "novel")
# Fixed values of the base kinds.
_KEYWORDS = (b"pass", b"secret", b"token", b"api")
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(rb"[0-9a-f]{24,}")
# Sensitive contexts and candidates of the novelty measure.
_SENSITIVE = re.compile(rb"(?<![A-Za-z])(?:password|passwd|passphrase|pwd|secret|token|api[_\x20-]?key|access[_\x20-]?key|private[_\x20-]?key|signing[_\x20-]?key|client[_\x20-]?id|credentials?|authorization|bearer|session|cookie|webhook)(?![A-Za-z])", re.I)
_CANDIDATE = re.compile(rb"[A-Za-z0-9][A-Za-z0-9+/_=-]{14,}")
_START = re.compile(rb"[A-Za-z0-9](?=[A-Za-z0-9+/_=-]{14})")
REACH = 48
AROUND = 160
#: Added compressed bytes per byte of the candidate from which it is reported.
NOVELTY = 0.8
#: Most bytes of a candidate that are measured at once.
WINDOW = 128

#: What the compressor is primed with; text, in natural order.
DICTIONARY = """
import export return function const let var class public private static final void string integer boolean
null none true false self this new delete select insert update from where group order limit join
config settings environment production development staging example localhost default parameter argument
request response header content-type application/json text/html charset utf-8 authorization bearer basic
username password passwd secret token access_token refresh_token api_key apikey client_id client_secret
session_id session_token cookie csrf_token private_key public_key signing_key certificate credential
database connection host port user root admin localhost 127.0.0.1 0.0.0.0 http:// https:// www. .com .org .net
get_value set_value get_config load_config read_file write_file open_file to_string from_string to_json from_json
AbstractFactory ServiceProvider ConnectionManager RequestHandler ResponseBuilder ConfigurationManager
the and that with from this have will your been which their would there about other when what
january february march april may june july august september october november december
0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ YOUR_TOKEN_HERE YOUR_API_KEY xxxxxxxxxxxxxxxx changeme placeholder
"""
#: What letters are measured behind: common words, none of them in the dictionary as a phrase.
PROSE = b"the report of the committee was given to all members on monday and will be read again when the next meeting begins; "


@lru_cache(maxsize=1)
def _compressor():
    import zstandard

    primed = zstandard.ZstdCompressionDict(DICTIONARY.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False, write_dict_id=False)


def novelty(candidate: bytes, around: bytes) -> float:
    """Compressed bytes that the candidate adds to its surroundings, per byte of it."""
    size = _compressor().compress
    return (len(size(around + candidate)) - len(size(around))) / max(1, len(candidate))


def _novel_parts(candidate: bytes, around: bytes) -> list[tuple[int, int]]:
    """Start and end of the novel parts of a candidate, measured over all its length."""
    if not re.search(rb"[0-9]", candidate):
        around = PROSE + around
    n, parts = len(candidate), -(-len(candidate) // WINDOW)
    cuts = [n * i // parts for i in range(parts + 1)]
    measured = [novelty(candidate[s:e], around) for s, e in zip(cuts, cuts[1:])]
    out: list[tuple[int, int]] = []
    for i, x in enumerate(measured):
        if x >= NOVELTY:
            first = i - (i > 0 and measured[i - 1] >= NOVELTY / 2)
            last = i + (i + 1 < parts and measured[i + 1] >= NOVELTY / 2)
            start = out.pop()[0] if out and cuts[first] <= out[-1][1] else cuts[first]
            out.append((start, cuts[last + 1]))
    return out


def _base(data: bytes) -> list[tuple[int, int, int]]:
    low = data.lower()
    found = []
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(data) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in data:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(data)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(data)]
    return found


def _novel(data: bytes, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out: list[tuple[int, int, int]] = []
    base = sorted(base)
    starts, ends = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    reached = 0
    for key in _SENSITIVE.finditer(data):
        stop, at = key.end() + REACH, max(key.end(), reached)
        # candidates that start within reach; no byte beyond it is read for their start
        while at <= stop and (first := _START.search(data, at, stop + 15)):
            m = _CANDIDATE.match(data, first.start())
            at = reached = m.end()
            word, i = m[0], bisect_left(starts, m.end())
            if not re.search(rb"[A-Za-z]", word) or (i and ends[i - 1] > m.start()):
                continue
            around = data[max(0, m.start() - AROUND) : m.start()] + data[m.end() : m.end() + AROUND]
            out += [(m.start() + s, 3, m.start() + e) for s, e in _novel_parts(word, around)]
    return out


def _spell(data: bytes, spans: list[tuple[int, int, int]]) -> list[str]:
    """kind:start:end in code points, by start, then kind."""
    out, at, points = [], 0, 0
    ascii_only = data.isascii()
    for s, kind, e in sorted(spans):
        if ascii_only:
            first, last = s, e
        else:
            points += len(data[at:s].decode("utf-8", "replace"))
            at = s
            first, last = points, points + len(data[s:e].decode("utf-8", "replace"))
        out.append(f"{KINDS[kind]}:{first}:{last}")
    return out


def scan(data: bytes) -> tuple[int, int, int, str, str]:
    """n_assign, n_access, n_hex, base_sha256 and spans of one text."""
    base = _base(data)
    every = base + (_novel(data, base) if _SENSITIVE.search(data) else [])
    told = ",".join(_spell(data, base))
    counts = [sum(k == i for _, k, _ in base) for i in range(3)]
    return (*counts, hashlib.sha256(told.encode()).hexdigest(), ",".join(_spell(data, every)))


SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, their digest and all spans, per document."""
    slim = only(docs, "doc_id", "text")
    schema = T.StructType([slim.schema["doc_id"], *T._parse_datatype_string(SCHEMA)])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(x) for x in as_bytes(batch.column("text"))]
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, list(arrow)[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(arrow[0].type), *columns], schema=arrow)

    return slim.mapInArrow(run, schema)
