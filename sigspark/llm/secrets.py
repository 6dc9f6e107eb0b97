"""Secret scans: fixed patterns, and strings that a primed compressor finds new.

Beside the base kinds, candidates are token-like strings shortly after words that announce a secret. For each, a zstandard
compressor is primed with a dictionary of identifiers that code uses and with the text around the candidate; the bytes
that the candidate adds to its output are its marginal size. Its copies behind announcing words aren't part of that text. A string that
compresses badly so, of mixed characters, is reported as kind novel, unless a base span overlaps it.

A null text is the empty text: it holds nothing. Repeated rows give repeated results, an empty table none. Offsets are
code points, ends exclusive.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import narrow, through

#: The base kinds in order, their patterns and the least lengths; for assign that of the second group.
BASE = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
]
KINDS = [*(k for k, *_ in BASE), "novel"]
_BASE = [(kind, re.compile(p, re.ASCII), group, least) for kind, p, group, least in BASE]
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_HEX = bytes(104 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
_HEX_RUN = b"h" * 16
#: Words that announce a secret, and identifiers that code around one uses.
CONTEXT = ("password", "passwd", "passphrase", "secret", "token", "api_key", "apikey", "api-key", "credential", "bearer", "authorization", "private_key", "private key", "access_key", "access key", "client_id", "signature", "auth_key", "webhook")
IDENTIFIERS = """
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 00000000 ffffffff deadbeef example changeme placeholder
access_token refresh_token client_secret client_id api_key apikey secret_key private_key public_key password passwd username user_name
authorization bearer basic token session_id session cookie csrf request response headers content_type application/json text/html utf-8
config configuration settings environment environ getenv process.env os.environ import export return function const let var class self
this null none true false string integer number float boolean object array list dict map value key name type id url uri host port path
http https localhost 127.0.0.1 example.com aws_access_key_id aws_secret_access_key database connection connect default timeout retry
"""
#: A candidate: so many characters, within so many after an announcing word; context on each side that primes the compressor.
LEAST = 16
AFTER, AROUND = 96, 1024
#: A run is tried whole, then its parts between signs; signs that end a part are padding.
_RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
_PART = re.compile(r"[A-Za-z0-9+/_-]++(?:=++(?![A-Za-z0-9+/_-]))?")
#: The least marginal bytes a character, and the least entropy of the characters in bits. From CODED characters on, the compressor
#: codes literals, and random characters cost little more than the logarithm of their number.
NOVELTY, ENTROPY, CODED = 0.8, 3.0, 64
SPANS = "array<struct<kind: string, start: int, end: int, value_start: int, value_end: int, novelty: double>>"
_ANNOUNCE = re.compile("|".join(map(re.escape, CONTEXT)))
_LOWER = {a: a + 32 for a in range(65, 91)}


def base_spans(text: str, low: str) -> list[tuple]:
    """low: the text in lower case, only to see which patterns can match."""
    out = []
    for kind, pattern, group, least in _BASE:
        if kind == "access" and "AKIA" not in text:
            continue
        if kind == "assign":
            if ":" not in text and "=" not in text:
                continue
            if not any(k in low for k in _KEYWORDS):
                continue
        if kind == "hex" and _HEX_RUN not in text.encode("utf-8", "surrogatepass").translate(_HEX):
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((kind, m.start(), m.end(), m.start(group), m.end(group), None))
    return out


def marginal(candidate: str, before: str, after: str) -> float:
    """Bytes of output that a character of the candidate adds, to a compressor primed with its surroundings."""
    import zstandard

    primer = zstandard.ZstdCompressionDict((IDENTIFIERS + after + before).encode("utf-8", "surrogatepass"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    c = zstandard.ZstdCompressor(level=9, dict_data=primer, write_content_size=False, write_checksum=False, write_dict_id=False)
    return (len(c.compress(candidate.encode())) - len(c.compress(b""))) / len(candidate)


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def enough(s: str) -> float:
    """The marginal bytes a character from which on a string is novel."""
    return NOVELTY if len(s) < CODED else min(NOVELTY, math.log2(len(set(s))) / 8)


def without(text: str, start: int, end: int, s: str, spans: list[tuple]) -> str:
    """The text from start to end less the copies of s that lie in spans, which are in order and don't overlap."""
    out, at = [], start
    while (i := text.find(s, at, end)) >= 0:
        k = bisect.bisect_right(spans, (i, len(text))) - 1
        inside = k >= 0 and spans[k][0] <= i and i + len(s) <= spans[k][1]
        stop = i if inside else i + len(s)
        out.append(text[at:stop])
        at = i + len(s)
    return "".join([*out, text[at:end]])


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same stretches in order, those that overlap made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def novel_spans(text: str, low: str, taken: list[tuple]) -> list[tuple]:
    if not any(k in low for k in CONTEXT):
        return []
    if len(low) != len(text):  # a few letters have more than one in lower case
        low = text.translate(_LOWER)
    runs, done, stop = [], 0, 0  # start, end and parts of what follows announcing words
    for m in _ANNOUNCE.finditer(low):
        at, reach = max(m.end(), done), m.end() + AFTER + 1
        while r := _RUN.search(text, at, reach):
            a = r.start()
            stop = stop if a < stop else _RUN.match(text, a).end()
            at = stop
            if _RUN.match(text[a - 1]):  # the word is part of the run: its value is behind the sign
                a = text.find("=", a, min(stop, reach)) + 1
                while 0 < a < stop and text[a] == "=":
                    a += 1
                if not 0 < a < min(stop, reach):
                    continue
            parts = []
            for p in _PART.finditer(text, a, stop):
                if p.start() >= reach:
                    break
                parts.append(p.span())
                done = p.end()
            runs.append((a, stop, parts))
    spans = joined([(a, b) for a, b, _ in runs] + [(t[3], t[4]) for t in taken])  # all that may be a secret: a copy there doesn't make another known
    base, out = joined([(t[1], t[2]) for t in taken]), []

    def novel(a: int, b: int) -> bool:
        s = text[a:b]
        if b - a < LEAST or not (re.search(r"[0-9]", s) and re.search(r"[A-Za-z]", s)) or entropy(s) < ENTROPY or (k := bisect.bisect_left(base, (b,)) - 1) >= 0 and base[k][1] > a:
            return False
        x = marginal(s, without(text, max(0, a - AROUND), a, s, spans), without(text, b, min(len(text), b + AROUND), s, spans))
        if x >= enough(s):
            out.append(("novel", a, b, a, b, x))
            return True
        return False

    told = tried = 0
    for a, b, parts in runs:
        if a < told:
            continue
        first, tried = b > tried, b
        if first and novel(a, b):  # whole only once a run
            told = b
            continue
        for p in parts:
            if not first or p != (a, b):
                novel(*p)
    return out


def find(text: str | None) -> list[tuple]:
    """(kind, start, end, start and end of the secret itself, novelty), by start, then kind."""
    if not text:
        return []
    low = text.lower()
    found = base_spans(text, low)
    return sorted(found + novel_spans(text, low, found), key=lambda s: (s[1], KINDS.index(s[0])))


def redacted(text: str | None, spans: list[tuple], mark: str = "[REDACTED]") -> str | None:
    """The text with every secret (of an assignment, its value) replaced by the mark."""
    if not text or not spans:
        return text
    out, at = [], 0
    for a, b in sorted((s[3], s[4]) for s in spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans of every document."""
    kind = pa.struct([("kind", pa.string()), *((n, pa.int32()) for n in ("start", "end", "value_start", "value_end")), ("novelty", pa.float64())])
    names = [f.name for f in kind]

    def task(batches):
        for b in batches:
            for i in range(0, b.num_rows, 512):
                spans = [[dict(zip(names, s, strict=True)) for s in find(t)] for t in b.column(1).slice(i, 512).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 512), pa.array(spans, pa.list_(kind))], ["doc_id", "spans"])

    return narrow(docs, "doc_id", "text").mapInArrow(task, f"doc_id long, spans {SPANS}")


def clean(docs: DataFrame) -> DataFrame:
    """The documents with their secrets replaced; n_chars, if there, follows."""
    at, n = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def task(batches):
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                texts = [redacted(t, find(t)) for t in part.column(at).to_pylist()]
                cols = part.columns
                cols[at] = pa.array(texts, part.schema.field(at).type)
                if n >= 0:
                    cols[n] = pa.array([None if t is None else len(t) for t in texts], part.schema.field(n).type)
                yield pa.RecordBatch.from_arrays(cols, names=part.schema.names)

    return through(docs, task)
