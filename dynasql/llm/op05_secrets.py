"""Secret scan (operator 5).

Method: one Aho-Corasick pass over each text finds every keyword; regular
expressions are anchored at the hits and nowhere else, so their cost follows
the hits and not the text; formats that embed a checksum are kept only if it
holds. Runs of hex digits have no keyword and are found in one pass of their
own.

Spans are in code points, end exclusive. Kinds, in order: assign, access, hex
(the base ones), then github and npm, whose last six characters are the CRC-32
of the part before them in base 62.

Defined results: a null text is empty; empty texts have no spans; texts of any
length are scanned whole; a null doc_id is carried; repeated rows each get a
row. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .base import documents

#: Kinds in order, keywords by kind, and what must follow them.
KINDS = ("assign", "access", "hex", "github", "npm")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
}
ANCHORED = {
    "assign": re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "github": re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "npm": re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
}
HEX = re.compile(rb"[0-9a-f]{24,}")
MIN_VALUE, MIN_ACCESS = 6, 20
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62(number: int, width: int) -> str:
    out = ""
    while number or len(out) < width:
        number, digit = divmod(number, 62)
        out = BASE62[digit] + out
    return out


def checksum_holds(body: bytes, check: bytes) -> bool:
    return base62(zlib.crc32(body), 6).encode() == check


def _passes(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[2]) >= MIN_VALUE
    if kind == "access":
        return len(m[0]) >= MIN_ACCESS
    return checksum_holds(m[1], m[2])


def _automaton():
    """Keywords in lower case; the value lists (kind, length) of each."""
    found = ahocorasick.Automaton()
    for kind, all_words in KEYWORDS.items():
        for word in all_words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


_loaded: list = []


def scan(data: bytes) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of every span in UTF-8 bytes, in order.

    Matches of a kind are leftmost and do not overlap; one that fails its check
    still ends where it ends, and the next starts behind it. ASCII patterns mean
    the same over bytes as over characters. Each keyword's text differs from
    every other keyword's at its start, so hits by start are the matches' starts.
    """
    if not _loaded:
        _loaded.append(_automaton())
    hits = sorted((end + 1 - n, kind) for end, (kind, n) in _loaded[0].iter(data.lower().decode("latin-1")))
    spans, ends = [], dict.fromkeys(KINDS, 0)
    for start, kind in hits:
        if start >= ends[kind] and (m := ANCHORED[kind].match(data, start)):
            ends[kind] = m.end()
            if _passes(kind, m):
                spans.append((start, KINDS.index(kind), m.end()))
    spans += [(m.start(), KINDS.index("hex"), m.end()) for m in HEX.finditer(data)]
    spans.sort()
    return spans


def in_characters(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans in code points, counted once from the front to the last of them."""
    if not spans or data.isascii():
        return spans
    places = sorted({x for s, _, e in spans for x in (s, e)})
    counted, before, n = [], 0, 0
    for p in places:
        n += len(data[before:p].decode())
        counted.append(n)
        before = p
    at = lambda x: counted[bisect_left(places, x)]
    return [(at(s), k, at(e)) for s, k, e in spans]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1).cast(pa.binary()):
            data = text.as_py() or b""
            spans = in_characters(data, scan(data))
            counts = [sum(k == i for _, k, _ in spans) for i in range(len(KINDS))]
            base = [x for x in spans if x[1] < 3]
            rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
        columns = list(zip(*rows, strict=True)) or [()] * 7
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        names = ["doc_id", "n_assign", "n_access", "n_hex", "n_github", "n_npm", "base_sha256", "spans"]
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds)], names)


def secrets(docs: DataFrame) -> DataFrame:
    """Counts by kind, digest of the base spans, and all spans, for each row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_github long, n_npm long, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(_map, schema)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(documents(spark, sf_dir))
