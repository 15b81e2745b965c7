"""Secret scans: keywords by Aho-Corasick, anchored patterns only at their hits, checksums last.

One automaton pass over the text in ASCII lower case finds the keywords; the pattern of a kind is
tried only at the start of such a hit. Runs of hexadecimal digits have no keyword and are found by
one linear pattern. Kinds that carry a checksum (tokens whose last six characters are the base-62
CRC-32 of the thirty before them) are kept only if it holds; they are spans beside the base kinds.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, free_tokens, ship

# Keywords, formats and kinds in the order of the contract, checksummed prefixes after them.
KINDS = ("assign", "access", "hex", "checksummed")
ASSIGN_KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ACCESS_KEYWORD = "akia"
CHECKSUM_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CHECKSUMMED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_automaton: list = []


def checksum62(body: str) -> str:
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out.rjust(6, "0")


def _keywords():
    if not _automaton:
        import ahocorasick

        a = ahocorasick.Automaton()
        for words, kind in ((ASSIGN_KEYWORDS, 0), ((ACCESS_KEYWORD,), 1), (CHECKSUM_PREFIXES, 3)):
            for w in words:
                a.add_word(w, (kind, len(w)))
        a.make_automaton()
        _automaton.append(a)
    return _automaton[0]


def find(text: str | None) -> list[tuple[int, int, int]]:
    """(start, end, kind's number) by start, then kind, in code points. Null counts as empty."""
    if not text:
        return []
    low = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    hits: tuple[list[int], ...] = ([], [], [], [])
    for last, (kind, size) in _keywords().iter(low):
        hits[kind].append(last - size + 1)
    out = []
    end = 0
    for at in sorted(hits[0]):
        if at >= end and (m := ASSIGN.match(text, at)):
            end = m.end()
            if len(m[2]) >= 8:
                out.append((at, end, 0))
    end = 0
    for at in hits[1]:
        if at >= end and (m := ACCESS.match(text, at)):
            end = m.end()
            if end - at >= 16:
                out.append((at, end, 1))
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    for at in hits[3]:
        if (m := CHECKSUMMED.match(text, at)) and checksum62(m[1]) == m[2]:
            out.append((at, m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def redact(text: str | None) -> str | None:
    """Every span replaced by [SECRET]; overlapping spans become one."""
    found = find(text)
    if not found:
        return text
    out, at = [], 0
    for s, e, _ in found:
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    free_tokens()
    for b in by_bytes(batches):
        n: list[list[int]] = [[], [], []]
        base, spans = [], []
        for t in b.column("text").to_pylist():
            found = find(t)
            for k in range(3):
                n[k].append(sum(x[2] == k for x in found))
            named = [(f"{KINDS[k]}:{s}:{e}", k) for s, e, k in found]
            base.append(hashlib.sha256(",".join(x for x, k in named if k < 3).encode()).hexdigest())
            spans.append(",".join(x for x, _ in named))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id").cast(pa.int64()), *(pa.array(x, pa.int64()) for x in n), pa.array(base, pa.string()), pa.array(spans, pa.string())],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def secret_spans(docs: DataFrame) -> DataFrame:
    """One row for each document: counts of the base kinds, their digest, and all spans.

    Null and empty texts have no span (the digest of the empty string). Rows are independent, so
    repeated rows, null ids and empty tables need no special case; other columns are ignored.
    """
    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    free_tokens()
    for b in by_bytes(batches):
        i = b.schema.get_field_index("text")
        yield b.set_column(i, b.schema.field(i), pa.array([redact(t) for t in b.column("text").to_pylist()], b.schema.field(i).type))


def redacted(docs: DataFrame) -> DataFrame:
    """The same rows with every secret in ``text`` replaced; ``n_chars`` follows the new text."""
    ship(docs.sparkSession)
    out = docs.mapInArrow(_redact, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
