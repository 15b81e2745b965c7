"""Vectorised words, lines and five-word shingles over Arrow string buffers.

Works on the UTF-8 bytes of a whole batch at once. Hashes are 64 bits wide: a prefix sum of
``value[byte] * base**position`` gives the hash of any span by one subtraction, so no Python
string is made for a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240229)
#: A random value of 64 bits for each byte; A-Z take the values of a-z.
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_VALUE[65:91] = BYTE_VALUE[97:123]
BASE = int(0x9E3779B97F4A7C15)
BASE_INV = pow(BASE, -1, 2**64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
SHINGLE = 5
#: Bytes hashed at once: what is kept for each byte exists for one block only.
BLOCK = 1 << 20
_powers: list[np.ndarray] = []


def powers() -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0 to BLOCK - 1."""
    if not _powers:
        for base in (BASE, BASE_INV):
            a = np.full(BLOCK, base, np.uint64)
            a[0] = 1
            _powers.append(np.cumprod(a, dtype=np.uint64))
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def string_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    off = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def spans(buf: np.ndarray, off: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs outside ``gap`` and, for each document, where its runs begin."""
    n = len(buf)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~gap
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of every span (ascending, not overlapping): one block of bytes after the other."""
    up, down = powers()
    out, carry = np.zeros(len(starts), np.uint64), np.uint64(0)
    for lo in range(0, len(buf), BLOCK):
        part = buf[lo : lo + BLOCK]
        total = np.zeros(len(part) + 1, np.uint64)
        np.multiply(BYTE_VALUE[part], up[: len(part)], out=total[1:])
        if lo:
            total[1:] *= np.uint64(pow(BASE, lo, 2**64))
        total[0] = carry
        np.cumsum(total, out=total)
        i, j = np.searchsorted(starts, (lo, lo + len(part)))
        out[i:j] -= total[starts[i:j] - lo]
        i, j = np.searchsorted(ends, (lo + 1, lo + len(part) + 1))
        out[i:j] += total[ends[i:j] - lo]
        carry = total[-1]
    for lo in range(0, len(buf), BLOCK):
        i, j = np.searchsorted(starts, (lo, lo + BLOCK))
        out[i:j] *= down[starts[i:j] - lo] * np.uint64(pow(BASE_INV, lo, 2**64))
    return mix(out)


def shingle_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of every text (repeats included) and the offsets by text.

    Fewer than five words: the whole sequence is one shingle. No word: none.
    """
    buf, off = string_bytes(texts)
    starts, ends, first = spans(buf, off, IS_SPACE[buf])
    h = span_hashes(buf, starts, ends)
    words = np.diff(first)
    count = np.where(words >= SHINGLE, words - SHINGLE + 1, np.minimum(words, 1))
    out_off = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=out_off[1:])
    out = np.empty(out_off[-1], np.uint64)
    a = np.uint64(0xD6E8FEB86659FD93)
    if len(h) >= SHINGLE:
        full = h[: len(h) - SHINGLE + 1].copy()
        for k in range(1, SHINGLE):
            full = full * a + h[k : len(h) - SHINGLE + 1 + k]
        full = mix(full)
        doc_of = np.repeat(np.arange(len(words)), words)[: len(full)]
        ok = np.arange(len(full)) + SHINGLE <= first[1:][doc_of]
        long_docs = words >= SHINGLE
        out[np.repeat(long_docs, count)] = full[ok]
    for i in np.flatnonzero((words > 0) & (words < SHINGLE)):
        x = np.uint64(words[i])
        with np.errstate(over="ignore"):
            for w in h[first[i] : first[i + 1]]:
                x = x * a + w
        out[out_off[i]] = mix(np.array([x ^ np.uint64(0xA5A5A5A5A5A5A5A5)], np.uint64))[0]
    return out, out_off
