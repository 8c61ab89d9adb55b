"""Vectorised word hashes over batches of UTF-8 texts.

A word is a run of bytes outside 0x20 and 0x09-0x0D, which equals the pattern
``[^\\x20\\x09-\\x0D]+`` on code points since those bytes never occur inside a
multi-byte character.  All functions take whole texts; a null is an empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"

#: Bytes of text that are handled at a time (a longer text is handled alone).
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES = np.random.default_rng(20240131).integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_GRAM_SALTS = [np.uint64((k * int(_BASE)) % 2**64) for k in range(1, 65)]
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse modulo 2**64, for i < n."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(max(n, CHUNK_BYTES + 4096), base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blobs(column) -> list[bytes]:
    """A pyarrow string column as UTF-8 bytes; null becomes empty."""
    import pyarrow as pa

    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes, or of one longer text."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One byte array with a line feed after each text, and where each text starts."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return buf, starts


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; buf ends with white space."""
    inside = ~_SPACE[buf]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    return edge[::2], edge[1::2]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes."""
    power, inverse = _powers(len(buf) + 1)
    pre = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_VALUES[buf] * power[: len(buf)], out=pre[1:])
    return mixed((pre[ends] - pre[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def window_hashes(buf: np.ndarray, width: int) -> np.ndarray:
    """What span_hashes gives for each run of ``width`` bytes."""
    n = max(len(buf) - width + 1, 0)
    power, inverse = _powers(len(buf) + 1)
    pre = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_VALUES[buf] * power[: len(buf)], out=pre[1:])
    return mixed((pre[width:] - pre[:n]) * inverse[:n] + np.uint64(width))


def words(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each text where its words start (one more at the end)."""
    buf, at = joined(texts)
    if lower:
        buf = _LOWER[buf]
    s, e = word_spans(buf)
    return span_hashes(buf, s, e), np.searchsorted(s, at)


def grams(hashes: np.ndarray, at: np.ndarray, n: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of a text, and where each text's start.

    With ``whole``, a text of 1 to n-1 words gives its whole sequence as one.
    """
    count = np.diff(at)
    have = np.maximum(count - n + 1, 0)
    if whole:
        have = np.where((count > 0) & (count < n), 1, have)
    out_at = np.zeros(len(at), np.int64)
    np.cumsum(have, out=out_at[1:])
    first = np.repeat(at[:-1] - out_at[:-1], have) + np.arange(out_at[-1])
    length = np.minimum(np.repeat(count, have), n)
    acc = length.astype(np.uint64)
    for k in range(n):
        part = hashes[np.minimum(first + k, max(len(hashes) - 1, 0))] if len(hashes) else acc
        term = mixed(part + _GRAM_SALTS[k])
        acc = acc * np.uint64(0xD6E8FEB86659FD93) + np.where(k < length, term, np.uint64(0))
    return mixed(acc), out_at


def owner(at: np.ndarray) -> np.ndarray:
    """The text of each item, given where each text's items start."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def distinct(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values, ascending and without repeats."""
    v, who = values.copy(), owner(at)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        v[a:b].sort()
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (who[1:] != who[:-1])
    return v[keep], np.searchsorted(who[keep], np.arange(len(at)))
