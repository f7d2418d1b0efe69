"""Vectorised numpy tokenisation of a batch of texts, on UTF-8 bytes.

Separators are always ASCII, so splitting bytes equals splitting code points. Every hash is a function
of the bytes alone: the same on every executor, in every Python process and for every batch layout.
"""

from __future__ import annotations

import numpy as np

#: Fixed odd multiplier of the polynomial word hash and its inverse modulo 2**64.
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power_table(n: int, base: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16, 0 if have is None else 2 * len(have))
        with np.errstate(over="ignore"):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[base] = have = np.cumprod(table, dtype=np.uint64)
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def byte_set(spec: str, high: bool) -> np.ndarray:
    """256 booleans: the bytes of ``spec`` (ASCII), and all bytes of non-ASCII code points if ``high``."""
    table = np.zeros(256, dtype=bool)
    table[list(spec.encode("ascii"))] = True
    table[128:] = high
    return table


#: Bytes of words that end at ASCII white space only.
NOT_SPACE = ~byte_set(" \t\n\x0b\x0c\r", False)
#: Bytes of words of ASCII letters, ASCII digits and non-ASCII code points.
WORDY = byte_set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", True)
#: A-Z to a-z; all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def encode(texts) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each followed by one newline, and n + 1 offsets; null counts as empty."""
    parts = [b"" if t is None else t.encode("utf-8", "replace") for t in texts]
    ends = np.cumsum(np.fromiter((len(p) + 1 for p in parts), dtype=np.int64, count=len(parts)))
    data = np.frombuffer(b"\n".join([*parts, b""]), dtype=np.uint8)
    return data, np.concatenate([np.zeros(1, dtype=np.int64), ends])


def words(data: np.ndarray, wordy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the maximal runs of ``wordy`` bytes. Data ends with a separator."""
    flags = wordy[data].view(np.int8)
    step = np.diff(flags, prepend=np.int8(0))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, independent of where the word stands."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    n = len(data)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_table(n, _P), out=sums[1:])
        h = (sums[ends] - sums[starts]) * _power_table(n, _P_INV)[starts]
        return mix64(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def ngram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive word hashes; with fewer words, but not none, the whole sequence as one."""
    if not len(h):
        return h
    with np.errstate(over="ignore"):
        k = min(k, len(h))
        out = np.zeros(len(h) - k + 1, dtype=np.uint64)
        for i in range(k):
            out = mix64(out * np.uint64(0x9FB21C651E98DF25) + h[i : len(h) - k + 1 + i])
        return out


def binaries(column) -> list:
    """The UTF-8 bytes (or None) of each value of an Arrow string column."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def chunks(parts: list, limit: int = 1 << 18):
    """Slices of about ``limit`` bytes (one whole text at least), so that work arrays stay in the CPU's cache."""
    lo = size = 0
    for i, p in enumerate(parts):
        size += 1 + (len(p) if p else 0)
        if size >= limit:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(parts):
        yield lo, len(parts)


def joined(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """As ``encode``, of bytes."""
    parts = [p or b"" for p in parts]
    ends = np.cumsum(np.fromiter((len(p) + 1 for p in parts), dtype=np.int64, count=len(parts)))
    data = np.frombuffer(b"\n".join([*parts, b""]), dtype=np.uint8)
    return data, np.concatenate([np.zeros(1, dtype=np.int64), ends])


def code_points_before(data: np.ndarray) -> np.ndarray:
    """For each byte offset, the number of code points that start before it."""
    return np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum((data & 0xC0) != 0x80)])


def row_hashes(rows: np.ndarray) -> np.ndarray:
    """One hash of each row of uint64 values."""
    out = np.zeros(len(rows), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(rows.shape[1]):
            out = mix64(out * np.uint64(0x9FB21C651E98DF25) + rows[:, i])
    return out
