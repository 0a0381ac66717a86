"""Vectorised text helpers for tasks: words, hashes and bytes of many documents at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Documents are worked on in slices of about so many bytes, so that working arrays stay in cache; a longer one is a slice of its own.
SLICE_BYTES = 1 << 20

_U = np.uint64
_rng = np.random.RandomState(20240229)
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE_CODE = _rng.randint(1, 1 << 62, 256).astype(_U) * _U(2) + _U(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Word bytes of the contracts: all but ASCII white space, or digits, letters and everything beyond ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[48:58] = ALPHANUMERIC[65:91] = ALPHANUMERIC[97:123] = ALPHANUMERIC[128:] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, as long as asked for."""

    def __init__(self, base: int = _BASE) -> None:
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, SLICE_BYTES + 1024)
            self.up, self.down = self._row(self.base), self._row(self.inverse)
        return self.up[:n], self.down[:n]

    def _row(self, base: int) -> np.ndarray:
        out = np.full(self.n, base, _U)
        out[0] = 1
        return np.multiply.accumulate(out)


_POWERS = Powers()


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, bytes, offsets) of runs of documents. A null text is empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first, n = 0, len(texts)
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1)
        last = min(last, n)
        yield first, last, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each document's first word (one more at the end)."""
    flag = is_word[data]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    before = np.zeros(len(data), bool)
    before[1:] = flag[:-1]
    before[edge] = False
    starts = np.flatnonzero(flag & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = flag[1:]
    after[edge[edge > 0] - 1] = False
    ends = np.flatnonzero(flag & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_hash(data: np.ndarray, codes: np.ndarray = _BYTE_CODE, powers: Powers = _POWERS) -> np.ndarray:
    """Running polynomial; span_hash cuts any span out of it."""
    up, _ = powers.upto(len(data))
    out = np.zeros(len(data) + 1, _U)
    np.cumsum(codes[data] * up, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers = _POWERS) -> np.ndarray:
    """64-bit hashes of data[start:end]; equal spans have equal hashes wherever they stand."""
    _, down = powers.upto(len(prefix))
    return mixed((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(_U))


_SALTS = (_rng.randint(1, 1 << 62, 64).astype(_U) * _U(2) + _U(1))


def window_hash(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words; entry i covers words i to i + k - 1."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = word_hashes[:n] * _SALTS[0]
    for j in range(1, k):
        out = out + word_hashes[j : j + n] * _SALTS[j]
    return mixed(out)


def window_hash_rows(rows: np.ndarray) -> np.ndarray:
    """window_hash of each row of word hashes, as one window."""
    out = rows[:, 0] * _SALTS[0]
    for j in range(1, rows.shape[1]):
        out = out + rows[:, j] * _SALTS[j]
    return mixed(out)


def row_of(firsts: np.ndarray) -> np.ndarray:
    """Document index of every word, from words()'s third result."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))


def sequence_digest(word_hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """(documents, 2) 64-bit digests of the word sequences."""
    out = []
    n = len(word_hashes)
    up, down = _POWERS.upto(n + 1)
    for salt in (_SALTS[40], _SALTS[41]):
        run = np.zeros(n + 1, _U)
        np.cumsum(mixed(word_hashes ^ salt) * up[:n], out=run[1:])
        out.append(mixed((run[firsts[1:]] - run[firsts[:-1]]) * down[firsts[:-1]] + np.diff(firsts).astype(_U)))
    return np.stack(out, axis=1)


def as_lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
