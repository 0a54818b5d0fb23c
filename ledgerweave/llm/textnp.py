"""Vectorised text primitives over Arrow string buffers.

Every function works on whole slices of UTF-8 bytes with numpy, so that no Python code runs
per character or per word. Slices are bounded in bytes (a longer text forms a slice of its
own), which bounds the memory of a worker whatever the lengths of the texts.

Word: a maximal run of ASCII letters, ASCII digits and non-ASCII bytes, in lower case (ASCII
and the Latin-1 letters). Hashes are polynomial over 64 bits with wrap-around, mixed at the end.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_RNG = np.random.default_rng(0x5EED)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = np.uint64(0x9E3779B97F4A7C15)
_RINV = np.uint64(pow(int(_R), -1, 2**64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
SPACE = np.zeros(256, bool)
SPACE[[9, 11, 12, 13, 32]] = True

_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """R**0 .. R**(n-1) modulo 2**64, kept between calls."""
    key = "i" if inverse else "p"
    have = _powers.get(key)
    if have is None or len(have) < n:
        base = np.full(max(n, SLICE_BYTES * 5 // 4), _RINV if inverse else _R, dtype=np.uint64)
        base[0] = 1
        have = np.cumprod(base, dtype=np.uint64)
        if n <= SLICE_BYTES * 2:
            _powers[key] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array, and its n + 1 offsets into them; a null is an empty text."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not (pa.types.is_large_string(arr.type) or pa.types.is_string(arr.type)):
        arr = arr.cast(pa.string())
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type)
    _, off, data = arr.buffers()
    n = len(arr)
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, offs - offs[0]


def slices(arr: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, offsets) for runs of rows of about `most` bytes, or one longer row."""
    data, offs = buffers(arr)
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j
    give_back()


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns freed memory to the system: workers live long, and what they once used would stay theirs."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def lowered(data: np.ndarray) -> np.ndarray:
    low = LOWER[data]
    if len(data) > 1:
        second = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[1:][second] |= 0x20
    return low


def runs(flags: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of set flags; a run never goes past the end of its text."""
    edge = np.zeros(len(flags) + 1, np.int8)
    edge[:-1] += flags
    edge[1:] -= flags
    inner = offs[1:-1]
    inner = inner[(inner > 0) & (inner < len(flags))]
    cut = inner[flags[inner] & flags[inner - 1]]
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(cut):
        cut = np.unique(cut)
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    return start, end


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, which doesn't depend on where the span stands."""
    n = len(data)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(n), out=prefix[1:], dtype=np.uint64)
    return mix((prefix[end] - prefix[start]) * powers(n + 1, inverse=True)[start])


def words(data: np.ndarray, offs: np.ndarray, low: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, start byte, end byte) of every word."""
    low = lowered(data) if low is None else low
    start, end = runs(WORD[data], offs)
    return span_hashes(low, start, end), np.searchsorted(offs, start, "right") - 1, start, end


def sequence_prefix(h: np.ndarray) -> np.ndarray:
    """prefix such that (prefix[b] - prefix[a]) * Rinv**a identifies the items a..b-1 in order."""
    out = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(len(h)), out=out[1:], dtype=np.uint64)
    return out


def sequence_hash(prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Unmixed hash of the items a..b-1; equal sequences have equal hashes wherever they stand."""
    return (prefix[b] - prefix[a]) * powers(len(prefix), inverse=True)[a]
