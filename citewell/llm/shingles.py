"""Word shingles of whole texts as 64-bit hashes, for many texts at once (numpy, no loop over words)."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True

_draw = np.random.RandomState(97)
#: A random number for each byte; upper-case A-Z have those of a-z.
_BYTE = _draw.randint(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], A-Z taken as a-z; equal bytes have equal hashes wherever they stand."""
    up, down = _power_tables(len(data) + 1)
    total = np.r_[_U(0), np.cumsum(_BYTE[data] * up[: len(data)])]
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)) | _U(1)


def shingle_hashes(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles (with repeats) of all texts, and where each text's begin (one more number than texts).

    A text with fewer words than a shingle has, but at least one, gives the whole sequence as one shingle.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    lengths = np.array([len(r) for r in raw], np.int64)
    begins = np.r_[0, np.cumsum(lengths + 1)]
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    space = _SPACES[data]
    inside = ~space
    starts = np.flatnonzero(inside & np.r_[True, space[:-1]])
    ends = np.flatnonzero(inside & np.r_[space[1:], True]) + 1
    hashes = span_hashes(data, starts, ends)
    first_word = np.searchsorted(starts, begins)  # of each text, and the end
    count = np.diff(first_word)
    shingles = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    at = np.r_[0, np.cumsum(shingles)]
    owner = np.repeat(np.arange(len(texts)), shingles)
    position = first_word[owner] + np.arange(at[-1]) - at[owner]
    size = np.minimum(count, words)[owner]
    out = size.astype(np.uint64)
    for j in range(words):
        here = j < size
        word = hashes[np.minimum(position + j, max(len(hashes) - 1, 0))] if len(hashes) else np.zeros(0, np.uint64)
        out = np.where(here, mix64(out * _U(0xD6E8FEB86659FD93) + word), out)
    return out, at


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    hashes, at = shingle_hashes(texts, words)
    out = []
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        own = np.sort(hashes[lo:hi])
        if len(own) > 1:
            own = own[np.r_[True, own[1:] != own[:-1]]]
        out.append(own)
    return out
