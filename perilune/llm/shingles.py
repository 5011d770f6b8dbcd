"""Sets of word shingles as sorted 64-bit hashes, vectorised over a batch of texts."""

from __future__ import annotations

import numpy as np
import xxhash

from perilune.llm.common import _LOWER, utf8

WIDTH = 5
#: Texts are hashed in stretches of about so many bytes.
_STRETCH = 1 << 18
#: Words of more bytes have a hash that isn't a sum.
_LONG = 64
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_GAP = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUE = scramble(np.arange(1, 257, dtype=np.uint64))
_VALUE[65:91] = _VALUE[97:123]  # A-Z count as a-z
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64 and of its inverse."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            step = np.full(n, base, dtype=np.uint64)
            step[0] = 1
            _POWERS[k] = np.multiply.accumulate(step)
    return _POWERS[0][:n], _POWERS[1][:n]


def _stretch_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word: differences of running sums of value * base^place, brought to place 0."""
    a = np.frombuffer(data, dtype=np.uint8)
    edges = np.flatnonzero(np.diff(_GAP[a].astype(np.int8), prepend=1, append=1))
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers(len(a) + 1)
    total = np.zeros(len(a) + 1, dtype=np.uint64)
    np.cumsum(_VALUE[a] * up[:-1], out=total[1:])
    out = scramble((total[ends] - total[starts]) * down[starts])
    # Sums modulo 2^64 can be made to agree for long words that are built for it.
    for k in np.flatnonzero(ends - starts > _LONG):
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].translate(_LOWER))
    return out, starts


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The same for data of any length: cut into stretches at white space, so memory follows the stretch or the longest word."""
    if len(data) <= 2 * _STRETCH:
        return _stretch_hashes(data)
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = min(at + _STRETCH, len(data))
        while end < len(data) and not _GAP[data[end]]:
            end += 1
        h, s = _stretch_hashes(data[at:end])
        hashes.append(h)
        starts.append(s + at)
        at = end
    return np.concatenate(hashes), np.concatenate(starts)


def _sets(texts: list[bytes]) -> list[np.ndarray]:
    data = b" ".join(texts)
    h, starts = word_hashes(data)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    cuts = np.searchsorted(starts, begins)
    n = len(h)
    whole = np.zeros(0, dtype=np.uint64)
    if n >= WIDTH:
        total = h[: n - WIDTH + 1] * _FACTORS[0]
        for k in range(1, WIDTH):
            total += h[k : n - WIDTH + 1 + k] * _FACTORS[k]
        whole = scramble(total)
    out = []
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        m = j - i
        if m >= WIDTH:
            x = np.sort(whole[i : j - WIDTH + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif m:
            out.append(scramble(np.array([np.sum(h[i:j] * _FACTORS[:m], dtype=np.uint64) + np.uint64(m)], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def shingle_sets(texts: list) -> list[np.ndarray]:
    """For each text its distinct shingles of WIDTH words, A-Z lowered, sorted; with fewer words the whole sequence is one; none without words."""
    out: list[np.ndarray] = []
    held: list[bytes] = []
    size = 0
    for t in texts:
        held.append(utf8(t))
        size += len(held[-1])
        if size > _STRETCH:
            out += _sets(held)
            held, size = [], 0
    return out + (_sets(held) if held else [])


def shingle_set(text: str | None) -> np.ndarray:
    return shingle_sets([text])[0]
