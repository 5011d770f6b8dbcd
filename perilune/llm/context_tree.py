"""Context-tree weighting over bytes, each byte a path of eight binary decisions."""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass, field

import numpy as np

DEPTH = 5
_MASK = [np.uint64((1 << (8 * d)) - 1) for d in range(DEPTH + 2)]
_CACHE_BITS = 22
_CACHE: dict = {}


def frames(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(grams, text number): for every byte of each text and its end (byte 0), the DEPTH bytes before it and the byte itself, the oldest first; zeros precede a text."""
    data = np.frombuffer(b"".join(bytes(DEPTH) + t + b"\0" for t in texts), dtype=np.uint8)
    lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    ends = np.cumsum(lengths + DEPTH)
    gram = np.zeros(len(data), dtype=np.uint64)
    for k in range(DEPTH, -1, -1):
        gram[k:] |= data[: len(data) - k].astype(np.uint64) << np.uint64(8 * k)
    owner = np.repeat(np.arange(len(texts)), lengths)
    starts = ends - lengths
    at = np.arange(int(lengths.sum())) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return gram[at], owner


def ln_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series seven steps further on."""
    back = np.zeros_like(x)
    for k in range(7):
        back += np.log(x + k)
    z = x + 7
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - back


def chance(p: np.ndarray) -> np.ndarray:
    """As float32, below 1: else a bit that was the same in some 2^24 places would leave the other one no chance at all."""
    return np.minimum(p.astype(np.float32), np.float32(1 - 2**-24))


def ln_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return ln_gamma(zeros + 0.5) + ln_gamma(ones + 0.5) - ln_gamma(zeros + ones + 1.0) - np.log(np.pi)


@dataclass
class Level:
    """Nodes of one context length: key = context << 8 | the byte's bits so far behind a 1."""

    key: np.ndarray
    one: np.ndarray  # KT's chance of a 1
    stop: np.ndarray  # weight of stopping here
    other: np.ndarray  # chance of a 1 in contexts that go on to one not in the tree

    def __getstate__(self):
        """Sent as steps between keys and planes of bytes, compressed."""
        steps = np.diff(self.key, prepend=np.uint64(0))
        planes = [np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T) for x in (steps, self.one, self.stop, self.other)]
        return {"n": len(self.key), "planes": [zlib.compress(x.tobytes(), 1) for x in planes]}

    def __setstate__(self, state):
        kinds = (np.uint64, np.float32, np.float32, np.float32)
        parts = [np.frombuffer(zlib.decompress(x), dtype=np.uint8).reshape(np.dtype(k).itemsize, state["n"]).T.copy().view(k).ravel() for x, k in zip(state["planes"], kinds, strict=True)]
        self.key, self.one, self.stop, self.other = np.cumsum(parts[0], dtype=np.uint64), *parts[1:]


@dataclass
class Tree:
    levels: list[Level]
    token: str = field(default_factory=lambda: uuid.uuid4().hex)  # tells whose scores the worker's table holds

    def ln_probability(self, grams: np.ndarray) -> np.ndarray:
        """Of each gram's last byte after the bytes before it: weights mix the estimates of all depths, from the deepest context back to the root."""
        total = np.zeros(len(grams))
        for bit in range(8):
            node = (np.uint64(1) << np.uint64(bit)) | ((grams & np.uint64(255)) >> np.uint64(8 - bit))
            is_one = (grams >> np.uint64(7 - bit)) & np.uint64(1) == 1
            places, rows = [], np.arange(len(grams))
            for d, level in enumerate(self.levels):
                want = ((grams[rows] >> np.uint64(8)) & _MASK[d]) << np.uint64(8) | node[rows]
                at = np.minimum(np.searchsorted(level.key, want), max(len(level.key) - 1, 0))
                hit = level.key[at] == want if len(level.key) else np.zeros(len(want), dtype=bool)
                rows, at = rows[hit], at[hit]  # a context is in the tree only if its shorter ones are
                places.append((rows, at))
            p = np.full(len(grams), np.nan)
            for level, (rows, at) in zip(self.levels[::-1], places[::-1], strict=True):
                below = np.where(np.isnan(p[rows]), level.other[at], p[rows])
                p[rows] = level.stop[at] * level.one[at] + (1 - level.stop[at]) * below
            p[np.isnan(p)] = 0.5
            total += np.log(np.where(is_one, p, 1 - p))
        return total

    def cached(self, grams: np.ndarray) -> np.ndarray:
        """The same through a table of grams seen lately, of fixed size, one for each worker."""
        if _CACHE.get("token") != self.token:
            _CACHE.clear()
            _CACHE.update(token=self.token, keys=np.full(1 << _CACHE_BITS, (1 << 64) - 1, dtype=np.uint64), values=np.zeros(1 << _CACHE_BITS, dtype=np.float32))
        keys, values = _CACHE["keys"], _CACHE["values"]
        slot = ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _CACHE_BITS)).astype(np.int64)
        missing = np.flatnonzero(keys[slot] != grams)
        out = values[slot].astype(np.float64)
        if len(missing):
            new, back = np.unique(grams[missing], return_inverse=True)
            value = self.ln_probability(new).astype(np.float32).astype(np.float64)  # as the table holds it, so that scores don't depend on what was seen before
            out[missing] = value[back]
            slot = ((new * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _CACHE_BITS)).astype(np.int64)
            keys[slot], values[slot] = new, value
        return out


def grow(counts: list[tuple[np.ndarray, np.ndarray]]) -> Tree:
    """counts[d]: grams of d bytes of context and the byte, and how often each occurs. A gram's shorter ones must be there too."""
    return Tree(grow_levels(counts)[0])


def grow_levels(counts: list[tuple[np.ndarray, np.ndarray]], first: int = 0, under: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[list[Level], tuple]:
    """Levels from `first` bytes of context on, and (key, zeros, ones, ln weighted) of the shortest one's nodes.

    under: (key, n) of the deepest level's nodes, n the summed ln weighted of their longer contexts; without it they have none.
    """
    stats = []
    for grams, n in counts:
        keys, bits, weights = [], [], []
        for bit in range(8):
            keys.append(((grams >> np.uint64(8)) << np.uint64(8)) | (np.uint64(1) << np.uint64(bit)) | ((grams & np.uint64(255)) >> np.uint64(8 - bit)))
            bits.append((grams >> np.uint64(7 - bit)) & np.uint64(1) == 1)
            weights.append(n.astype(np.float64))
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        one, weight = np.concatenate(bits), np.concatenate(weights)
        stats.append((key, np.bincount(back, weights=weight * ~one, minlength=len(key)), np.bincount(back, weights=weight * one, minlength=len(key))))
    levels: list[Level] = []
    below: tuple | None = None
    for d in range(len(stats) - 1, -1, -1):
        key, zeros, ones = stats[d]
        own = ln_kt(zeros, ones)
        if below is None and under is None:
            weighted, stop, other = own, np.ones(len(key)), np.full(len(key), 0.5)
        else:
            if below is None:
                split, other = np.bincount(np.searchsorted(key, under[0]), weights=under[1], minlength=len(key)), np.full(len(key), 0.5)
            else:
                child, c0, c1, inner = below
                parent = np.searchsorted(key, shorter(child, first + d))
                add = lambda x, parent=parent, key=key: np.bincount(parent, weights=x, minlength=len(key))
                r0, r1 = zeros - add(c0), ones - add(c1)
                split = add(inner) + ln_kt(r0, r1)  # what goes on to contexts outside the tree is one more leaf
                other = (r1 + 0.5) / (r0 + r1 + 1)
            weighted = np.logaddexp(own, split) - np.log(2)
            stop = np.exp(own - np.log(2) - weighted)
        levels.append(Level(key, chance((ones + 0.5) / (zeros + ones + 1)), stop.astype(np.float32), chance(other)))
        below = (key, zeros, ones, weighted)
    return levels[::-1], below


def shorter(node: np.ndarray, d: int) -> np.ndarray:
    """The same nodes behind only the last d bytes of their contexts."""
    return (((node >> np.uint64(8)) & _MASK[d]) << np.uint64(8)) | (node & np.uint64(255))
