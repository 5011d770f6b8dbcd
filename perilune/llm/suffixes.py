"""Suffix arrays over words, for many texts at once, by prefix doubling in numpy, and their intervals of common prefixes."""

from __future__ import annotations

import numpy as np


def suffix_array(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sa, lcp): positions in the order of their suffixes, and how many words each shares with the one before it (0 for the first).

    words: ids; doc: ascending text number of each word. Suffixes end with their text and are told by it, so those of different
    texts share nothing and one sort serves many texts. Only suffixes that still tie are sorted again; ranks of each level
    give the common prefix lengths of neighbours.
    """
    n = len(words)
    lcp = np.zeros(n, dtype=np.int64)
    if n == 0:
        return lcp, lcp
    key = doc.astype(np.int64) * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    sizes = np.diff(np.append(first, n))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.repeat(first, sizes)
    levels = [rank.astype(np.int32)]
    sa = order.copy()
    slots = np.flatnonzero(np.repeat(sizes > 1, sizes))  # places in the suffix array that still tie
    h = 1
    while len(slots):
        at = sa[slots]
        nxt = at + h
        inside = nxt < n
        nxt[~inside] = 0
        second = np.where(inside & (doc[nxt] == doc[at]), rank[nxt], -1)
        key = rank[at] * (n + 1) + second + 1
        turn = np.argsort(key, kind="stable")
        at, key = at[turn], key[turn]
        sa[slots] = at
        begins = np.concatenate([[True], key[1:] != key[:-1]])
        heads = np.flatnonzero(begins)
        sizes = np.diff(np.append(heads, len(slots)))
        rank[at] = np.repeat(slots[heads], sizes)
        levels.append(rank.astype(np.int32))
        slots = slots[np.repeat(sizes > 1, sizes)]
        h *= 2
    a, b = sa[:-1], sa[1:]
    near = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[near], b[near]
    common = np.zeros(len(near), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        inside = (x < n) & (y < n)
        x[~inside] = 0
        y[~inside] = 0
        common += np.where(inside & (levels[k][x] == levels[k][y]), 1 << k, 0)
    lcp[near + 1] = common
    return sa, lcp


def repeat_lengths(sa: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each position the length of the longest run of words that starts there and occurs again in the same text: a suffix's deepest interval has the larger one of its two neighbours' common prefixes."""
    longest = np.zeros(len(sa), dtype=np.int64)
    longest[sa] = np.maximum(lcp, np.append(lcp[1:], 0)) if len(sa) else lcp
    return longest


def maximal_repeats(sa: np.ndarray, lcp: np.ndarray, words: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """For each position the length of the longest maximal repeat of at least `least` words that starts there, else 0.

    An interval of suffixes that share l words, more than any wider one does, is a repeat that can't be longer to the right; it is
    maximal if the words before its places differ too (a text's begin differs from all). Intervals are found by one walk with a stack over
    the stretches of the suffix array with l >= least. A place whose deepest interval isn't maximal adds nothing to the
    union of spans: the word before it starts a repeat that is longer by one and covers it.
    """
    out = np.zeros(len(sa), dtype=np.int64)
    deep = lcp >= least
    heads, tails = np.flatnonzero(deep & ~np.append(False, deep[:-1])), np.flatnonzero(deep & ~np.append(deep[1:], False))
    if not len(heads):
        return out
    before = np.where(np.append(True, doc[1:] != doc[:-1]), -1, np.append(-1, words[:-1]))
    for head, tail in zip(heads.tolist(), tails.tolist(), strict=True):
        place = sa[head - 1 : tail + 1]
        length, maximal, own = _intervals(lcp[head : tail + 1].tolist(), before[place].tolist())
        own = np.array(own)
        out[place] = np.where(np.array(maximal)[own], np.array(length)[own], 0)
    return out


def _same(x: int | None, y: int | None) -> int | None:
    """The word before all places of two parts; None if it isn't one word."""
    return x if x == y and x != -1 else None


def _intervals(common: list[int], before: list[int]) -> tuple[list[int], list[bool], list[int]]:
    """(length and maximality of each interval of a stretch, the deepest interval of each of its suffixes)."""
    length: list[int] = []
    maximal: list[bool] = []
    own: list[int] = []
    stack: list[list] = []  # length, number, the word before all its places so far

    def begin(l: int, word: int | None) -> None:
        stack.append([l, len(length), word])
        length.append(l)
        maximal.append(False)

    last = 0
    for l, word in zip([*common, 0], before, strict=True):
        if l > last:
            begin(l, word)
            own.append(stack[-1][1])
        else:
            own.append(stack[-1][1])
            stack[-1][2] = _same(stack[-1][2], word)
            while stack and stack[-1][0] > l:
                _, number, held = stack.pop()
                maximal[number] = held is None
                if stack and stack[-1][0] >= l:
                    stack[-1][2] = _same(stack[-1][2], held)
                elif l:
                    begin(l, held)
        last = l
    return length, maximal, own


def covered(longest: np.ndarray, least: int, width: int | None = None) -> np.ndarray:
    """Which words lie in the union of the repeats of at least `least` words; width: take so many words of each only."""
    at = np.arange(len(longest))
    reach = np.where(longest >= least, at + (longest if width is None else width), 0)
    return np.maximum.accumulate(reach) > at if len(at) else np.zeros(0, dtype=bool)
