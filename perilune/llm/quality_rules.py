"""Operator 2: quality rules with suffix-array repetition.

Per text: base counts (characters in words, symbols, lines seen before, words in repeated 3-word windows), and from the intervals of
common prefixes of a suffix array over its words the maximal repeats of at least `min_repeat` words: the union of their spans
and the longest of them. A text is kept if it has `min_words` words, at most half of them in repeated 3-word windows, at most
`max_covered` of them in maximal repeats, and no repeat longer than `max_longest` of it. `many_symbols` tells of more than `max_symbols` symbols for each word, and decides nothing.
A line that is said twice is no fault of a short text: repeats of up to `short_longest` words that cover up to `short_covered` pass.

Texts are measured in groups of about `_GROUP` words, so memory follows the longest text, not the batch; whole texts count, however long.
Equal repeats of equal length all count. Null and empty texts have no words and fail. Repeated rows give repeated results; other
columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from perilune.llm.common import map_texts, utf8
from perilune.llm.suffixes import covered, maximal_repeats, repeat_lengths, suffix_array

# White space that parts words, and symbols.
_SPACE = bytes([0x20, *range(0x09, 0x0E)])
_SYMBOLS = b"#*$%&|<>"


_GROUP = 1 << 18


@dataclass(frozen=True)
class Limits:
    min_words: int = 50
    max_repeat_words: float = 0.5
    min_repeat: int = 8
    max_covered: float = 0.3
    max_longest: float = 0.2
    short_covered: int = 50
    short_longest: int = 25
    max_symbols: float = 0.25


COLUMNS = {
    "doc_id": pa.int64(), "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(),
    "base_failed": pa.bool_(), "kept": pa.bool_(), "n_covered_words": pa.int64(), "longest_repeat": pa.int64(), "many_symbols": pa.bool_(),
}
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_covered_words long, longest_repeat long, many_symbols boolean"


def measure(texts: list, limits: Limits = Limits()) -> dict[str, np.ndarray]:
    """Each column as one array, a value a text."""
    groups: list[list] = []
    size = _GROUP + 1
    for text in texts:
        n = len(text or "") // 6
        if size + n > _GROUP:
            groups.append([])
            size = 0
        groups[-1].append(text)
        size += n
    found = [_measure(g, limits) for g in groups or [[]]]
    return {k: np.concatenate([f[k] for f in found]) for k in found[0]}


def _measure(texts: list, limits: Limits) -> dict[str, np.ndarray]:
    known: dict[bytes, int] = {}
    number = known.setdefault
    ids, n_words, chars, symbols, dup_lines = [], [], [], [], []
    for text in texts:
        data = utf8(text)
        words = data.split()
        n_words.append(len(words))
        ids.append(np.fromiter((number(w, len(known)) for w in words), dtype=np.int64, count=len(words)))
        bare = data.translate(None, _SPACE)
        chars.append(len(bare) if bare.isascii() else len(bare.decode("utf-8", "replace")))
        symbols.append(len(data) - len(data.translate(None, _SYMBOLS)))
        lines = data.split(b"\n")
        distinct = set(lines)
        dup_lines.append(sum(1 for x in lines if x.split()) - sum(1 for x in distinct if x.split()) if len(distinct) < len(lines) else 0)
    n_words = np.array(n_words, dtype=np.int64)
    words = np.concatenate([np.zeros(0, dtype=np.int64), *ids])
    doc = np.repeat(np.arange(len(texts)), n_words)
    sa, lcp = suffix_array(words, doc)
    total = lambda x: np.bincount(doc, weights=x, minlength=len(texts)).astype(np.int64)
    repeat_words = total(covered(repeat_lengths(sa, lcp), 3, 3))
    repeats = maximal_repeats(sa, lcp, words, doc, limits.min_repeat)
    cover = total(covered(repeats, limits.min_repeat))
    most = np.zeros(len(texts), dtype=np.int64)
    np.maximum.at(most, doc, repeats)
    symbols = np.array(symbols, dtype=np.int64)
    failed = (n_words < limits.min_words) | (repeat_words > limits.max_repeat_words * n_words)
    kept = ~failed & (cover <= np.maximum(limits.max_covered * n_words, limits.short_covered)) & (most <= np.maximum(limits.max_longest * n_words, limits.short_longest))
    return {
        "n_words": n_words, "word_chars": np.array(chars, dtype=np.int64), "n_symbols": symbols, "n_dup_lines": np.array(dup_lines, dtype=np.int64), "n_repeat_words": repeat_words,
        "base_failed": failed, "kept": kept, "n_covered_words": cover, "longest_repeat": most, "many_symbols": symbols > limits.max_symbols * n_words,
    }


def quality_rules(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    def run(ids: list, texts: list, limits: Limits) -> dict:
        out = {"doc_id": ids, **measure(texts, limits)}
        return {k: pa.array(out[k], kind) for k, kind in COLUMNS.items()}

    return map_texts(df, partial(run, limits=limits), SCHEMA)
