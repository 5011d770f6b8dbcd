"""Operator 7: quality classifier, histogram gradient-boosted trees over document statistics.

Statistics come from a text's bytes, words and lines alone. Trees are grown on histograms of binned statistics, flattened into
arrays (feature, threshold, leaf value; a node's children lie at 2i+1 and 2i+2), and walked for all rows and trees at once.
At most `max_rows` labelled documents (of those that are there, the ones with the smallest hashes of their ids) are learnt
from: that bounds what the driver gathers. Every document is scored by its whole text, however long.

Null and empty texts have statistics of 0 and are scored like any other. Labels other than 0 and 1 and those of unknown documents
are ignored, labels that repeat count once, and documents with both labels aren't learnt from. Of rows that repeat a doc_id
one is learnt from (the smallest by its statistics) and each is scored. A null doc_id counts as the empty text: held out. Without
labels of both kinds every score is the share of label 1 (0.5 without any). Columns but doc_id and text play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilune.llm.common import map_texts, ready, staged, trim, utf8

_BYTES = np.arange(256)


def _mask(chars: bytes) -> np.ndarray:
    return np.isin(_BYTES, list(chars)).astype(np.float64)


#: Shares of a text's bytes.
_SHARES = np.column_stack([
    _mask(bytes(range(65, 91))), _mask(bytes(range(97, 123))), _mask(b"0123456789"), _mask(b"#*$%&<>"), _mask(b"|"), _mask(b"!?"), _mask(b".,;:"), _mask(b"\"'()[]{}"),
    _mask(b"=+/\\_@^~`-"), _mask(b" \t\r\x0b\x0c"), _mask(b"\n"), _mask(bytes(range(128, 256))),
])
FEATURES = 12 + 15


def statistics(texts: list) -> np.ndarray:
    out = np.zeros((len(texts), FEATURES))
    for i, text in enumerate(texts):
        data = utf8(text)
        words = data.split()
        if not words:
            continue
        n, counts = len(data), np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
        out[i, :12] = counts @ _SHARES / n
        share = counts[counts > 0] / n
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        m, distinct = len(words), set(words)
        lines = [x for x in data.split(b"\n") if x.strip()]
        pairs = set(zip(words, words[1:], strict=False))
        joined = b"\n" + b"\n".join(words) + b"\n"
        heads = np.frombuffer(joined, dtype=np.uint8)
        gaps = np.flatnonzero(heads == 10)
        first, last = heads[gaps[:-1] + 1], heads[gaps[1:] - 1]
        out[i, 12:] = (
            np.log1p(m), lengths.mean(), lengths.std(), lengths.max(), len(distinct) / m, len(pairs) / m, sum(map(len, distinct)) / lengths.sum(),
            np.log1p(m / len(lines)), len(set(lines)) / len(lines), -(share @ np.log2(share)),
            ((first >= 65) & (first <= 90)).mean(), np.isin(last, list(b".,;:")).mean(), np.isin(last, list(b"!?#*$%&|<>")).mean(), (lengths <= 3).mean(), (lengths == 1).mean(),
        )
    return out


@dataclass(frozen=True)
class Settings:
    max_rows: int = 20_000
    trees: int = 60
    depth: int = 4
    bins: int = 64
    rate: float = 0.15
    smooth: float = 1.0
    least_rows: float = 5.0


@dataclass
class Trees:
    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if self.feature.size:
            rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
            at = np.zeros((len(x), len(self.feature)), dtype=np.int64)
            inner = self.feature.shape[1]
            while at[0, 0] < inner if len(x) else False:
                at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.threshold[trees, at])
            total = total + self.leaf[trees, at - inner].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, s: Settings = Settings()) -> Trees:
    """Second-order boosting of the logistic loss, level by level."""
    share = y.mean() if len(y) else 0.5
    base = float(np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3))))
    none = np.zeros((0, 2**s.depth - 1))
    if len(y) == 0 or share in (0.0, 1.0):
        return Trees(base, none.astype(np.int64), none, np.zeros((0, 2**s.depth)))
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.arange(1, s.bins) / s.bins)) for j in range(width)]
    binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])  # bin b: cuts[b-1] < x <= cuts[b]
    slot = binned + np.arange(width) * s.bins
    margin = np.full(n, base)
    features, thresholds, leaves = [], [], []
    for _ in range(s.trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, dtype=np.int64)
        feature, threshold = np.zeros(2**s.depth - 1, dtype=np.int64), np.full(2**s.depth - 1, np.inf)
        for level in range(s.depth):
            nodes = 2**level
            key = (at[:, None] * (width * s.bins) + slot).ravel()
            hist = lambda w, key=key, nodes=nodes: np.bincount(key, weights=np.repeat(w, width), minlength=nodes * width * s.bins).reshape(nodes, width, s.bins).cumsum(axis=2)
            gl, hl, cl = hist(g), hist(h), hist(np.ones(n))
            gt, ht, ct = gl[:, :, -1:], hl[:, :, -1:], cl[:, :, -1:]
            gain = gl**2 / (hl + s.smooth) + (gt - gl) ** 2 / (ht - hl + s.smooth) - gt**2 / (ht + s.smooth)
            gain[(cl < s.least_rows) | (ct - cl < s.least_rows)] = -np.inf
            best = gain.reshape(nodes, -1).argmax(axis=1)
            good = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-9
            j, b = best // s.bins, best % s.bins
            for k in np.flatnonzero(good):
                feature[nodes - 1 + k], threshold[nodes - 1 + k] = j[k], cuts[j[k]][min(b[k], len(cuts[j[k]]) - 1)]
            here = nodes - 1 + at
            at = 2 * at + (x[np.arange(n), feature[here]] > threshold[here])
        gs, hs = np.bincount(at, weights=g, minlength=2**s.depth), np.bincount(at, weights=h, minlength=2**s.depth)
        value = -s.rate * gs / (hs + s.smooth)
        margin = margin + value[at]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(value)
    return Trees(base, np.array(features), np.array(thresholds), np.array(leaves))


def _features(ids: list, texts: list) -> dict:
    return {"doc_id": pa.array(ids, pa.int64()), "x": pa.array(list(statistics(texts)), pa.list_(pa.float64()))}


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Trees:
    """Learns from labelled documents whose crc32(doc_id as text) mod 5 is not 0; the labelled ids are bounded, so they may be broadcast."""
    learnt = labels.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0) & F.col("quality").isin(0, 1))
    learnt = learnt.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most")
    learnt = learnt.join(docs.select("doc_id"), "doc_id", "left_semi").select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.max_rows)
    learnt = staged(learnt)
    rows = map_texts(docs.select("doc_id", "text").join(F.broadcast(learnt.select("doc_id")), "doc_id", "left_semi"), _features, "doc_id long, x array<double>")
    found = rows.groupBy("doc_id").agg(F.min("x").alias("x")).join(F.broadcast(learnt), "doc_id").toPandas()
    if found.empty:
        return fit(np.zeros((0, FEATURES)), np.zeros(0), s)
    found = found.sort_values("doc_id")  # reruns see the same order
    return fit(np.stack(found["x"].to_numpy()), found["quality"].to_numpy(dtype=np.float64), s)


def score_quality(docs: DataFrame, trees: Trees, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def run(ids: list, texts: list, trees: Trees) -> dict:
        score = trees.score(statistics(texts))
        held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0 for i in ids]
        return {"doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(held, pa.bool_()), "score": pa.array(score), "predicted": pa.array((score >= threshold).astype(np.int32))}

    return map_texts(docs, partial(run, trees=trees), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, trees: Trees, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all columns, that aren't rejected."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(trees.score(statistics(b.column(b.schema.get_field_index("text")).to_pylist())) >= threshold))
        trim()

    return docs.mapInArrow(run, docs.schema)
