"""Operator 12: near duplicates among embeddings by an inverted multi-index.

Equal vectors of a label become one class. Both halves of the vectors, scaled to length one, have a codebook of their own, fitted on a
bounded sample; the product of the codebooks is a grid of cells. Each class asks cells in the order of their distance, the sum of both
halves' (multi-sequence traversal), until that exceeds the nearest cell's by a limit under which the target share of neighbours
lies. The limit is measured when the codebooks are fitted: on neighbours that stand exactly at the wanted cosine of sampled vectors, in random
directions, and on the pairs of the sample itself. Of two cells only the lower-numbered one's classes ask, so a pair is found once. What is
found is verified by the cosine in double precision, so no link is below the limit.

Cells with many classes are cut into blocks on both sides and each pair of blocks is a group of its own: a task holds two blocks, however
large a group of near copies is. Links stay inside tasks; what leaves them is a count for each class and a spanning forest.

Vectors that are null, zero or hold null or non-finite components, and rows without a label, link with nothing. Shorter vectors
count as if zeros followed. Rows that repeat a vec_id are vectors of their own; rows without a vec_id take no part, and stay alone. An
empty table gives no rows. Further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilune.llm.common import ready, staged
from perilune.llm.components import components
from perilune.llm.topk import matrix

_SLACK = 1e-9
_BLOCK = 256  # rows of the sample that are compared with the others at once


@dataclass(frozen=True)
class Near:
    cosine: float = 0.93
    recall: float = 0.999  # share of neighbours at the very limit that the traversal must reach
    sample: int = 8192  # classes, about, that the codebooks are fitted on
    cell: int = 512  # classes that a cell has on average, where codebooks are not at their largest
    most: int = 256  # entries of a codebook at most
    block: int = 1024
    seed: int = 5


@dataclass
class Grid:
    """Codebooks of both halves and the limit of the traversal."""

    books: tuple[np.ndarray, np.ndarray]
    limit: float
    width: int

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        """Squared distances of unit vectors' halves to the codebooks."""
        half = self.width // 2
        return [np.maximum(0, (y * y).sum(1)[:, None] - 2 * y @ c.T + (c * c).sum(1)) for y, c in ((x[:, :half], self.books[0]), (x[:, half:], self.books[1]))]

    def asked(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each vector's own cell, and the cells from it on that the traversal reaches, nearest first."""
        a, b = self.distances(x)
        own = a.argmin(1) * len(self.books[1]) + b.argmin(1)
        query, cell = traversed(a, b, self.limit)
        later = cell >= own[query]
        query, cell = query[later], cell[later]
        order = np.argsort(query, kind="stable")
        return own, np.split(cell[order], np.searchsorted(query[order], np.arange(1, len(x))))


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def traversed(a: np.ndarray, b: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Multi-sequence traversal of all queries side by side: (query, cell) in rounds, each query's cells by rising distance.

    a, b: distances to the entries of both codebooks. Both lists are sorted; for each place in the first, a pointer
    stands at the next place in the second that hasn't been visited. Each round takes each query's nearest pointer, until it is beyond the limit."""
    order_a, order_b = a.argsort(1, kind="stable"), b.argsort(1, kind="stable")
    a, b = (np.take_along_axis(x, o, 1) - x.min(1, keepdims=True) for x, o in ((a, order_a), (b, order_b)))
    b = np.concatenate([b, np.full((len(b), 1), np.inf)], axis=1)
    live = np.arange(len(a))
    pointer = np.zeros(a.shape, dtype=np.int64)
    ahead = a + b[:, :1]
    found_query, found_cell = [], []
    while len(live):
        i = ahead[live].argmin(1)
        near = ahead[live, i] <= limit
        live, i = live[near], i[near]
        j = pointer[live, i]
        found_query.append(live)
        found_cell.append(order_a[live, i] * (b.shape[1] - 1) + order_b[live, np.minimum(j, b.shape[1] - 2)])
        pointer[live, i] = j + 1
        ahead[live, i] = a[live, i] + b[live, j + 1]
    return np.concatenate([np.empty(0, dtype=np.int64), *found_query]), np.concatenate([np.empty(0, dtype=np.int64), *found_cell])


def codebook(x: np.ndarray, entries: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Lloyd's rounds from distinct rows."""
    rows = np.unique(x, axis=0)
    c = rows[rng.permutation(len(rows))[:entries]]
    for _ in range(rounds):
        at = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        n = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def fitted(vectors: np.ndarray, labels: np.ndarray, entries: int, near: Near) -> Grid:
    """Codebooks and limit from a sample of vectors with distinct values."""
    rng = np.random.default_rng(near.seed)
    if not len(vectors):
        return Grid((np.zeros((1, 0)), np.zeros((1, vectors.shape[1]))), 0.0, vectors.shape[1])
    x = unit(vectors)
    half = x.shape[1] // 2
    grid = Grid((codebook(x[:, :half], entries, rng), codebook(x[:, half:], entries, rng)), 0.0, x.shape[1])
    # Neighbours at the limit itself, in random directions: as far away as a link can be.
    base = x[rng.integers(0, len(x), 4 * near.sample)]
    other = rng.normal(size=base.shape)
    other -= (other * base).sum(1, keepdims=True) * base
    length = np.sqrt((other * other).sum(1, keepdims=True))
    other = near.cosine * base + np.sqrt(1 - near.cosine**2) * np.divide(other, length, out=np.zeros_like(other), where=length > 0)
    n = len(base)
    needed = [np.quantile(_needed(grid, np.concatenate([base, other]), np.arange(n), np.arange(n, 2 * n)), near.recall)]
    # Pairs of the sample itself, block by block: what the farthest needs.
    for label in np.unique(labels):
        y = x[labels == label]
        for k in range(0, len(y), _BLOCK):
            i, j = np.nonzero(np.triu(y[k : k + _BLOCK] @ y[k:].T >= near.cosine, 1))
            if len(i):
                needed.append(_needed(grid, y[k:], i, j).max())
    grid.limit = float(max(needed)) + _SLACK
    return grid


def _needed(grid: Grid, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How far beyond its nearest cell the lower-numbered of each pair must ask to reach the other's cell."""
    a, b = grid.distances(x)
    own = a.argmin(1) * b.shape[1] + b.argmin(1)
    away = (a - a.min(1, keepdims=True)), (b - b.min(1, keepdims=True))
    asker, cell = np.where(own[i] <= own[j], i, j), np.maximum(own[i], own[j])
    return away[0][asker, cell // b.shape[1]] + away[1][asker, cell % b.shape[1]]


def taking_part(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def classes(rows: DataFrame) -> DataFrame:
    """cls, label, v, times, least: one row for each distinct vector of a label; cls is a number of its own. Staged."""
    same = rows.groupBy("label", "v").agg(F.count("*").alias("times"), F.min("vec_id").alias("least"))
    return staged(same.withColumn("cls", F.monotonically_increasing_id()))


def grid_of(rows: DataFrame, near: Near) -> Grid:
    """Codebooks whose size follows the number of classes, on a sample by the hash of the least vec_id."""
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    entries = int(min(near.most, max(1, 2 ** round(np.log2(max(n / near.cell, 1)) / 2))))
    share = int(min(1.0, near.sample / max(n, 1)) * (1 << 40))
    sample = rows.where(F.pmod(F.xxhash64(F.lit(near.seed), "label", "least", "v"), F.lit(1 << 40)) < share).select("label", "least", "v").toArrow()
    order = np.lexsort((sample.column(1).to_numpy(), sample.column(0).to_numpy()))
    sample = sample.take(order)
    return fitted(matrix(sample.column(2).combine_chunks(), width), sample.column(0).to_numpy(), entries, near)


def assigned(rows: DataFrame, grid: Grid) -> DataFrame:
    """cls, label, v, times, own, cells: each class's cell and those that it asks. Staged; the codebooks that are sent are at most `most` entries each."""
    sent = rows.sparkSession.sparkContext.broadcast(grid)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own, cells = sent.value.asked(unit(matrix(b.column(2), sent.value.width)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own), pa.array(cells, pa.list_(pa.int64()))], names=["cls", "label", "v", "times", "own", "cells"])

    kinds = dict(rows.dtypes)
    return staged(rows.select("cls", "label", "v", "times").mapInArrow(run, f"cls long, label {kinds['label']}, v {kinds['v']}, times long, own long, cells array<long>"))


def linked(rows: DataFrame, near: Near, width: int) -> DataFrame:
    """cls, links, root: part results of `assigned` classes, links weighted by the other class's rows, root a class of the same component."""
    asks = rows.select("cls", "label", F.explode("cells").alias("cell"), "own")
    size = asks.groupBy("label", "cell").agg(F.count("*").alias("askers"), F.sum((F.col("cell") == F.col("own")).cast("long")).alias("members"))
    blocks = lambda n: F.ceil(F.col(n) / near.block).cast("long")
    size = size.where("members > 0 and askers > 1").select("label", "cell", blocks("askers").alias("na"), blocks("members").alias("nm"))
    # A class is in one block of each side and meets all blocks of the other.
    place = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "cls"), F.col(n))
    each = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    asks = rows.select("cls", "label", "v", "times", F.explode("cells").alias("cell"), "own").join(size, ["label", "cell"])
    asker = F.transform(each("nm"), lambda m: F.struct(place(1, "na").alias("a"), m.alias("m"), F.lit(True).alias("asks")))
    member = F.transform(each("na"), lambda a: F.struct(a.alias("a"), place(2, "nm").alias("m"), F.lit(False).alias("asks")))
    roles = F.when(F.col("cell") == F.col("own"), F.concat(asker, member)).otherwise(asker)
    dealt = asks.select("cls", "label", "v", "times", "cell", (F.col("cell") == F.col("own")).alias("home"), F.inline(roles))
    key = ["label", "cell", "a", "m"]
    dealt = dealt.select(*key, "asks", "home", "cls", "times", "v").repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(partial(_met, near=near, width=width), "cls long, links long, root long")


def _met(batches: Iterator[pa.RecordBatch], near: Near, width: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group; a group is one block of askers and one of members."""
    held: list[pa.RecordBatch] = []
    key = None

    def done() -> Iterator[pa.RecordBatch]:
        if held:
            cls, links, root = pair_of_blocks(pa.Table.from_batches(held).combine_chunks(), near.cosine, width)
            held.clear()
            if len(cls):
                yield pa.RecordBatch.from_pydict({"cls": cls, "links": links, "root": root})

    for b in batches:
        keys = [*zip(*(c.to_pylist() for c in b.columns[:4]), strict=True)]
        at = 0
        for k in range(1, len(keys) + 1):
            if k == len(keys) or keys[k] != keys[at]:
                if keys[at] != key:
                    yield from done()
                    key = keys[at]
                held.append(b.slice(at, k - at))
                at = k
    yield from done()


def pair_of_blocks(rows: pa.Table, cosine: float, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """cls, links, root of the classes that have links here."""
    asks, home = (rows.column(k).to_numpy() for k in (4, 5))
    cls, times = (rows.column(k).to_numpy() for k in (6, 7))
    a, m = np.flatnonzero(asks), np.flatnonzero(~asks)
    if not len(a) or not len(m):
        return cls[:0], cls[:0], cls[:0]
    x = unit(matrix(rows.column(8).combine_chunks(), width))
    product = x[a] @ x[m].T
    pair = product >= cosine - _SLACK
    # Two members of the cell meet twice: the smaller one asks.
    pair &= ~home[a][:, None] | (cls[a][:, None] < cls[m][None, :])
    i, j = np.nonzero(pair)
    edge = np.abs(product[i, j] - cosine) <= _SLACK
    if edge.any():  # so close to the limit, the sums of a single pair decide
        fine = np.array([np.dot(x[a[p]], x[m[q]]) >= cosine for p, q in zip(i[edge], j[edge], strict=True)])
        keep = np.ones(len(i), dtype=bool)
        keep[np.flatnonzero(edge)[~fine]] = False
        i, j = i[keep], j[keep]
    if not len(i):
        return cls[:0], cls[:0], cls[:0]
    nodes, at = np.unique(np.concatenate([cls[a[i]], cls[m[j]]]), return_inverse=True)
    u, v = at[: len(i)], at[len(i) :]
    links = np.bincount(u, weights=times[m[j]], minlength=len(nodes)) + np.bincount(v, weights=times[a[i]], minlength=len(nodes))
    return nodes, links.astype(np.int64), nodes[_roots(u, v, len(nodes))]


def _roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component: least neighbours, then jumps, until nothing changes."""
    root = np.arange(n)
    while True:
        least = root.copy()
        np.minimum.at(least, u, root[v])
        np.minimum.at(least, v, root[u])
        least = least[least]
        if (least == root).all():
            return root
        root = least


def near_duplicates(vectors: DataFrame, near: Near = Near()) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row; vectors: vec_id, label, embedding."""
    ready(vectors.sparkSession)
    fine = taking_part(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").alias("v"), fine.alias("fine"))
    whole = classes(rows.where("fine"))
    grid = grid_of(whole, near)
    found = staged(linked(assigned(whole, grid), near, grid.width))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    comps = components(found.where("cls <> root").select(F.col("cls").alias("lo"), F.col("root").alias("hi")))
    named = whole.join(links, "cls", "left").join(comps, whole["cls"] == comps["doc"], "left")
    named = staged(named.select("label", "v", "times", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("comp", "cls").alias("comp")))
    first = named.groupBy("comp").agg(F.min("least").alias("first"))
    named = named.join(first, "comp").select("label", "v", (F.col("links") + F.col("times") - 1).alias("n_links"), "first")
    joined = rows.where("fine").join(named, ["label", "v"]).select("vec_id", "n_links", F.col("first").alias("component_id"))
    alone = rows.where(~F.col("fine")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
