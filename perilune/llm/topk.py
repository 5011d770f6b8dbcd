"""Operator 10: exact top-k search by inner product with multi-resolution segment statistics.

Vectors are cut into segments; from the segments' means and deviations the inner product of two vectors is at most
sum of width * (mean * mean + deviation * deviation), which is the lower bound of their distance seen from the other side. The
bound is taken coarse to fine, against the k-th best score so far, and exact integer products are computed for the pairs
that survive every level. Queries go to the tasks in blocks of bounded size, one after the other; each task keeps k candidates a query.

Vectors that are null or hold null or non-finite components take no part; a shorter vector counts as if zeros followed. Ties go to the
smaller vec_id. Rows with the query's own vec_id are no candidates; queries that repeat a vec_id are asked once, with the smallest of
its vectors, while repeated candidates each count. Null vec_ids take no part. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perilune.llm.common import ready, shared_dir, staged

LEVELS = (4, 16)  # segments, coarse to fine
_SLICE = 2048  # candidates whose bounds are held at once
_EXACT = 2.0**53
#: With a larger share of pairs alive, products of whole matrices are faster than those of single pairs.
_DENSE = 0.02


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    flat, ends = vectors.flatten().to_numpy(zero_copy_only=False), np.asarray(vectors.value_lengths().to_numpy(zero_copy_only=False))
    rows = np.repeat(np.arange(len(vectors)), ends)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(ends) - ends, ends)] = flat
    return out


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows whose inner product is the bound: square roots of the width times means, then deviations."""
    width = -(-max(x.shape[1], 1) // segments)
    x = np.pad(x, ((0, 0), (0, width * segments - x.shape[1]))).reshape(len(x), segments, width)
    return np.sqrt(width) * np.concatenate([x.mean(axis=2), x.std(axis=2)], axis=1)


def exact_products(q: np.ndarray, c: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the pairs (q[a], c[b]); beyond what doubles hold exactly, in Python's integers (held to 64 bits)."""
    most = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(q.shape[1], 1)
    if most < _EXACT:
        return np.einsum("ij,ij->i", q[a], c[b]).astype(np.int64)
    limit = 2**63 - 1
    return np.array([max(-limit - 1, min(limit, sum(int(x) * int(y) for x, y in zip(q[i], c[j], strict=True)))) for i, j in zip(a, b, strict=True)], dtype=np.int64)


class Search:
    """The k best candidates so far of each query of a block."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int) -> None:
        self.ids, self.q, self.k = ids, q, k
        self.bounds = [segment_statistics(q, s) for s in LEVELS]
        self.best = np.empty((0, 3), dtype=np.int64)  # query's place, score, vec_id
        self.least = np.full(len(ids), -np.inf)
        self.scale = np.sqrt((q * q).sum(axis=1))
        self.computed = 0

    def add(self, ids: np.ndarray, c: np.ndarray) -> None:
        width = max(c.shape[1], self.q.shape[1])
        if c.shape[1] < width or self.q.shape[1] < width:
            c, self.q = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (c, self.q))
            self.bounds = [segment_statistics(self.q, s) for s in LEVELS]
        for at in range(0, len(ids), _SLICE):
            self._slice(ids[at : at + _SLICE], c[at : at + _SLICE])

    def _slice(self, ids: np.ndarray, c: np.ndarray) -> None:
        slack = 1e-9 * self.scale[:, None] * np.sqrt((c * c).sum(axis=1))[None, :]
        floor = self.least[:, None] - slack
        alive = self.ids[:, None] != ids[None, :]
        for bound, segments in zip(self.bounds, LEVELS, strict=True):
            fine = segment_statistics(c, segments)
            if alive.mean() > _DENSE:
                alive &= bound @ fine.T >= floor
            else:
                a, b = np.nonzero(alive)
                alive[a, b] = np.einsum("ij,ij->i", bound[a], fine[b]) >= floor[a, b]
        self.computed += int(alive.sum())
        if alive.mean() > _DENSE and np.abs(self.q).max(initial=0) * np.abs(c).max(initial=0) * c.shape[1] < _EXACT:
            # Many survivors: one product of matrices of whole numbers, exact in doubles, then the k best of each query.
            score = np.where(alive, self.q @ c.T, -np.inf)
            if score.shape[1] >= self.k:
                np.maximum(self.least, np.partition(score, -self.k, axis=1)[:, -self.k], out=self.least)
            a, b = np.nonzero(alive & (score >= self.least[:, None]))
            self._keep(a, score[a, b].astype(np.int64), ids[b])
        else:
            a, b = np.nonzero(alive)
            score = np.concatenate([np.empty(0, dtype=np.int64), *(exact_products(self.q, c, a[i : i + (1 << 18)], b[i : i + (1 << 18)]) for i in range(0, len(a), 1 << 18))])
            good = score >= self.least[a]
            self._keep(a[good], score[good], ids[b[good]])

    def _keep(self, query: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        rows = np.concatenate([self.best, np.column_stack([query, score, vec_id])])
        rows = rows[np.lexsort((rows[:, 2], -rows[:, 1], rows[:, 0]))]
        place = np.arange(len(rows)) - np.searchsorted(rows[:, 0], rows[:, 0])
        self.best = rows[place < self.k]
        last = rows[place == self.k - 1]
        self.least[last[:, 0]] = last[:, 1]


def nearest(vectors: DataFrame, is_query: str, k: int = 20, block: int = 16_384) -> DataFrame:
    """query_id, rank, vec_id, score. vectors: vec_id and v, an array of whole doubles; is_query: SQL for which of them ask.

    Queries wait in the shared folder, a folder for each block. One block at a time, about half of `block` rows by their hash, is
    read and sent to all tasks, and its results are written before the next one's turn: the driver holds one block whatever the number of queries.
    """
    spark = vectors.sparkSession
    ready(spark)
    asked = staged(vectors.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")))
    n_blocks = -(-asked.count() // max(block // 2, 1)) or 1
    queries, found = shared_dir(spark), shared_dir(spark)
    asked.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int")).write.partitionBy("b").parquet(queries)
    asked = spark.read.schema("vec_id long, v array<double>, b int").parquet(queries)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    for b in range(n_blocks):
        rows = asked.where(F.col("b") == b).select("vec_id", "v").toArrow()
        v = rows.column(1).combine_chunks()
        sent = spark.sparkContext.broadcast((rows.column(0).to_numpy(), _matrix_of(v)))
        one = vectors.select("vec_id", "v").mapInArrow(partial(_search, sent=sent, k=k), "query_id long, vec_id long, score long")
        one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).write.parquet(f"{found}/b={b}")
        sent.destroy()
    return spark.read.schema("query_id long, vec_id long, score long, rank int").parquet(found).select("query_id", "rank", "vec_id", "score")


def _matrix_of(v: pa.Array) -> np.ndarray:
    return matrix(v, max(v.value_lengths().to_numpy(zero_copy_only=False).max(initial=0), 1)) if len(v) else np.zeros((0, 1))


def _search(batches: Iterator[pa.RecordBatch], sent, k: int) -> Iterator[pa.RecordBatch]:
    ids, q = sent.value
    search = Search(ids, q, k)
    held: list[pa.RecordBatch] = []

    def flush() -> None:
        if held:
            search.add(np.concatenate([b.column(0).to_numpy() for b in held]), _matrix_of(pa.chunked_array([b.column(1) for b in held]).combine_chunks()))
            held.clear()

    for b in batches:
        if b.num_rows:
            held.append(b)
            if sum(x.num_rows for x in held) >= _SLICE:
                flush()
    flush()
    yield pa.RecordBatch.from_pydict({"query_id": ids[search.best[:, 0]], "vec_id": search.best[:, 2], "score": search.best[:, 1]})


def whole_vectors(table: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component, as doubles that hold whole numbers; only vectors that take part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    fine = F.col("embedding").isNotNull() & ~F.coalesce(F.exists("embedding", bad), F.lit(False)) & F.col("vec_id").isNotNull()
    floor = lambda x: F.floor(x.cast("double") * scale).cast("double")
    return table.select("vec_id", "embedding").where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", floor).alias("v"))
