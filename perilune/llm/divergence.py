"""Operator 13: how far the sources of each language diverge, over distinct count columns.

Each task adds up its documents' terms by (lang, source) before anything is shuffled. A term's counts by source are a sparse vector;
terms of a language with equal vectors are one column with a multiplicity. Every pair of sources is evaluated once for each
distinct column and multiplied by that; only then are original terms ranked.

With counts c, probabilities are p = 1 + floor(10^9 * (c + 2) / (N + 2 V)), N the counts and V the kept terms, and two of them
diverge by floor((p - q)^2 / (p + q)); all in whole numbers. Columns are dealt over tasks by tiles of at most `tile` x `tile` sources and by
a salt, so a task holds one tile of sums whatever the number of sources, and a language's columns are spread. What a column adds is taken
relative to two absent terms, so its cost follows the sources that it occurs in.

Null texts, languages and sources are empty ones; texts without terms still make their group. Documents are rows: repeated rows count
each. Ties go to the item whose UTF-8 bytes come first. A language without kept terms has value 0 for every pair, and no terms. Very long
texts are read whole, one after the other. Further columns are left out. An empty table gives no rows. Sums hold up to 9 * 10^15 occurrences in a language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perilune.llm.common import ready, staged

#: Every ASCII byte but letters is a gap; A-Z are lowered. All bytes of other characters belong to terms.
_TERMS = bytes(b if b > 127 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Occurrences that a task adds up before it hands them on, and rows that it cuts at once.
_HELD = 3_000_000
_ROWS = 64
_SCALE = 1000  # its cube is the scale of probabilities
#: Entries times sources that are evaluated at once.
_CELLS = 1 << 20


@dataclass(frozen=True)
class Audit:
    least_docs: int = 10
    top: int = 10
    tile: int = 256
    salts: int = 256  # of a language that is one tile; more tiles have fewer each


def _split(texts: pa.Array) -> pa.ListArray:
    """Terms of each text: gaps become spaces in the whole buffer at once; empty strings at the ends of a text stay."""
    texts = pa.concat_arrays([texts.cast(pa.large_string()).fill_null("")])
    _, offsets, data = texts.buffers()
    raw = data.to_pybytes().translate(_TERMS) if data is not None else b""
    return pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(texts), offsets, pa.py_buffer(raw), None, 0, texts.offset))


def _counted(waiting: list[tuple[pa.Array, pa.Array, pa.ListArray]]) -> pa.RecordBatch:
    """lang, source, term, n, docs of some documents: sorts of numbers for (document, term), then for (group, term)."""
    lang, source, terms = (pa.chunked_array(c).combine_chunks() for c in zip(*waiting, strict=True))
    langs, sources = lang.fill_null("").dictionary_encode(), source.fill_null("").dictionary_encode()
    group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
    words = terms.flatten().dictionary_encode()
    code, n_words = words.indices.to_numpy().astype(np.int64), len(words.dictionary)
    doc = np.repeat(np.arange(len(terms)), pc.list_value_length(terms).to_numpy())
    full = (pc.binary_length(words.dictionary).to_numpy() > 0)[code] if len(code) else np.zeros(0, dtype=bool)
    pairs, n = _runs(np.sort(doc[full] * n_words + code[full]))
    doc, code = np.divmod(pairs, max(n_words, 1))
    key = group[doc] * n_words + code
    order = np.argsort(key, kind="stable")
    distinct, docs = _runs(key[order])
    n = np.add.reduceat(n[order], np.cumsum(docs) - docs) if len(docs) else docs
    own, whole = _runs(np.sort(group))  # each group's own row
    at, code = np.divmod(distinct, max(n_words, 1))
    at = np.concatenate([at, own])
    term = pa.concat_arrays([words.dictionary.take(pa.array(code)).cast(pa.string()), pa.nulls(len(own), pa.string())])
    lang, source = langs.dictionary.take(pa.array(at // len(sources.dictionary))), sources.dictionary.take(pa.array(at % len(sources.dictionary)))
    n, docs = np.concatenate([n, np.zeros_like(own)]), np.concatenate([docs, whole])
    return pa.RecordBatch.from_arrays([lang.cast(pa.string()), source.cast(pa.string()), term, pa.array(n), pa.array(docs)], names=["lang", "source", "term", "n", "docs"])


def _runs(ascending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and how often each stands there."""
    first = np.flatnonzero(np.concatenate([np.ones(min(len(ascending), 1), dtype=bool), ascending[1:] != ascending[:-1]]))
    return ascending[first], np.diff(np.append(first, len(ascending)))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents, in part sums; a row with a null term for each group."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0
        for b in batches:
            for k in range(0, b.num_rows, _ROWS):
                part = b.slice(k, _ROWS)
                terms = _split(part.column(2))
                waiting.append((part.column(0), part.column(1), terms))
                held += len(terms.values)
                if held > _HELD:
                    yield _counted(waiting)
                    waiting, held = [], 0
        if waiting:
            yield _counted(waiting)

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _div(x: Column, y: Column) -> Column:
    """The whole quotient of two longs."""
    return F.call_function("div", x, y)


def probability(count: Column, whole: Column) -> Column:
    """1 + floor(10^9 * (count + 2) / whole) by long division in base 1000, so that nothing overflows."""
    out, rest = F.lit(0).cast("long"), count + 2
    for _ in range(3):
        out, rest = out * _SCALE + _div(rest * _SCALE, whole), F.pmod(rest * _SCALE, whole)
    return out + 1


def divergence(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def columns_of(counts: DataFrame, audit: Audit) -> tuple[DataFrame, DataFrame, DataFrame]:
    """terms: lang, term, column (ascending (k, n) of the sources it occurs in), all staged with
    groups: lang, source, k (the source's place in its language), whole (N + 2 V), and langs: lang, whole, kept (V)."""
    summed = staged(counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = staged(summed.where("term is null").select("lang", "source", place.cast("long").alias("k")))
    held = summed.where("term is not null").join(groups, ["lang", "source"])
    terms = held.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("k", "n"))).alias("column"), F.sum("docs").alias("docs"))
    terms = staged(terms.where(F.col("docs") >= audit.least_docs).select("lang", "term", "column"))
    entries = terms.select("lang", F.inline("column"))
    totals = entries.groupBy("lang", "k").agg(F.sum("n").alias("n"))
    kept = terms.groupBy("lang").agg(F.count("*").alias("kept"))
    by_source = groups.join(totals, ["lang", "k"], "left").join(kept, "lang", "left")
    n, v = F.coalesce("n", F.lit(0)), F.coalesce("kept", F.lit(0))
    groups = staged(by_source.select("lang", "source", "k", n.alias("n"), v.alias("kept"), (n + 2 * v).alias("whole")))
    langs = groups.groupBy("lang").agg((F.sum("n") + 2 * F.max("kept")).alias("whole"))
    return terms, groups, langs


def distinct_columns(terms: DataFrame) -> DataFrame:
    """lang, column, times (its terms), id (the first of them)."""
    return terms.groupBy("lang", "column").agg(F.count("*").alias("times"), F.min("term").alias("id"))


def source_pairs(columns: DataFrame, groups: DataFrame, audit: Audit) -> DataFrame:
    """lang, i, j, value for all sources i < j of each language: part sums by salt."""
    tile = audit.tile
    # A tile's own row comes first, with what it must know of its sources; then the columns that occur in one of them.
    strips = F.floor(F.max("k") / tile).cast("long") + 1
    salts = F.greatest(F.lit(1), F.floor(2 * audit.salts / (strips * (strips + 1)))).cast("int")
    size = groups.groupBy("lang").agg((strips - 1).alias("top"), F.max("kept").alias("kept"), salts.alias("salts"))
    strip = groups.groupBy("lang", F.floor(F.col("k") / tile).cast("long").alias("t")).agg(F.array_sort(F.collect_list(F.struct("k", "whole"))).alias("s"))
    strip = strip.select("lang", "t", F.transform("s", lambda x: x["whole"]).alias("whole"))
    a, b = strip.select("lang", F.col("t").alias("ti"), F.col("whole").alias("wi")), strip.select("lang", F.col("t").alias("tj"), F.col("whole").alias("wj"))
    tiles = size.select("*", F.explode(F.sequence(F.lit(0).cast("long"), "top")).alias("ti"))
    tiles = tiles.select("*", F.explode(F.sequence("ti", "top")).alias("tj")).join(a, ["lang", "ti"]).join(b, ["lang", "tj"])
    null = lambda kind: F.lit(None).cast(kind)
    facts = tiles.select("lang", "ti", "tj", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "kept", "wi", "wj")
    facts = facts.select("*", null("array<struct<k:bigint,n:bigint>>").alias("column"), F.lit(0).cast("long").alias("times"))
    salt = F.pmod(F.xxhash64("lang", "id"), "salts").cast("int").alias("salt")
    strips = F.array_distinct(F.transform("column", lambda x: F.floor(x["k"] / tile).cast("long")))
    met = columns.join(size, "lang").select("lang", salt, "column", "times", "top", F.explode(strips).alias("m"), strips.alias("ms"))
    # A column goes to the tiles of each strip that it meets, and once to a tile of two such strips.
    other = F.filter(F.sequence(F.lit(0).cast("long"), "top"), lambda t: (t >= F.col("m")) | ~F.array_contains(F.col("ms"), t))
    met = met.select("lang", "salt", "column", "times", "m", F.explode(other).alias("t"))
    met = met.select("lang", F.least("m", "t").alias("ti"), F.greatest("m", "t").alias("tj"), "salt", null("bigint").alias("kept"), null("array<bigint>").alias("wi"), null("array<bigint>").alias("wj"), "column", "times")
    key = ["lang", "ti", "tj", "salt"]
    dealt = facts.unionByName(met).repartition(*key).sortWithinPartitions(*key, F.col("kept").asc_nulls_last())
    return dealt.mapInArrow(_tiles(tile), "lang string, i long, j long, value long")


def _p(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    out, rest = np.zeros(np.broadcast(count, whole).shape, dtype=np.int64), count + 2
    for _ in range(3):
        rest = rest * _SCALE
        out, rest = out * _SCALE + rest // whole, rest % whole
    return out + 1


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class _Tile:
    """Sums of one tile: rows i of strip ti, columns j of strip tj."""

    def __init__(self, ti: int, tj: int, tile: int, kept: int, wi: list[int], wj: list[int], own: bool) -> None:
        self.i, self.j, self.kept = ti * tile, tj * tile, kept
        self.wi, self.wj = np.array(wi, dtype=np.int64), np.array(wj, dtype=np.int64)
        self.sums = np.zeros((len(wi), len(wj)), dtype=np.int64)
        if kept:
            self.pi, self.pj = _p(np.zeros_like(self.wi), self.wi), _p(np.zeros_like(self.wj), self.wj)
            if own:
                self.sums += kept * _f(self.pi[:, None], self.pj[None, :])

    def add(self, columns: list[list[dict]], times: np.ndarray) -> None:
        if not self.kept:
            return
        flat = [(d, e["k"], e["n"]) for d, column in enumerate(columns) for e in column]
        d, k, n = np.array(flat, dtype=np.int64).reshape(-1, 3).T
        a, b = np.zeros((len(columns), len(self.wi)), dtype=np.int64), np.zeros((len(columns), len(self.wj)), dtype=np.int64)
        for held, first in ((a, self.i), (b, self.j)):
            here = (k >= first) & (k < first + held.shape[1])
            held[d[here], k[here] - first] = n[here]
        self._rows(a, b, times)

    def _rows(self, a: np.ndarray, b: np.ndarray, times: np.ndarray) -> None:
        """What columns add over absent terms: entries of a against all of b, then those of b alone against a."""
        p, q = _p(a, self.wi), _p(b, self.wj)
        step = max(1, _CELLS // max(a.shape[1], b.shape[1]))
        d, i = np.nonzero(a)
        order = np.argsort(i, kind="stable")
        d, i = d[order], i[order]
        for x in range(0, len(d), step):
            u, v = d[x : x + step], i[x : x + step]
            gain = (_f(p[u, v][:, None], q[u]) - _f(self.pi[v][:, None], self.pj[None, :])) * times[u][:, None]
            first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            self.sums[v[first]] += np.add.reduceat(gain, first, axis=0)
        d, j = np.nonzero(b)
        order = np.argsort(j, kind="stable")
        d, j = d[order], j[order]
        for x in range(0, len(d), step):
            u, v = d[x : x + step], j[x : x + step]
            gain = np.where(a[u] == 0, _f(p[u], q[u, v][:, None]) - _f(self.pi[None, :], self.pj[v][:, None]), 0) * times[u][:, None]
            first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            self.sums[:, v[first]] += np.add.reduceat(gain, first, axis=0).T

    def rows(self, lang: str, own: bool) -> pa.RecordBatch:
        i, j = np.indices(self.sums.shape)
        i, j, value = (i + self.i).ravel(), (j + self.j).ravel(), self.sums.ravel()
        told = (i < j) & (own | (value != 0))
        return pa.RecordBatch.from_pydict({"lang": pa.array([lang] * int(told.sum()), pa.string()), "i": i[told], "j": j[told], "value": value[told]})


def _tiles(tile: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key = None, None
        for b in batches:
            names = [c.to_pylist() for c in b.columns[:4]]
            kept, wi, wj, column, times = (b.column(k) for k in range(4, 9))
            keys = [*zip(*names, strict=True)]
            times, at = times.to_numpy(), 0
            while at < len(keys):
                end = at
                if keys[at] != key or kept[at].is_valid:
                    if now is not None:
                        yield now.rows(key[0], key[3] == 0)
                    key = keys[at]
                    now = _Tile(key[1], key[2], tile, kept[at].as_py(), wi[at].as_py(), wj[at].as_py(), key[3] == 0)
                    at += 1
                    continue
                while end < len(keys) and keys[end] == key and not kept[end].is_valid:
                    end += 1
                now.add(column[at:end].to_pylist(), times[at:end])
                at = end
        if now is not None:
            yield now.rows(key[0], key[3] == 0)

    return run


def top_terms(terms: DataFrame, groups: DataFrame, langs: DataFrame, audit: Audit) -> DataFrame:
    """lang, source, item, value, rank: the terms that a source uses more than its language, those that diverge most.

    All terms of a column have the same value in a source, so only the first `top` of each can be among a source's."""
    first = F.row_number().over(Window.partitionBy("lang", "column").orderBy("term"))
    few = terms.withColumn("r", first).where(F.col("r") <= audit.top)
    total = F.aggregate("column", F.lit(0).cast("long"), lambda a, e: a + e["n"])
    langs = langs.withColumnRenamed("whole", "all")
    rows = few.select("lang", "term", total.alias("total"), F.inline("column")).join(groups.where("kept > 0").select("lang", "k", "source", "whole"), ["lang", "k"]).join(langs, "lang")
    rows = rows.withColumn("p", probability(F.col("n"), F.col("whole"))).withColumn("q", probability(F.col("total"), F.col("all")))
    rows = rows.where("p > q").select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= audit.top)


def audit_sources(docs: DataFrame, audit: Audit = Audit()) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    terms, groups, langs = columns_of(term_counts(docs), audit)
    pairs = source_pairs(distinct_columns(terms), groups, audit).groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    ends = F.explode(F.array(F.struct(F.col("i").alias("k"), F.col("j").alias("o")), F.struct(F.col("j").alias("k"), F.col("i").alias("o")))).alias("e")
    both = pairs.select("lang", "value", ends).select("lang", "value", "e.*")
    named = both.join(groups.select("lang", "k", "source"), ["lang", "k"]).join(groups.select("lang", F.col("k").alias("o"), F.col("source").alias("item")), ["lang", "o"])
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    named = named.withColumn("rank", rank).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    found = top_terms(terms, groups, langs, audit).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return named.unionByName(found)
