"""Operator 9: language-model scoring by context-tree weighting, beside a unigram base.

Counting: tasks count byte grams (DEPTH bytes of context, A-Z lowered, and the byte that follows) and words over all training
documents, and the counts are summed by key. Grams of shorter contexts are sums of those of the longest ones.

Model: every context of the training texts is in the tree. Contexts of up to TOP bytes, whose number the alphabet bounds, are
sent to every task; longer ones stay in a table. Grams that share TOP + 1 bytes of context are one stretch of it, from which a
task grows what lies below. Weights mix the Krichevsky-Trofimov estimates of all depths.

Scores: a gram's score depends on the gram alone. Those of the most frequent grams, at most `capacity`, are sent to every task
to save the way through the join; all other grams of a document, seen in training or not, find theirs by a join.

Base: words that make up at least 1 / `capacity` of all tokens are sent likewise; the other words of a document are
looked up by a join with the counts of all words.

Null and empty texts are the end alone. Repeated rows are scored each. A null doc_id counts as an empty text in the training
split. A very long text is one row of grams that aren't sent, each once. Grams of equal counts are all sent or all joined, which
changes no score. An empty corpus has a tree of even chances. Other columns are left out.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilune.llm.common import _LOWER, ready, released, staged, utf8
from perilune.llm.context_tree import _MASK, DEPTH, Level, Tree, frames, grow_levels, shorter

#: The token that ends each text has this key; words have their hashes.
END = 0
_GRAM, _WORD = 0, 1
_FLUSH = 2_000_000
_REMEMBERED = 400_000
#: Contexts of so many bytes are sent; tasks that grow longer ones hold about so many grams.
TOP = 2
_STRETCH = 250_000
_SLOT_BITS = 21
_SLOTS: dict = {}


def word_keys(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) or 1 for w in words], dtype=np.uint64).view(np.int64)


def is_training(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 != 2


def count_tokens(docs: DataFrame) -> DataFrame:
    """kind, key, n over the rows of docs; staged."""
    ready(docs.sparkSession)

    def summed(held: list[tuple[np.ndarray, np.ndarray]], kind: int) -> pa.RecordBatch:
        codes, keys = pd.factorize(np.concatenate([k for k, _ in held]))
        n = np.bincount(codes, weights=np.concatenate([c for _, c in held]), minlength=len(keys)).astype(np.int64)
        return pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(keys), kind, dtype=np.int32)), "key": pa.array(keys.astype(np.int64)), "n": pa.array(n)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {_GRAM: [], _WORD: []}
        size = {_GRAM: 0, _WORD: 0}
        for b in batches:
            texts = [utf8(t).translate(_LOWER) for t in b.column(0).to_pylist()]
            words: Counter = Counter()
            for t in texts:
                words.update(t.split())
            keys = np.append(word_keys(list(words)), END)
            found = {_WORD: (keys, np.append(np.fromiter(words.values(), dtype=np.float64, count=len(words)), len(texts)))}
            codes, grams = pd.factorize(frames(texts)[0])
            found[_GRAM] = (grams.view(np.int64), np.bincount(codes, minlength=len(grams)).astype(np.float64))
            for kind, pair in found.items():
                held[kind].append(pair)
                size[kind] += len(pair[0])
                if size[kind] > _FLUSH:
                    yield summed(held[kind], kind)
                    held[kind], size[kind] = [], 0
        for kind, parts in held.items():
            if parts:
                yield summed(parts, kind)

    return staged(docs.select("text").mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))


@dataclass
class Model:
    top: list[Level]  # contexts of up to TOP bytes
    grams: DataFrame | None  # key, n: all grams of training; the driver's alone
    sent: np.ndarray  # frequent grams, ascending
    scores: np.ndarray  # ln of their probabilities
    tokens: int  # N
    distinct: int  # V
    words: np.ndarray  # keys of the frequent words, ascending
    counts: np.ndarray
    token: str = field(default_factory=lambda: uuid.uuid4().hex)  # tells whose grams the worker's table holds

    def count(self, keys: np.ndarray) -> np.ndarray:
        """Of frequent words; -1 for any other."""
        if not len(self.words):
            return np.full(len(keys), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.words, keys), len(self.words) - 1)
        return np.where(self.words[at] == keys, self.counts[at], -1)

    def score(self, grams: np.ndarray) -> np.ndarray:
        """Of sent grams; NaN for any other. A table by hash finds most of them, a search the rest."""
        slot = lambda g: ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        if _SLOTS.get("token") != self.token:
            _SLOTS.clear()
            _SLOTS.update(token=self.token, keys=np.full(1 << _SLOT_BITS, (1 << 64) - 1, dtype=np.uint64), values=np.zeros(1 << _SLOT_BITS, dtype=np.float32))
            at = slot(self.sent)
            _SLOTS["keys"][at], _SLOTS["values"][at] = self.sent, self.scores
        at = slot(grams)
        out = _SLOTS["values"][at].astype(np.float64)
        missing = np.flatnonzero(_SLOTS["keys"][at] != grams)
        if not len(self.sent):
            return np.full(len(grams), np.nan)
        place = np.minimum(np.searchsorted(self.sent, grams[missing]), len(self.sent) - 1)
        out[missing] = np.where(self.sent[place] == grams[missing], self.scores[place], np.nan)
        return out


def _stretches(grams: DataFrame, rows: int) -> DataFrame:
    """Dealt out so that grams with the same TOP + 1 bytes of context are in one task."""
    parts = max(int(grams.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // _STRETCH))
    return grams.repartition(parts, F.shiftrightunsigned("key", 8).bitwiseAND(F.lit(int(_MASK[TOP + 1]))))


def _below(key: np.ndarray, n: np.ndarray) -> tuple[list[Level], tuple]:
    """The levels below TOP from all grams of some stretches."""
    counts = [(key, n)]
    for d in range(DEPTH - 1, TOP, -1):
        short, back = np.unique(counts[-1][0] & _MASK[d + 1], return_inverse=True)
        counts.append((short, np.bincount(back, weights=counts[-1][1], minlength=len(short))))
    return grow_levels(counts[::-1], TOP + 1)


def _whole(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
    """The columns of all batches of a task."""
    held = list(batches)
    return [np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in range(held[0].num_columns)] if held else []


def _node_sums(grams: DataFrame, rows: int) -> DataFrame:
    """key, n: nodes of TOP bytes of context and the summed ln weighted of their longer contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if cols := _whole(batches):
            _, (node, _, _, weighted) = _below(cols[0].view(np.uint64), cols[1])
            key, back = np.unique(shorter(node, TOP), return_inverse=True)
            yield pa.RecordBatch.from_pydict({"key": pa.array(key.view(np.int64)), "n": pa.array(np.bincount(back, weights=weighted, minlength=len(key)))})

    return _stretches(grams.select("key", "n"), rows).mapInArrow(run, "key long, n double").groupBy("key").agg(F.sum("n").alias("n"))


def _gram_scores(grams: DataFrame, asked: DataFrame, rows: int, top: list[Level]) -> DataFrame:
    """key, score: ln of the probability of every asked gram (key) by the whole tree."""
    sent = grams.sparkSession.sparkContext.broadcast(top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if cols := _whole(batches):
            key, n, want = cols[0].view(np.uint64), cols[1], cols[2].astype(bool)
            seen = n > 0
            tree = Tree([*sent.value, *_below(key[seen], n[seen])[0]])
            key = key[want]
            for k in range(0, len(key), 1 << 16):
                part = np.ascontiguousarray(key[k : k + (1 << 16)])
                yield pa.RecordBatch.from_pydict({"key": pa.array(part.view(np.int64)), "score": pa.array(tree.ln_probability(part).astype(np.float32))})

    both = grams.select("key", "n", F.lit(False).alias("want")).unionByName(asked.select("key", F.lit(0).cast("long").alias("n"), F.lit(True).alias("want")))
    return _stretches(both, rows).mapInArrow(run, "key long, score float")


def _gather(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    t = rows.select("key", "n").toArrow()
    key, n = t.column(0).to_numpy(), t.column(1).to_numpy()
    order = np.argsort(key)
    return key[order], n[order]


def learn(docs: DataFrame, capacity: int = 1 << 19) -> tuple[Model, DataFrame]:
    """The model of docs' texts and (key, n) of all their words."""
    counts = count_tokens(docs)
    released(docs.sparkSession)
    grams, words = counts.where(F.col("kind") == _GRAM).select("key", "n"), counts.where(F.col("kind") == _WORD).select("key", "n")
    sizes = {r.level: r.n for r in grams.groupBy(F.floor(F.log2("n")).alias("level")).agg(F.count("*").alias("n")).collect()}
    rows = sum(sizes.values())
    short = [_gather(grams.groupBy(F.col("key").bitwiseAND(F.lit(int(_MASK[TOP + 1]))).alias("key")).agg(F.sum("n").alias("n")))]
    for d in range(TOP - 1, -1, -1):
        key, back = np.unique(short[-1][0] & np.int64(_MASK[d + 1]), return_inverse=True)
        short.append((key, np.bincount(back, weights=short[-1][1], minlength=len(key))))
    node, inner = _gather(_node_sums(grams, rows))
    top, _ = grow_levels([(k.view(np.uint64), n) for k, n in short[::-1]], under=(node.view(np.uint64), inner))
    least = min(k for k in range(64) if sum(n for v, n in sizes.items() if v >= k) <= capacity)
    sent, scores = _gather(_gram_scores(grams, grams.where(F.col("n") >= 1 << least), rows, top).withColumnRenamed("score", "n"))
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    key, n = _gather(words.where((F.col("n") >= max(1, -(-tokens // capacity))) | (F.col("key") == END)))
    return Model(top, grams, sent.view(np.uint64), scores, tokens, distinct, key, n), words


def score_texts(docs: DataFrame, model: Model, words: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes (the end's byte included), bits_per_byte (the code length)."""
    spark = docs.sparkSession
    ready(spark)
    sent = spark.sparkContext.broadcast(replace(model, top=[], grams=None))
    scale = np.log10(float(model.tokens + model.distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        number: dict[bytes, int] = {}  # of the words that this task has seen; keys and counts by number
        keys, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        end = max(int(m.count(np.array([END]))[0]), 0)  # the end is always among the words that are sent
        for b in batches:
            ids, texts = b.column(0).to_pylist(), [utf8(t).translate(_LOWER) for t in b.column(1).to_pylist()]
            if len(number) > _REMEMBERED:
                number.clear()
                keys, counts = keys[:0], counts[:0]
            split = [t.split() for t in texts]
            flat = list(chain.from_iterable(split))
            new = list(set(flat).difference(number))
            number.update(zip(new, range(len(number), len(number) + len(new)), strict=True))
            new_keys = word_keys(new)
            keys, counts = np.concatenate([keys, new_keys]), np.concatenate([counts, m.count(new_keys)])
            word = np.fromiter(map(number.__getitem__, flat), dtype=np.int64, count=len(flat))
            lengths = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
            doc, c = np.repeat(np.arange(len(texts)), lengths), counts[word]
            total = lambda w, doc=doc, texts=texts: np.bincount(doc, weights=w, minlength=len(texts))
            base = total(np.where(c >= 0, np.log10(np.maximum(c, 0) + 1.0) - scale, 0.0)) + (np.log10(end + 1.0) - scale)
            known = total(c > 0).astype(np.int64) + (end > 0)
            # Words that weren't sent: each once for a text, with how often it is there.
            rare, times = np.unique(np.column_stack([doc[c < 0], keys[word[c < 0]]]), axis=0, return_counts=True)
            cuts = np.searchsorted(rare[:, 0], np.arange(len(texts) + 1)).astype(np.int32)
            rows = {"doc_id": pa.array(ids, pa.int64()), "held_out": pa.array([zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i in ids], pa.bool_()), "n_tokens": pa.array(lengths + 1), "known": pa.array(known), "base": pa.array(base)}
            rows |= {"rare": pa.ListArray.from_arrays(cuts, rare[:, 1]), "times": pa.ListArray.from_arrays(cuts, times)}
            grams, owner = frames(texts)
            score = m.score(grams)
            lone = np.isnan(score)
            value = np.bincount(owner, weights=np.where(lone, 0.0, score), minlength=len(texts))
            # Grams that weren't sent, likewise.
            grams, owner = grams[lone], owner[lone]
            order = np.lexsort((grams, owner))
            grams, owner = grams[order], owner[order]
            first = np.flatnonzero(np.concatenate([np.ones(min(len(grams), 1), dtype=bool), (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])]))
            cuts = np.searchsorted(owner[first], np.arange(len(texts) + 1)).astype(np.int32)
            rows |= {"grams": pa.ListArray.from_arrays(cuts, grams[first].view(np.int64)), "often": pa.ListArray.from_arrays(cuts, np.diff(first, append=len(grams)))}
            yield pa.RecordBatch.from_pydict({**rows, "score": pa.array(value), "n_bytes": pa.array([len(t) + 1 for t in texts], pa.int64())})

    schema = "doc_id long, held_out boolean, n_tokens long, known long, base double, rare array<long>, times array<long>, grams array<long>, often array<long>, score double, n_bytes long"
    # The row's number is fixed once it is written; rare words and grams find their counts and scores by it.
    scored = staged(docs.select("doc_id", "text").mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))
    asked = scored.select("row", F.inline(F.arrays_zip("rare", "times"))).withColumnRenamed("rare", "key")
    by_word = asked.join(words, "key", "left").select(
        "row", F.when(F.col("n") > 0, F.col("times")).alias("more"), (F.col("times") * (F.log10(F.coalesce("n", F.lit(0)) + 1.0) - float(scale))).alias("rest"), F.lit(None).cast("double").alias("part")
    )
    lone = scored.select("row", F.inline(F.arrays_zip("grams", "often"))).withColumnRenamed("grams", "key")
    unsent = staged(lone.select("key").distinct())
    values = _gram_scores(model.grams, unsent, model.grams.count() + unsent.count(), model.top)
    by_gram = lone.join(values, "key").select("row", F.lit(None).cast("long").alias("more"), F.lit(None).cast("double").alias("rest"), (F.col("often") * F.col("score").cast("double")).alias("part"))
    found = by_word.unionByName(by_gram).groupBy("row").agg(F.sum("more").alias("more"), F.sum("rest").alias("rest"), F.sum("part").alias("part"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return scored.drop("rare", "times", "grams", "often").join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + zero("more")).cast("long").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("rest")).alias("base_score"), ((F.col("score") + zero("part")) / float(np.log(10))).alias("score"),
        "n_bytes", (-(F.col("score") + zero("part")) / float(np.log(2)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
