"""Operator 6: n-gram Jaccard join with token-combination prefixes.

Tokens are 5-word shingles; documents link when their token sets' Jaccard similarity is 0.8 or more.

1. Equal sets are one class (copies cost a row each); the class with its smallest doc_id goes on.
2. Tokens are counted over all classes: tasks send sorted, delta-coded token lists with counts by block of the hash
   space. Tokens above a threshold are *frequent*; they reach the tasks as a bitmap of fixed size. Any rule that tells the
   same of a token everywhere gives right results, so the bitmap's rare false members cost time only. The threshold is
   the lowest power of two for which the frequent tokens fit the bitmap.
3. A document's tokens are ordered rare before frequent, then by hash. Of n tokens at most e = n - ceil(0.8 n) may be missing in
   a partner. If e + 1 rare tokens exist, they are the prefix and each is indexed alone. Otherwise the prefix is
   extended: all rare tokens are indexed alone, frequent ones fall into c classes and every combination of two in a class
   is indexed; a class of f tokens survives f - 2 misses... so the prefix grows until rare + sum(f - 1) > e. Partners then share
   a key: the smaller last token's prefix lies in the other's, and e misses can't break every class. c depends on
   the power of two below n, so the combinations stay in proportion to n; a document near the next power is indexed for both.
4. Within a key, documents are first paired with one centre: fewer pairs than rows. Sketches (token counts by bucket) rule out
   pairs that can't link; the rest is verified on whole texts, and components are formed. Large keys repeat this with
   other centres for what isn't in the centre's component, until a round finds no link.
   A document in many pairs has them dealt over many tasks, each with one copy of its text.
5. Keys whose documents are still in different components pair those across components; what is already joined needs no more
   links. Large keys do so inside tasks, on blocks of bounded size, and emit what their sketches let through. These pairs are
   verified too, and components are formed anew. So no link between different texts is lost, and a
   large group of near copies never emits all its pairs.

Null and empty texts have no tokens and link with nothing; texts under five words are one token. Documents that share a doc_id
count as one document; a null doc_id is its own, unlinked. Other columns are left out or, in `keep_one`, passed through.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perilune.llm.common import map_texts, ready, released, staged, trim
from perilune.llm.components import components
from perilune.llm.shingles import scramble, shingle_sets

_REM_BITS = 28
_BITMAP_BITS = 27
#: So many frequent tokens at most: three of a hundred bits of the bitmap.
_MOST_FREQUENT = 1 << 22
_LEAST_LEVEL = 5  # frequent: in at least 2^5 documents
_BLOCK_TOKENS = 1 << 22
_FLUSH_TOKENS = 1 << 21
_ALL_WIDE = (1 << 32) - 1


def sketch(tokens: np.ndarray) -> bytes:
    """How many tokens fall into each of 2^k buckets, n to 2n of them, a byte each."""
    size = 1 << max(int(len(tokens)).bit_length(), 3)
    return np.minimum(np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size), 255).astype(np.uint8).tobytes()


def may_link(n: int, m: int, x: bytes, y: bytes) -> bool:
    """Whether two sets of n and m tokens can be similar enough: a bucket shares at most the smaller of its two counts."""
    a, b = np.frombuffer(x, dtype=np.uint8), np.frombuffer(y, dtype=np.uint8)
    if a.max(initial=0) == 255 or b.max(initial=0) == 255:
        return True
    size = min(len(a), len(b))
    if len(a) != len(b):
        a, b = a.reshape(-1, size).sum(axis=0), b.reshape(-1, size).sum(axis=0)
    both = int(np.minimum(a, b).sum())
    return 100 * both >= 80 * (n + m - both)


def sets(docs: DataFrame) -> DataFrame:
    """doc_id, n (size of the set), key (128 bits of the sorted set; null without tokens), sketch."""

    def run(ids: list, texts: list) -> dict:
        found = shingle_sets(texts)
        keys = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in found]
        return {"doc_id": pa.array(ids, pa.int64()), "n": pa.array([len(x) for x in found], pa.int64()), "key": pa.array(keys, pa.binary()), "sketch": pa.array([sketch(x) for x in found], pa.binary())}

    return map_texts(docs, run, "doc_id long, n long, key binary, sketch binary")


def encode_counts(rem: np.ndarray) -> bytes:
    """Sorted distinct numbers under 2^28 with their counts: 16-bit steps, the wide steps apart (all in 32 bits if many are wide), the counts over 1 apart."""
    values, counts = np.unique(rem, return_counts=True)
    steps = np.diff(values, prepend=0)
    wide = steps >= 65535
    many = np.flatnonzero(counts > 1)
    if 2 * wide.sum() > len(values):
        head, body = _ALL_WIDE, steps.astype("<u4").tobytes()
    else:
        head, body = int(wide.sum()), np.minimum(steps, 65535).astype("<u2").tobytes() + steps[wide].astype("<u4").tobytes()
    return b"".join((struct.pack("<3I", len(values), head, len(many)), body, many.astype("<u4").tobytes(), counts[many].astype("<u4").tobytes()))


def decode_counts(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, wide, many = struct.unpack_from("<3I", blob)
    if wide == _ALL_WIDE:
        steps, at = np.frombuffer(blob, "<u4", n, 12).astype(np.int64), 12 + 4 * n
    else:
        steps, at = np.frombuffer(blob, "<u2", n, 12).astype(np.int64), 12 + 2 * n + 4 * wide
        steps[steps == 65535] = np.frombuffer(blob, "<u4", wide, 12 + 2 * n)
    counts = np.ones(n, dtype=np.int64)
    counts[np.frombuffer(blob, "<u4", many, at)] = np.frombuffer(blob, "<u4", many, at + 4 * many)
    return np.cumsum(steps), counts


def _place(tokens: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """A token's block and its number there."""
    return tokens % np.uint64(blocks), (tokens // np.uint64(blocks)) & np.uint64((1 << _REM_BITS) - 1)


def _bit(block: np.ndarray, rem: np.ndarray) -> np.ndarray:
    return (scramble(block.astype(np.uint64) << np.uint64(_REM_BITS) ^ rem.astype(np.uint64)) >> np.uint64(64 - _BITMAP_BITS)).astype(np.int64)


def count_blobs(texts: DataFrame, blocks: int) -> DataFrame:
    """block, blob: what each task has counted, flushed before it grows large."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        block, rem = _place(np.concatenate(held), blocks)
        order = np.argsort(block, kind="stable")
        block, rem = block[order].astype(np.int64), rem[order].astype(np.int64)
        heads = np.flatnonzero(np.diff(block, prepend=-1))
        ends = np.append(heads[1:], len(block))
        return pa.RecordBatch.from_pydict({"block": pa.array(block[heads], pa.int64()), "blob": pa.array([encode_counts(rem[i:j]) for i, j in zip(heads, ends, strict=True)], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for x in shingle_sets(b.column(0).to_pylist()):
                held.append(x)
                size += len(x)
                if size >= _FLUSH_TOKENS:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)
        trim()

    return texts.select("text").mapInArrow(run, "block long, blob binary")


def frequent_bitmap(texts: DataFrame, tokens: int) -> tuple[np.ndarray, int]:
    """(bitmap, blocks): bits of the frequent tokens. At most _MOST_FREQUENT tokens come to the driver."""
    blocks = max(8, -(-tokens // _BLOCK_TOKENS))

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [decode_counts(b) for b in rows["blob"]]
        values = np.concatenate([v for v, _ in parts])
        order = np.argsort(values, kind="stable")
        values, counts = values[order], np.concatenate([c for _, c in parts])[order]
        heads = np.flatnonzero(np.diff(values, prepend=-1))
        total = np.add.reduceat(counts, heads)
        level = np.log2(total).astype(np.int64)
        values = values[heads].astype("<u4")
        out = [(int(rows["block"].iloc[0]), int(k), int((level == k).sum()), values[level == k].tobytes()) for k in np.unique(level[level >= _LEAST_LEVEL])]
        return pd.DataFrame(out, columns=["block", "level", "n", "blob"])

    found = staged(count_blobs(texts, blocks).groupBy("block").applyInPandas(merge, "block long, level int, n long, blob binary"))
    sizes = {r.level: r.n for r in found.groupBy("level").agg(F.sum("n").alias("n")).collect()}
    least = min([k for k in range(_LEAST_LEVEL, 65) if sum(n for v, n in sizes.items() if v >= k) <= _MOST_FREQUENT])
    bits = np.zeros(1 << (_BITMAP_BITS - 3), dtype=np.uint8)
    for r in found.where(F.col("level") >= least).select("block", "blob").toLocalIterator():
        rem = np.frombuffer(r.blob, "<u4")
        at = _bit(np.full(len(rem), r.block), rem)
        np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    return bits, blocks


def index_keys(tokens: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, int]:
    """Keys of a set of sorted tokens, and how many of them, the first ones, are rare tokens; frequent tells its frequent ones."""
    n = len(tokens)
    need = n - -(-4 * n // 5) + 1
    rare = tokens[~frequent]
    if len(rare) >= need:
        return rare[:need], need
    common, keys = tokens[frequent], [rare]
    level = n.bit_length() - 1
    for at in (level, level + 1) if 5 * n >= 4 << (level + 1) else (level,):
        classes = max(1, (1 << at) // 8)
        kind = (scramble(common) % np.uint64(classes)).astype(np.int64)
        again = np.ones(len(common), dtype=bool)
        again[np.unique(kind, return_index=True)[1]] = False
        take = int(np.searchsorted(np.cumsum(again), need - len(rare))) + 1
        order = np.argsort(kind[:take], kind="stable")
        token, kind = common[:take][order], kind[:take][order]
        step = 1
        while step < len(token) and (same := kind[step:] == kind[:-step]).any():
            a, b = token[:-step][same], token[step:][same]
            keys.append(scramble(a * np.uint64(3) + scramble(b) + np.uint64(at)))
            step += 1
    return np.concatenate(keys), len(rare)


def index(texts: DataFrame, bitmap: np.ndarray, blocks: int) -> DataFrame:
    """key, doc, n, single: whether the key is a rare token."""
    bits = texts.sparkSession.sparkContext.broadcast(bitmap)

    def run(ids: list, texts: list) -> dict:
        keys, docs, sizes, single = [], [], [], []
        for doc, tokens in zip(ids, shingle_sets(texts), strict=True):
            if len(tokens) > 1:  # one token alone equals no other set's
                at = _bit(*_place(tokens, blocks))
                found, rare = index_keys(tokens, (bits.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))
                keys.append(found)
                docs.append(np.full(len(found), doc))
                sizes.append(np.full(len(found), len(tokens)))
                single.append(np.arange(len(found)) < rare)
        empty = np.empty(0, dtype=np.int64)
        return {
            "key": pa.array(np.concatenate([np.empty(0, dtype=np.uint64), *keys]).view(np.int64)), "doc": pa.array(np.concatenate([empty, *docs])),
            "n": pa.array(np.concatenate([empty, *sizes]).astype(np.int32)), "single": pa.array(np.concatenate([empty.astype(bool), *single])),
        }

    return map_texts(texts, run, "key long, doc long, n int, single boolean")


#: Documents of a combination are counted in so many parts first; rows of a key are dealt into stretches of about so many.
_PARTS = 64
_STRETCH_ROWS = 256


def shared_keys(keys: DataFrame) -> DataFrame:
    """key, doc, n, c (documents of the key), staged: keys of one document alone are dropped.

    A rare token is in few documents, so one window counts them. A combination may be in any number: its rows are dealt by key and
    part of the documents, counted there, and a part finds the sum of its key's parts by a join that is dealt the same way.
    """
    part = F.when(F.col("single"), F.lit(0)).otherwise(F.pmod(F.xxhash64("doc"), F.lit(_PARTS)).cast("int"))
    rows = keys.withColumn("part", part)
    rows = staged(rows.withColumn("c", F.count("*").over(Window.partitionBy("key", "part"))).where("c > 1 or not single"))
    many = rows.where("not single")
    parts = many.groupBy("key", "part").agg(F.count("*").alias("c"))
    total = parts.withColumn("total", F.sum("c").over(Window.partitionBy("key"))).where("total > 1").select("key", "part", "total")
    many = many.join(total, ["key", "part"]).select("key", "doc", "n", F.col("total").alias("c"))
    return staged(rows.where("single").select("key", "doc", "n", "c").unionByName(many))


def _stretches(c: str = "c") -> Column:
    return F.ceil(F.col(c) / _STRETCH_ROWS).cast("int")


def _dealt(member: DataFrame) -> DataFrame:
    """With the stretch of its key that a row is in: large keys have many, so that no task gets all of one."""
    return member.withColumn("stretch", F.pmod(F.xxhash64("doc"), _stretches()).cast("int"))


def _to_all(keys: DataFrame) -> DataFrame:
    """A row of a key (with c) for each of its stretches."""
    return keys.withColumn("stretch", F.explode(F.sequence(F.lit(0), _stretches() - 1))).drop("c")


def _close(a: str, b: str):
    return (F.col(a) * 5 >= F.col(b) * 4) & (F.col(b) * 5 >= F.col(a) * 4)


def _pair(a: str, b: str) -> list:
    return [F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")]


def bucketed(df: DataFrame, column: str) -> tuple[DataFrame, str]:
    """A table in the warehouse, dealt by a column: later joins on it don't move its rows. Returns it and its name."""
    spark = df.sparkSession
    name = f"perilune_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, column).option("compression", "zstd").saveAsTable(name)
    return spark.table(name), name


def oriented(pairs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Distinct pairs (lo, hi) as leaf, hub, leaf_s, hub_s, staged, and (doc, stretches) of the hot documents, or None without any.

    A document in many pairs, such as a centre of near copies, is hot: its pairs are dealt into stretches of about _STRETCH_ROWS by a hash of
    the other document, and its text is sent once to each. The hub is the document with more pairs if either is hot; so a leaf is hot
    only if its hub is too. Pairs are counted by document and part of the other documents, so no task counts all pairs of one.
    """
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(_PARTS)).cast("int")
    end = lambda me, other: F.struct(F.col(me).alias("doc"), part(other).alias("part"))
    counts = pairs.select(F.explode(F.array(end("lo", "hi"), end("hi", "lo"))).alias("e")).groupBy("e.doc", "e.part").agg(F.count("*").alias("c"))
    counts = counts.withColumn("c", F.sum("c").over(Window.partitionBy("doc"))).where(F.col("c") > _STRETCH_ROWS)
    counts = staged(counts.select("doc", "part", _stretches().alias("k")))
    none = F.lit(None).cast("int")
    if not counts.limit(1).count():
        return pairs.select(F.col("lo").alias("leaf"), F.col("hi").alias("hub"), none.alias("leaf_s"), none.alias("hub_s")), None
    of = lambda me, k: counts.select(F.col("doc").alias(me), "part", F.col("k").alias(k))
    rows = pairs.withColumn("part", part("hi")).join(of("lo", "a"), ["lo", "part"], "left")
    rows = rows.withColumn("part", part("lo")).join(of("hi", "b"), ["hi", "part"], "left")
    swap = F.coalesce("a", F.lit(0)) > F.coalesce("b", F.lit(0))
    rows = rows.select(
        F.when(swap, F.col("hi")).otherwise(F.col("lo")).alias("leaf"), F.when(swap, F.col("lo")).otherwise(F.col("hi")).alias("hub"),
        F.when(swap, F.col("b")).otherwise(F.col("a")).alias("x"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("y"),
    )
    dealt = lambda other, k: F.pmod(F.xxhash64(other), F.col(k)).cast("int")
    return staged(rows.select("leaf", "hub", dealt("hub", "x").alias("leaf_s"), dealt("leaf", "y").alias("hub_s"))), counts.select("doc", "k").distinct()


def with_sides(pairs: DataFrame, hot: DataFrame | None, texts: DataFrame, columns: list[str]) -> DataFrame:
    """leaf, hub and both sides' columns, those of the hub with the suffix _hub.

    Documents stay where they are for their plain joins; leaves' columns alone move on to the hub. Of a hot document a copy goes to each stretch.
    """

    def side(table: DataFrame, name: str, *more: Column) -> DataFrame:
        return table.select(F.col("doc_id").alias(name), *(F.col(c).alias(c if name == "leaf" else f"{c}_hub") for c in columns), *more)

    def plain(rows: DataFrame, name: str) -> DataFrame:
        return side(texts, name).join(rows.drop(f"{name}_s").hint("shuffle_hash"), name)

    if hot is None:
        return plain(plain(pairs, "leaf"), "hub")

    def spread(rows: DataFrame, name: str) -> DataFrame:
        many = texts.join(hot, F.col("doc_id") == F.col("doc")).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        return rows.join(side(many, name, F.col("s").alias(f"{name}_s")).hint("merge"), [name, f"{name}_s"]).drop(f"{name}_s")

    cold, warm = pairs.where("hub_s is null"), pairs.where("hub_s is not null")
    leaves = plain(warm.where("leaf_s is null"), "leaf").unionByName(spread(warm.where("leaf_s is not null"), "leaf"))
    return plain(plain(cold, "leaf"), "hub").unionByName(spread(leaves, "hub"))


def links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of distinct pairs (lo, hi) those whose whole texts are similar enough; staged. Sketches, a small part of the texts, rule most others out first."""
    ready(pairs.sparkSession)
    rows, hot = oriented(pairs)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                columns = [c.to_pylist() for c in b.columns[4:]]
                yield b.select([0, 1, 2, 3]).filter(pa.array([may_link(*x) for x in zip(*columns, strict=True)]))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            leaf, hub, x, y = (c.to_pylist() for c in b.columns)
            texts = dict(zip(zip([*leaf, *hub], map(hash, [*x, *y]), strict=True), [*x, *y], strict=True))
            found = dict(zip(texts, shingle_sets(list(texts.values())), strict=True))
            keep = []
            for i, j, s, t in zip(leaf, hub, x, y, strict=True):
                one, two = found[i, hash(s)], found[j, hash(t)]
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * both >= 80 * (len(one) + len(two) - both))
            yield b.select([0, 1]).filter(pa.array(keep))
        trim()

    marks = [F.col("leaf_s").alias("leaf_at"), F.col("hub_s").alias("hub_at")]
    known = with_sides(rows.select("*", *marks), hot, texts, ["n", "sketch"]).select("leaf", "hub", "leaf_at", "hub_at", "n", "n_hub", "sketch", "sketch_hub")
    near = staged(known.mapInArrow(sift, "leaf long, hub long, leaf_s int, hub_s int").distinct())
    whole = with_sides(near, hot, texts, ["text"]).select("leaf", "hub", "text", "text_hub")
    return staged(whole.mapInArrow(verify, "leaf long, hub long").select(*_pair("leaf", "hub")), batch=64)


#: Keys with so many documents are joined by stars first, and their last pairs are compared inside tasks, block by block.
_LARGE_KEY = 12
_MOST_STARS = 4
_BLOCK_DOCS = 2048
#: Of a document's large keys so many tell whether a pair is compared under another key already.
_FEW_KEYS = 8


def _compare(group: dict[str, list]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a block pair of one key that are in different components, near in size, first met here, and not ruled out by their sketches."""
    doc, n, comp, side = (np.array(group[c]) for c in ("doc", "n", "comp", "side"))
    key, first, second = group["key"][0], group["i"][0], group["j"][0]
    left, right = np.flatnonzero(side == first), np.flatnonzero(side == second)
    few = [[k for k in ks if k < key] for ks in group["few"]]
    known = {k: c for c, k in enumerate(sorted({k for ks in few for k in ks}))}
    holds = np.zeros((len(doc), max(len(known), 1)), dtype=np.float32)
    for r, ks in enumerate(few):
        holds[r, [known[k] for k in ks]] = 1
    near = (5 * n[left][:, None] >= 4 * n[right][None, :]) & (5 * n[right][None, :] >= 4 * n[left][:, None])
    fresh = near & (comp[left][:, None] != comp[right][None, :]) & (holds[left] @ holds[right].T == 0)
    a, b = np.nonzero(fresh)
    a, b = left[a], right[b]
    if first == second:
        a, b = a[a < b], b[a < b]
    size = np.array([len(x) for x in group["sketch"]])
    kept = [np.zeros((0, 2), dtype=np.int64)]
    for x in np.unique(size[a]) if len(a) else ():
        for y in np.unique(size[b]):
            pick = np.flatnonzero((size[a] == x) & (size[b] == y))
            width = min(x, y)
            if not len(pick):
                continue

            def rows(which: np.ndarray, width: int = width) -> tuple[np.ndarray, np.ndarray]:
                docs, back = np.unique(which, return_inverse=True)
                counts = np.frombuffer(b"".join(group["sketch"][d] for d in docs), dtype=np.uint8).reshape(len(docs), -1)
                full = counts.max(axis=1, initial=0) == 255
                return np.where(full[:, None], 65535, counts.reshape(len(docs), -1, width).sum(axis=1)).astype(np.uint16), back

            (left_counts, p), (right_counts, q) = rows(a[pick]), rows(b[pick])
            step = max(1, (1 << 21) // width)
            for at in range(0, len(pick), step):
                part = slice(at, at + step)
                both = np.minimum(left_counts[p[part]], right_counts[q[part]]).sum(axis=1, dtype=np.int64)
                total = n[a[pick[part]]] + n[b[pick[part]]]
                good = pick[part][100 * both >= 80 * (total - np.minimum(both, total))]
                kept.append(np.column_stack([a[good], b[good]]))
    pairs = np.concatenate(kept)
    return doc[pairs[:, 0]], doc[pairs[:, 1]]


def across_large(member: DataFrame, texts: DataFrame) -> DataFrame:
    """lo, hi of pairs across components within large keys. A key's documents are dealt into blocks of bounded size, and each pair of blocks is compared in one task; only pairs that may link come out."""
    few = member.groupBy("doc").agg(F.slice(F.sort_array(F.collect_set("key")), 1, _FEW_KEYS).alias("few"))
    sketches = texts.select(F.col("doc_id").alias("doc"), "sketch").join(few.hint("shuffle_hash"), "doc")
    blocks = F.ceil(F.col("c") / _BLOCK_DOCS).cast("long")
    rows = member.withColumn("side", F.pmod(F.xxhash64("doc"), blocks)).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    rows = rows.join(sketches, "doc").select("key", F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j"), "side", "doc", "n", "comp", "few", "sketch")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    names = rows.columns

    def out(group: dict[str, list]) -> pa.RecordBatch:
        x, y = _compare(group)
        return pa.RecordBatch.from_pydict({"lo": pa.array(np.minimum(x, y), pa.int64()), "hi": pa.array(np.maximum(x, y), pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: dict[str, list] = {c: [] for c in names}
        for b in batches:
            columns = dict(zip(names, (c.to_pylist() for c in b.columns), strict=True))
            marks = list(zip(columns["key"], columns["i"], columns["j"], strict=True))
            begin = 0
            for k in range(len(marks)):
                last = (group["key"][-1], group["i"][-1], group["j"][-1]) if k == 0 and group["key"] else marks[k - 1] if k else None
                if last is not None and marks[k] != last:
                    for c in names:
                        group[c] += columns[c][begin:k]
                    yield out(group)
                    group, begin = {c: [] for c in names}, k
            for c in names:
                group[c] += columns[c][begin:]
        if group["key"]:
            yield out(group)
        trim()

    return rows.mapInArrow(run, "lo long, hi long")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, key of each row; key, comp of each key): comp is the smallest doc_id that links reach."""
    spark = docs.sparkSession
    mine = staged(sets(docs.select("doc_id", "text")))
    reps = staged(mine.where("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.any_value("sketch").alias("sketch")))
    single = reps.where("n > 1").select(F.col("rep").alias("doc_id"), "n", "sketch")
    texts, name = bucketed(docs.select("doc_id", "text").join(single, "doc_id"), "doc_id")
    try:
        found = _linked(texts, reps.agg(F.sum("n")).first()[0] or 0)
    finally:
        spark.sql(f"DROP TABLE {name}")
    comps = reps.select("key", F.col("rep").alias("doc")).join(found, "doc", "left").select("key", F.coalesce("comp", "doc").alias("comp"))
    return mine.select("doc_id", "n", "key"), comps


def _linked(texts: DataFrame, tokens: int) -> DataFrame:
    """doc, comp of the documents that link: texts has doc_id, n, sketch and text of one document of each class."""
    spark = texts.sparkSession
    released(spark)
    bitmap, blocks = frequent_bitmap(texts, tokens)
    released(spark)
    shared = shared_keys(index(texts, bitmap, blocks))
    released(spark)
    found = spark.createDataFrame([], "doc long, comp long")
    tried: DataFrame | None = None
    for turn in range(_MOST_STARS):
        # A hash of its own orders the documents in each round, so the keys of a group of near copies choose the same few centres.
        member = shared if turn == 0 else shared.where(F.col("c") >= _LARGE_KEY)
        member = member.select("key", "doc", "n", "c").join(found, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
        centre = member.groupBy("key").agg(F.max("c").alias("c"), F.min(F.struct(F.xxhash64(F.lit(turn), "doc").alias("h"), F.col("doc").alias("d"), F.col("n").alias("m"), F.col("comp").alias("o"))).alias("s")).select("key", "c", "s.d", "s.m", "s.o")
        pairs = _dealt(member).join(_to_all(centre), ["key", "stretch"]).where((F.col("comp") != F.col("o")) & _close("n", "m")).select(*_pair("doc", "d")).distinct()
        pairs = staged(pairs if tried is None else pairs.join(tried, ["lo", "hi"], "left_anti"))
        tried = pairs if tried is None else tried.unionByName(pairs)
        linked = links(pairs, texts)
        released(spark)
        if turn and not linked.limit(1).count():
            break
        found = components(found.select(F.col("doc").alias("lo"), F.col("comp").alias("hi")).unionByName(linked))
    # Keys that still hold several components: pairs across them, but for those tried before.
    member = shared.join(found, "doc", "left").select("key", "doc", "n", "c", F.coalesce("comp", "doc").alias("comp"))
    mixed = member.groupBy("key").agg(F.max("c").alias("c"), F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b").select("key", "c")
    rest = staged(_dealt(member).join(_to_all(mixed), ["key", "stretch"], "left_semi").drop("stretch"))
    small = rest.where(F.col("c") < _LARGE_KEY)
    other = small.select("key", F.col("doc").alias("d"), F.col("n").alias("m"), F.col("comp").alias("o"))
    across = small.join(other, "key").where((F.col("doc") < F.col("d")) & (F.col("comp") != F.col("o")) & _close("n", "m")).select(*_pair("doc", "d"))
    across = across.unionByName(across_large(rest.where(F.col("c") >= _LARGE_KEY), texts)).distinct()
    more = links(staged(across.join(tried, ["lo", "hi"], "left_anti")), texts)
    if more.limit(1).count():
        found = components(found.select(F.col("doc").alias("lo"), F.col("comp").alias("hi")).unionByName(more))
    released(spark)
    return found


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of docs."""
    mine, comps = classes(docs)
    return mine.join(comps, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is its component's smallest, with all columns; of rows that repeat a doc_id one stays. Rows with a null doc_id stay."""
    found = jaccard_components(docs).where("doc_id = component_id").select("doc_id").distinct()
    # Rows travel as one value, so that their columns may have any name and type.
    rows = docs.select("doc_id", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    kept = rows.where("doc_id is not null").join(found, "doc_id", "left_semi")
    twice = staged(kept.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id"))
    single = kept.join(twice, "doc_id", "left_anti").select("row")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.to_json("row")))
    again = kept.join(twice, "doc_id", "left_semi").select("row", first.alias("place")).where("place = 1").select("row")
    return single.unionByName(again).unionByName(rows.where("doc_id is null").select("row")).select("row.*")
