"""Operator 5: best-fit packing planned over a histogram of lengths.

Texts are tokenised once; each becomes its ids and an end id, cut into pieces only where it is longer than a sequence. The plan
needs the count of pieces of each length alone: best-fit decreasing places whole groups of equal pieces into groups of
equally filled sequences, so it works on a few thousand numbers however many documents there are. Every piece then takes
the planned slot of its rank within its length; ranks come from counts for each writing task and length, so pieces
are never sorted or gathered by length.

Null and empty texts are one piece with the end id alone. Repeated rows are pieces of their own. Further columns are left out.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perilune.llm.common import ready, staged, trim, utf8

#: Pieces, and odd words, whose ids a task remembers; beyond it the memory starts anew.
_REMEMBERED = 500_000
_KEPT = 100_000
_ENCODERS: dict[str, WordEncoder] = {}
#: Control characters, anything beyond U+017F, and what may be a special token.
_ODD = re.compile("[\x00-\x08\x0e-\x1f\x7f-\xa0\xad\u0130\u0180-\U0010ffff]|<\\|")
#: How byte-level tokenizers spell bytes: printable ones as themselves, the others from U+0100 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}


def byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies spell each byte."""
    return [chr(_BYTE_LETTERS.get(k, k)) for k in range(256)]


class WordEncoder:
    """ids of whole texts from those of their words: the tokenizer drops white space and no token spans it.

    Texts of Latin letters, digits and signs are lowered and cut into the tokenizer's pieces here, and each new piece goes through
    the same merges without the steps that such pieces don't need. Other texts are taken word by word, and words with any
    other character go through the tokenizer as it is.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        bare = json.loads(self.tokenizer.to_str())
        # The tokenizer's own pattern, its classes spelt out for the characters of plain texts.
        pattern = bare["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        for name in "LN":
            pattern = pattern.replace(rf"\p{{{name}}}", "".join(re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c))[0] == name))
        self.pattern = re.compile(pattern)
        bare |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.merges = Tokenizer.from_str(json.dumps(bare))
        self.suffix = bare["model"]["end_of_word_suffix"]
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[k for t, k in vocabulary.items() if t.endswith(self.suffix)]] = True
        self.known: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece_ids(self, new: list[str]) -> None:
        spelt = [x if x.isascii() else x.encode().decode("latin-1").translate(_BYTE_LETTERS) for x in new]
        found = self.merges.encode_batch_fast([" ".join(spelt[i : i + 500]) for i in range(0, len(spelt), 500)], add_special_tokens=False)
        ids = np.array([k for e in found for k in e.ids], dtype="<u4")
        data, at = ids.tobytes(), 0
        for x, end in zip(new, (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist(), strict=True):
            self.pieces[x], at = data[at:end], end

    def _learn(self, new: set[bytes]) -> None:
        cut: dict[bytes, list[str]] = {}
        odd: list[tuple[bytes, str]] = []
        for w in new:
            x = w.decode("utf-8", "replace")
            if _ODD.search(x):
                odd.append((w, x))
            else:
                cut[w] = [x.lower()] if x.isalpha() else self.pattern.findall(x.lower())
        if len(self.pieces) > _REMEMBERED:
            self.pieces.clear()
        self._piece_ids(list({p for ps in cut.values() for p in ps}.difference(self.pieces)))
        find = self.pieces.__getitem__
        for w, ps in cut.items():
            self.known[w] = b"".join(map(find, ps))
        for (w, _), e in zip(odd, self.tokenizer.encode_batch([x for _, x in odd], add_special_tokens=False), strict=True):
            self.known[w] = np.array(e.ids, dtype="<u4").tobytes()

    def forget(self) -> None:
        """Workers outlive their tasks and serve other operators next: keep the pieces met first, which are the common ones, and give back the rest."""
        self.known.clear()
        for piece in list(self.pieces)[_KEPT:]:
            del self.pieces[piece]
        self.pieces = dict(self.pieces)  # a dict that shrank keeps its size
        trim()

    def encode(self, texts: list) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        raw = [t or "" for t in texts]
        plain = [not _ODD.search(t) for t in raw]
        parts: list[list] = [self.pattern.findall(t.lower()) if p else utf8(t).split() for t, p in zip(raw, plain, strict=True)]
        if len(self.known) > _REMEMBERED:
            self.known.clear()
        self._learn({w for words, p in zip(parts, plain, strict=True) if not p for w in words}.difference(self.known))
        if len(self.pieces) > _REMEMBERED:
            self.pieces.clear()
        self._piece_ids(list(set(chain.from_iterable(x for x, p in zip(parts, plain, strict=True) if p)).difference(self.pieces)))
        word, piece = self.known.__getitem__, self.pieces.__getitem__
        return [b"".join(map(piece if p else word, x)) for x, p in zip(parts, plain, strict=True)]


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("part", pa.int64()), ("local_rank", pa.int64())])


def tokenize(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 1) -> DataFrame:
    """Staged pieces: doc_id, piece, start, length, ids (little-endian 32-bit), part and local_rank (rank within part and length)."""
    ready(docs.sparkSession)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            rows: dict[str, list] = {k: [] for k in PIECES.names}
            for doc, ids in zip(b.column(0).to_pylist(), encoder(tokenizer).encode(b.column(1).to_pylist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    piece = ids[at : at + 4 * size]
                    n = len(piece) // 4
                    rank = seen.get(n, 0)
                    seen[n] = rank + 1
                    for name, value in zip(PIECES.names, (doc, k, at // 4, n, piece, part, rank), strict=True):
                        rows[name].append(value)
            yield pa.RecordBatch.from_pydict(rows, schema=PIECES)
        encoder(tokenizer).forget()

    return staged(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary, part long, local_rank long"))


@dataclass
class Plan:
    """Blocks of slots, by length and first rank: the rank's place in its block gives the sequence and the offset."""

    key: np.ndarray  # length << 40 | first rank
    sequence: np.ndarray
    offset: np.ndarray
    each: np.ndarray  # pieces that one sequence takes in a row
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.key, (length << 40) | rank, side="right") - 1
        into = rank - (self.key[k] & ((1 << 40) - 1))
        return self.sequence[k] + into // self.each[k], self.offset[k] + (into % self.each[k]) * length


def plan_best_fit(counts: dict[int, int], size: int = 4096) -> Plan:
    """Best-fit decreasing over counts. A group: (first sequence, how many), all with the same room; each step splits at most one group in three."""
    room: list[int] = []  # rooms of which there are groups, ascending
    groups: dict[int, list[tuple[int, int]]] = {}
    blocks: list[tuple[int, int, int, int]] = []
    total = 0

    def add(left: int, first: int, many: int) -> None:
        if many and left:
            if left not in groups:
                groups[left] = []
                insort(room, left)
            groups[left].append((first, many))

    for length in sorted(counts, reverse=True):
        n, rank = counts[length], 0
        while n:
            k = bisect_left(room, length)
            if k < len(room):
                space = room[k]
                first, many = groups[space].pop()
                if not groups[space]:
                    del groups[space]
                    room.pop(k)
            else:
                space, first, many = size, total, -(-n // (size // length))
                total += many
            each = space // length  # the sequence just filled is the tightest fit for the next piece too
            full = min(many, n // each)
            if full:
                blocks.append((length << 40 | rank, first, size - space, each))
                add(space - each * length, first, full)
                rank, n = rank + full * each, n - full * each
            if full < many and 0 < n < each:
                blocks.append((length << 40 | rank, first + full, size - space, n))
                add(space - n * length, first + full, 1)
                full, rank, n = full + 1, rank + n, 0
            add(space, first + full, many - full)
    columns = np.array(sorted(blocks), dtype=np.int64).reshape(-1, 4).T
    return Plan(*columns, sequences=total)


def pack(pieces: DataFrame, size: int = 4096) -> DataFrame:
    """The pieces' columns but part and local_rank, and sequence_id, offset. The plan's size is bounded by `size`, not by the rows."""
    spark = pieces.sparkSession
    ready(spark)
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    offsets = staged(counts.select("length", "part", "n", (upto - F.col("n")).alias("before")))
    plan = plan_best_fit({r.length: r.n for r in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect()}, size)
    # A part's offsets travel as one array, by length: a row a task, a small share of what a row for each length takes in a hash table.
    held = offsets.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("length", "before"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(size).cast("long")), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0).cast("long")))
    rows = pieces.join(staged(held.select("part", dense.alias("before"))), "part").withColumn("rank", F.get("before", F.col("length").cast("int")) + F.col("local_rank"))
    kept = [c for c in pieces.columns if c not in ("part", "local_rank")]
    rows = rows.select(*kept, "rank")
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = lambda name, b=b: b.column(b.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
            sequence, offset = plan.place(at("length"), at("rank"))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*b.schema.names[:-1], "sequence_id", "offset"])

    return rows.mapInArrow(partial(run, plan=plan), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves; one has `size` ids at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
