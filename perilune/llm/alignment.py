"""Operator 11: cross-tokenizer alignment of the tokens of two vocabularies by the bytes that they cover.

Both tokenizers encode a space and the text. Running sums of the tokens' byte lengths give where tokens end, the intersection of both
lists gives the common cuts, and a search in the cuts labels each token with its group, for a whole batch of documents at once.
Links are the pairs of occurrences that end together; they are expanded by repetition, since several tokens may end at one byte
if a vocabulary has tokens without bytes. Links are counted over the corpus in two shuffles, the first salted by task, after each
task has added up its own; then every document gets the counts of its links back. Counts of at least some power of two, so many that
they fit `capacity` pairs, are sent to the tasks, all others are joined: either way the result is the same.

Texts are cut into units before spaces that no token of either vocabulary spans from the left, and the ids of units are remembered;
this is checked against the vocabularies when they are loaded, and where it doesn't hold whole texts are encoded.

Null and empty texts, and those whose tokens don't spell a space and the text (those with U+2581), have no tokens: zeros and an empty
digest. Repeated rows and null doc_ids are rows of their own, and each counts in the corpus. Pairs that are tied for the highest count of a
B id are all best. A task works on about a million
characters at a time, or on one longer text, at some 60 bytes for each byte of text. Further columns
are left out. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilune.llm.common import ready, staged, trim, utf8
from perilune.llm.packing import byte_letters

#: Units whose ids a task remembers; beyond it those of the texts at hand stay.
_REMEMBERED = 400_000
#: Pairs that a task adds up before it hands them on.
_HELD = 1 << 20
#: A space behind a character that is white space to neither tokenizer: there a unit begins.
_UNIT = re.compile("(?<=[!-~\xa1-ᙿ])(?= )")
_NOT_PLAIN = re.compile("[^!-~\xa1-ᙿ] ")
#: Fixed value: how byte-level tokenizers of this kind cut a text.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_RARE = re.compile("[^\t\n\r -~\xa1-\u017f]")
_LONG = re.compile(r"[^ ]{500}| {500}")
_ENDED = re.compile("[!-~\xa1-\u167f]\\Z")
_SPANNED = re.compile("[!-~\xa1-\u167f\ufffd] ")
_SPACE = "\u2581"
_LOADED: dict[tuple[str, str], Aligner] = {}


@dataclass(frozen=True)
class Align:
    a: str  # path of a byte-level vocabulary for the tokenizers library
    b: str  # path of a sentencepiece model that adds a space
    capacity: int = 1 << 19  # pairs sent to the tasks at most
    salts: int = 16


def default_vocabularies() -> Align:
    import public_tokenizers

    return Align(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


class Aligner:
    """Ids and byte lengths of the tokens of both vocabularies."""

    def __init__(self, a: str, b: str) -> None:
        import tiktoken
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        byte = {letter: bytes([k]) for k, letter in enumerate(byte_letters())}
        names = {k: t for t, k in self.a.get_vocab().items()}
        plain = [names.get(k, "") for k in range(max(names) + 1)]
        self.a_bytes = [b"".join(byte.get(c, c.encode()) for c in t) for t in plain]
        pieces = [self.b.id_to_piece(k) for k in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(k) else p.replace(_SPACE, " ").encode() for k, p in enumerate(pieces)]
        self.a_length, self.b_length = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.a_bytes, self.b_bytes))
        self.a_names, self.b_names = (_spelt(len(t), last) for t, last in ((self.a_bytes, "|"), (self.b_bytes, ";")))
        # Units hold if neither vocabulary has a token that goes on behind one's end, and A cuts its text by the usual pattern.
        own = json.loads(self.a.to_str())
        usual = own["normalizer"] is None and (own["pre_tokenizer"] or {}).get("type") == "ByteLevel" and own["pre_tokenizer"]["use_regex"]
        self.units = usual and not any(_SPANNED.search(t.decode("utf-8", "replace")) for t in chain(self.a_bytes, self.b_bytes))
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in own["model"]["merges"]]
        first = len(plain) - len(own["added_tokens"]) - len(merges)
        in_order = usual and plain[first : first + len(merges)] == ["".join(m) for m in merges]
        self.ranks = tiktoken.Encoding("a", pat_str=_PATTERN, mergeable_ranks={t: k for k, t in enumerate(self.a_bytes[: first + len(merges)])}, special_tokens={}) if in_order else None
        self.known_a: dict[str, bytes] = {}
        self.known_b: dict[str, bytes] = {}
        self.unlike: set[str] = set()  # units that their tokens don't spell

    def _a_ids(self, text: str) -> np.ndarray:
        """Merging by rank is the faster of two equal ways, but both libraries' classes of characters are sure to agree on common ones only."""
        if self.ranks is not None and not _RARE.search(text) and not _LONG.search(text):
            return self.ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4")
        return np.array(self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn(self, new: list[str]) -> None:
        """Units that end where another may begin are encoded together and cut by their bytes, others by themselves."""
        own = [u for u in new if not _ENDED.search(u)]
        joined = [new] if not own else [[u for u in new if _ENDED.search(u)], *([u] for u in own)]
        for units in filter(None, joined):
            text = "".join(units)
            # The space that B adds is left out of an empty text alone.
            a, b = self._a_ids(text), np.array(self.b.encode(text[1:]) if len(text) > 1 else [self.b.piece_to_id(_SPACE)], dtype="<u4")
            whole = utf8(text)
            spelt = all(b"".join(map(table.__getitem__, ids.tolist())) == whole for ids, table in ((a, self.a_bytes), (b, self.b_bytes)))
            if spelt or len(units) == 1:
                ends = np.cumsum([*map(len, units)] if len(whole) == len(text) else [len(utf8(u)) for u in units])
                for known, ids, length in ((self.known_a, a, self.a_length), (self.known_b, b, self.b_length)):
                    cuts = (4 * np.searchsorted(np.cumsum(length[ids]), ends, side="right")).tolist() if spelt else [4 * len(ids)]
                    raw = ids.tobytes()
                    known.update(zip(units, map(raw.__getitem__, map(slice, [0, *cuts[:-1]], cuts)), strict=True))
                if not spelt:
                    self.unlike.add(text)
            else:
                for u in units:
                    self._learn([u])

    def forget(self) -> None:
        """Workers outlive their tasks and serve other operators next."""
        self.known_a, self.known_b, self.unlike = {}, {}, set()
        trim()

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Little-endian 32-bit ids of each text under A and B; none for a text that its tokens don't spell."""
        cut = [self._units(t) for t in texts]
        met = set(chain.from_iterable(cut))
        new = list(met.difference(self.known_a))
        if len(self.known_a) + len(new) > _REMEMBERED:  # what these texts don't need goes
            self.known_a, self.known_b = ({u: known[u] for u in met.intersection(known)} for known in (self.known_a, self.known_b))
        for k in range(0, len(new), 512):
            self._learn(new[k : k + 512])
        a, b = self.known_a.__getitem__, self.known_b.__getitem__
        out = [(b"".join(map(a, units)), b"".join(map(b, units))) for units in cut]
        if not self.unlike.isdisjoint(met):
            out = [ids if self.unlike.isdisjoint(units) or self._spells(units, *ids) else (b"", b"") for units, ids in zip(cut, out, strict=True)]
        return out

    def _units(self, text: str) -> list[str]:
        if not text:
            return []
        text = f" {text}"
        if not self.units:
            return [text]
        if _NOT_PLAIN.search(text):
            return _UNIT.split(text)
        return [f" {x}" for x in text[1:].split(" ")]

    def _spells(self, units: list[str], x: bytes, y: bytes) -> bool:
        raw = utf8("".join(units))
        return all(b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist())) == raw for table, ids in ((self.a_bytes, x), (self.b_bytes, y)))


def _spelt(n: int, last: str) -> np.ndarray:
    """Decimal ids with what follows them: at 2k a comma, at 2k + 1 the end of a group's side."""
    return np.array([f"{k}{end}" for k in range(n) for end in (",", last)], dtype=object)


def aligner(a: str, b: str) -> Aligner:
    if (a, b) not in _LOADED:
        _LOADED[a, b] = Aligner(a, b)
    return _LOADED[a, b]


@dataclass
class Groups:
    """Tokens of several documents that follow each other, cut where both vocabularies' tokens end."""

    cuts: np.ndarray  # byte offsets, ascending
    a: np.ndarray  # each A token's group
    b: np.ndarray
    a_links: np.ndarray  # places of the linked occurrences
    b_links: np.ndarray


def _new(sorted_by: np.ndarray) -> np.ndarray:
    """Whether each value differs from the one before it."""
    return np.concatenate([np.ones(min(len(sorted_by), 1), dtype=bool), sorted_by[1:] != sorted_by[:-1]])


def cut_groups(a_lengths: np.ndarray, b_lengths: np.ndarray) -> Groups:
    """Groups and links from the byte lengths of both sides' tokens, which cover the same bytes."""
    a_ends, b_ends = np.cumsum(a_lengths), np.cumsum(b_lengths)
    cuts = np.intersect1d(a_ends[_new(a_ends)], b_ends[_new(b_ends)], assume_unique=True)
    a, b = np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)
    at_a, at_b = np.flatnonzero(cuts[a] == a_ends), np.flatnonzero(cuts[b] == b_ends)  # occurrences that end at a cut, by cut
    there = np.bincount(b[at_b], minlength=len(cuts))
    times = there[a[at_a]]
    first = (np.cumsum(there) - there)[a[at_a]]
    within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return Groups(cuts, a, b, np.repeat(at_a, times), at_b[np.repeat(first, times) + within])


ALIGNED = pa.schema(
    [("part", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
     ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())]
)


def _spans(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    at = 0
    for end in ends.tolist():
        yield at, end
        at = end


def _portions(sizes: list[int], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Stretches of texts of `most` characters together, or one longer text."""
    at, held = 0, 0
    for k, size in enumerate(sizes):
        if k > at and held + size > most:
            yield at, k
            at, held = k, 0
        held += size
    if sizes:
        yield at, len(sizes)


def aligned_batch(by: Aligner, texts: list[str | None]) -> dict[str, list]:
    """Columns of ALIGNED from n_a on. pairs: ascending 64-bit A id * vocabulary of B + B id; times: 32-bit counts of each."""
    ids = by.encode([t or "" for t in texts])
    a, b = (np.frombuffer(b"".join(x[k] for x in ids), "<u4").astype(np.int64) for k in (0, 1))
    n_a, n_b = (np.array([len(x[k]) // 4 for x in ids], dtype=np.int64) for k in (0, 1))
    lengths = by.a_length[a]
    g = cut_groups(lengths, by.b_length[b])
    a_ends, b_ends = np.cumsum(n_a), np.cumsum(n_b)
    whole = np.concatenate([[0], np.cumsum(lengths)])[a_ends]  # the byte behind each document
    groups = np.searchsorted(g.cuts, whole, side="right")
    # Tokens as they are told: a group's A tokens, then its B tokens.
    n = len(g.cuts)
    a_before, b_before = np.cumsum(np.bincount(g.a, minlength=n)), np.cumsum(np.bincount(g.b, minlength=n))
    told = np.empty(len(a) + len(b), dtype=object)
    a_last, b_last = (np.roll(_new(x), -1).astype(np.int64) for x in (g.a, g.b))  # the last is the first of the next group; behind the last stands the first
    told[np.arange(len(a)) + np.concatenate([[0], b_before])[g.a]] = by.a_names[2 * a + a_last]
    told[np.arange(len(b)) + a_before[g.b]] = by.b_names[2 * b + b_last]
    digest = [hashlib.sha256("".join(told[x:y].tolist())[:-1].encode()).hexdigest() if y > x else "" for x, y in _spans(a_ends + b_ends)]
    # Distinct pairs of each document.
    doc = np.searchsorted(a_ends, g.a_links, side="right")
    pair = a[g.a_links] * len(by.b_bytes) + b[g.b_links]
    links = np.bincount(doc, minlength=len(texts))
    order = np.lexsort((pair, doc))
    doc, pair = doc[order], pair[order]
    new = np.flatnonzero(_new(pair) | _new(doc))
    times = np.diff(np.append(new, len(pair))).astype("<u4")
    held = np.searchsorted(doc[new], np.arange(len(texts)), side="right")
    return {
        "n_a": n_a.tolist(), "n_b": n_b.tolist(), "n_groups": np.diff(groups, prepend=0).tolist(), "n_links": links.tolist(), "groups_sha256": digest,
        "pairs": [pair[new[x:y]].astype("<u8").tobytes() for x, y in _spans(held)], "times": [times[x:y].tobytes() for x, y in _spans(held)],
    }


def aligned(docs: DataFrame, how: Align) -> DataFrame:
    """Staged, a row for each row of docs: part and row (its place), doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times."""
    ready(docs.sparkSession)
    a, b = how.a, how.b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, by = TaskContext.get().partitionId(), 0, aligner(a, b)
        for x in batches:
            docs, texts = x.column(0).to_pylist(), x.column(1).to_pylist()
            for i, j in _portions([len(t or "") for t in texts]):
                places = {"part": [part] * (j - i), "row": list(range(row, row + j - i)), "doc_id": docs[i:j]}
                row += j - i
                yield pa.RecordBatch.from_pydict(places | aligned_batch(by, texts[i:j]), schema=ALIGNED)
        by.forget()

    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    schema = ", ".join(f"{f.name} {kinds[f.type]}" for f in ALIGNED)
    return staged(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema))


def _flat(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _summed(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(pairs, kind="stable")
    pairs = pairs[order]
    first = np.flatnonzero(_new(pairs))
    return pairs[first], np.add.reduceat(times[order], first) if len(first) else times


def pair_counts(rows: DataFrame, how: Align) -> DataFrame:
    """pair, n, b, best (whether n is the highest of its B id, ties included): staged, over the links of all rows of `aligned`."""
    width = len(aligner(how.a, how.b).b_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() % how.salts
        waiting, size = [], 0

        def given(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal waiting, size
            pairs, times = _summed(np.concatenate([x for x, _ in waiting]), np.concatenate([y for _, y in waiting]))
            waiting, size = [(pairs, times)], 0
            if len(pairs) > least:
                for k in range(0, len(pairs), 1 << 16):
                    n = len(pairs[k : k + (1 << 16)])
                    yield pa.RecordBatch.from_pydict({"pair": pairs[k : k + n], "salt": np.full(n, salt, dtype=np.int32), "n": times[k : k + n]})
                waiting = []

        for x in batches:
            pairs = _flat(x.column(0), "<u8").astype(np.int64)
            waiting.append((pairs, _flat(x.column(1), "<u4").astype(np.int64)))
            size += len(pairs)
            if size > _HELD:
                yield from given(_HELD)
        if waiting:
            yield from given(-1)

    parts = rows.select("pairs", "times").mapInArrow(run, "pair long, salt int, n long")
    counts = staged(parts.groupBy("pair", "salt").agg(F.sum("n").alias("n")).groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.col("pair") % width))
    return staged(counts.join(counts.groupBy("b").agg(F.max("n").alias("most")), "b").select("pair", "n", "b", (F.col("n") == F.col("most")).alias("best")))


def frequent(counts: DataFrame, capacity: int) -> int:
    """The lowest power of two that at most `capacity` pairs reach. A histogram of at most 64 rows decides."""
    sizes = {r["k"]: r["many"] for r in counts.groupBy(F.floor(F.log2("n") + 1e-9).alias("k")).agg(F.count("*").alias("many")).collect()}
    k, held = 63, 0
    while k > 0 and held + sizes.get(k - 1, 0) <= capacity:
        held += sizes.get(k - 1, 0)
        k -= 1
    return 1 << k


def link_scores(rows: DataFrame, counts: DataFrame, how: Align) -> DataFrame:
    """part, row, n_best, count_sum for each row of `aligned`."""
    least = frequent(counts, how.capacity)
    sent = counts.where(F.col("n") >= least).select("pair", "n", "best").toArrow()  # at most `capacity` rows
    order = np.argsort(pairs := sent.column(0).to_numpy())
    top = rows.sparkSession.sparkContext.broadcast((pairs[order], sent.column(1).to_numpy()[order], sent.column(2).to_numpy()[order].astype(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = top.value
        for x in batches:
            if not x.num_rows:
                continue
            held = np.cumsum([len(p) // 4 for p in x.column(3).to_pylist()])
            pairs, times = _flat(x.column(2), "<u8").astype(np.int64), _flat(x.column(3), "<u4").astype(np.int64)
            at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            found = keys[at] == pairs if len(keys) else np.zeros(len(pairs), dtype=bool)
            add = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[held], prepend=0)
            known = np.where(found, times, 0)
            columns = {"part": x.column(0), "row": x.column(1), "n_best": add(known * best[at] if len(keys) else known), "count_sum": add(known * n[at] if len(keys) else known)}
            rest = [[{"pair": p, "times": t} for p, t in zip(pairs[i:j][~found[i:j]].tolist(), times[i:j][~found[i:j]].tolist(), strict=True)] for i, j in _spans(held)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, (x.column(0), x.column(1), columns["n_best"], columns["count_sum"])), pa.array(rest, pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())])))], names=[*columns, "rest"])

    scored = rows.select("part", "row", "pairs", "times").mapInArrow(run, "part long, row long, n_best long, count_sum long, rest array<struct<pair:long,times:long>>")
    if least == 1:
        return scored.drop("rest")
    scored = staged(scored)
    rare = counts.where(F.col("n") < least).select("pair", "n", "best")
    rest = scored.select("part", "row", F.inline("rest")).join(rare, "pair")
    rest = rest.select("part", "row", (F.col("times") * F.col("best").cast("long")).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    return scored.drop("rest").unionByName(rest).groupBy("part", "row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align(docs: DataFrame, how: Align) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of docs."""
    rows = aligned(docs, how)
    scores = link_scores(rows, pair_counts(rows, how), how)
    return rows.join(scores, ["part", "row"]).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def token_map(docs: DataFrame, how: Align) -> DataFrame:
    """b_id, b_piece, a_id, a_token, n: for each B id the A ids that end with it most often."""
    counts, by = pair_counts(aligned(docs, how), how), aligner(how.a, how.b)
    spark, texts = docs.sparkSession, lambda t: [(k, x.decode("utf-8", "replace")) for k, x in enumerate(t)]
    a, b = spark.createDataFrame(texts(by.a_bytes), "a_id long, a_token string"), spark.createDataFrame(texts(by.b_bytes), "b_id long, b_piece string")
    best = counts.where("best").select(F.col("b").alias("b_id"), F.floor(F.col("pair") / len(by.b_bytes)).alias("a_id"), "n")
    return best.join(a, "a_id").join(b, "b_id").select("b_id", "b_piece", "a_id", "a_token", "n")


GROUPS = "doc_id long, group long, start long, end long, a array<long>, b array<long>"


def token_groups(docs: DataFrame, how: Align) -> DataFrame:
    """The groups themselves: doc_id, group, start and end in the bytes of a space and the text, and both sides' ids."""
    ready(docs.sparkSession)
    a, b = how.a, how.b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = aligner(a, b)
        for x in batches:
            for doc, text in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
                left, right = (np.frombuffer(ids, "<u4").astype(np.int64) for ids in by.encode([text or ""])[0])
                g = cut_groups(by.a_length[left], by.b_length[right])
                n = len(g.cuts)
                sides = ([ids[i:j].tolist() for i, j in _spans(np.searchsorted(label, np.arange(n), side="right"))] for ids, label in ((left, g.a), (right, g.b)))
                start = np.concatenate([[0], g.cuts])[:-1] if n else g.cuts
                yield pa.RecordBatch.from_arrays([pa.array([doc] * n, pa.int64()), pa.array(np.arange(n)), pa.array(start), pa.array(g.cuts), *(pa.array(s, pa.list_(pa.int64())) for s in sides)], names=["doc_id", "group", "start", "end", "a", "b"])
        by.forget()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, GROUPS)
