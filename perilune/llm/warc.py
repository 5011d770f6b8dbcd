"""Operator 3: WARC archives, written by Spark's text writer and read back with boundary-chain verification.

Writing: one record a row, payload the html in UTF-8 (null: empty) behind HTTP headers. Of rows with equal payloads of at least
`least_revisit` bytes the one with the smallest page_id is a response and the others are revisits without a block; smaller
ones are all responses. The record separator is the writer's line separator, so records are never held together in a task.
Rows that repeat a page_id with the same payload are equal records: each is the response. A null page_id is a revisit if
another page has its payload. Urls and html may be of any length; other columns are left out.

Reading: Spark's text reader deals files out by bytes, cut where a record may begin, so a split is one task's work whatever the file's size.

1. Tasks emit candidates: every place in a split with a record's magic, the offset at which its successor would begin, and, by
   pointer jumping inside the split, the offset at which the chain from there leaves the split.
2. Splits' lengths give offsets in the file. Candidates that a chain can enter a split by are joined with those that lead there, and
   pointer jumping from the file's start over them, one or a few a split, tells where the chain enters each split.
   Magic inside a payload isn't reached. A chain that doesn't end where its file does is an error.
3. Tasks read the splits again from there. What a split holds of a record that goes on in the next one is put together by a
   join on narrow keys, one record a split at most.

Compressed files (.gz, of one member or many) are one split each. Empty files have no records.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perilune.llm.common import ready, shared_dir, staged

# Fixed values of the WARC format.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_GAP = "\r\n\r\n"
_LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*(\d{1,15})(?=\r\n|$)", re.IGNORECASE)
_SIGN = b"WARC/1."  # files are cut here: it can't overlap itself, so splits agree on where it stands
#: Tables of so many narrow rows (under 200 bytes each) may be sent to every task; larger ones are joined by a shuffle.
_SENT_ROWS = 1 << 17

RECORD = pa.schema([
    ("path", pa.string()), ("start", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_()),
])
SCHEMA = "path string, start long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"


def _small(df: DataFrame) -> DataFrame:
    """Sent to every task if its rows, counted, are few."""
    return F.broadcast(df) if df.count() <= _SENT_ROWS else df


def write_warc(pages: DataFrame, path: str, least_revisit: int = 100) -> None:
    """Writes pages (page_id, url, html) as uncompressed WARC files below path."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "").alias("url"), html.alias("html"), F.octet_length(html).alias("n"), F.sha2(html.cast("binary"), 256).alias("digest"))
    # Only digests that occur again, with their smallest page: counted before the shuffle, so copies cost a row for each task.
    first = staged(rows.where(F.col("n") >= least_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first"))
    marked = rows.join(_small(first), "digest", "left").withColumn("again", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(_GAP))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("again"), "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), name("page_id"), F.lit(">\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\nX-Payload-Length: "), F.col("n").cast("string"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\n"),
    )
    record = F.when(F.col("again"), F.concat(head, F.lit(f"WARC-Profile: {_PROFILE}\r\nWARC-Refers-To: <urn:page:"), name("first"), F.lit(f">\r\nContent-Length: 0{_GAP}"))).otherwise(
        F.concat(head, F.lit("Content-Length: "), (F.length(http) + F.col("n")).cast("string"), F.lit(_GAP), http, F.col("html"))
    )
    marked.select(record.alias("value")).write.option("lineSep", _GAP).option("compression", "none").text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """path, block (the split's first byte), size (the file's), piece: what stands between two signs of a record, in order within a split."""
    lines = spark.read.format("text").option("lineSep", _SIGN.decode()).load(path)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("piece"))


class _Candidates:
    """(offset, successor's offset) of all in a split's stream that looks like a record's header: from the magic to the first blank line, with a length."""

    def __init__(self) -> None:
        self.found: list[tuple[int, int]] = []
        self.total = 0  # bytes of the split so far
        self.open: list[int] = []  # candidates whose header goes on, and what is read since the first of them
        self.read: list[bytes] = []

    def add(self, head: bytes, n: int, signed: bool) -> None:
        """A piece of n bytes that begins with `head`: up to its first blank line, or all of it. signed: the sign stands before it."""
        at, closed, sign = self.total, len(head) < n, _SIGN if signed else b""
        self.total += len(sign) + n
        if signed and head[:3] in (b"1\r\n", b"0\r\n"):
            self.open.append(at)
        if not self.open:
            return
        self.read.append(sign + head)
        if not closed:
            return
        data, first = b"".join(self.read), self.open[0]
        lengths, k = [(first + x.start(), int(x[1])) for x in _LENGTH.finditer(data)], 0
        for start in self.open:
            while k < len(lengths) and lengths[k][0] < start:
                k += 1
            if k < len(lengths):
                self.found.append((start, first + len(data) + 4 + lengths[k][1] + 4))
        self.open, self.read = [], []


def _jumps(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The place of each candidate's successor; len(at) where it is none."""
    place = np.searchsorted(at, after)
    n = len(at)
    place[(place == n) | (at[np.minimum(place, n - 1)] != after)] = n
    return place


def exits(at: np.ndarray, after: np.ndarray, total: int) -> np.ndarray:
    """Where the chain from each candidate leaves a split of `total` bytes, by pointer jumping: each round doubles the step. -1: it ends inside."""
    if not len(at):
        return after
    jump = np.append(_jumps(at, after), len(at))
    last = np.arange(len(at) + 1)  # the last candidate known on the chain
    while (jump[:-1] < len(at)).any():
        last = np.where(jump < len(at), last[np.minimum(jump, len(at))], last)
        jump = jump[jump]
    out = after[last[:-1]]
    return np.where(out >= total, out, -1)


def reachable(at: np.ndarray, after: np.ndarray, start: int = 0) -> np.ndarray:
    """Which candidates the chain from start reaches, by pointer jumping: each round doubles the known stretch of the chain."""
    n = len(at)
    seen = np.zeros(n + 1, dtype=bool)
    if n == 0:
        return seen[:n]
    jump = np.append(_jumps(at, after), n)
    seen[:n] = at == start
    while True:
        more = seen.copy()
        more[jump[seen]] = True
        if (more == seen).all():
            return seen[:n]
        seen, jump = more, jump[jump]


def _scan(pieces: DataFrame) -> DataFrame:
    """path, block, size, start, leaves: a row for each candidate, offsets from the split's begin; and one for each split (start -1, leaves its length; -2 if a header goes on behind it)."""

    def rows(key: tuple, c: _Candidates) -> pa.RecordBatch:
        pairs = np.array(c.found, dtype=np.int64).reshape(-1, 2)
        leaves = exits(pairs[:, 0], pairs[:, 1], c.total)
        alive = leaves >= 0
        start, leaves = np.append(pairs[alive, 0], -2 if c.open else -1), np.append(leaves[alive], c.total)
        return pa.RecordBatch.from_pydict({"path": pa.array([key[0]] * len(start), pa.string()), "block": np.full(len(start), key[1]), "size": np.full(len(start), key[2]), "start": start, "leaves": leaves})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = None, _Candidates()
        for b in batches:
            for path, block, size, n, head in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fresh = (path, block, size) != key
                if fresh:
                    if key is not None:
                        yield rows(key, now)
                    key, now = (path, block, size), _Candidates()
                now.add(head, n, not fresh or block > 0)
        if key is not None:
            yield rows(key, now)

    # Of most pieces only a header reaches Python.
    head = F.substring_index("piece", _GAP, 1).cast("binary")
    return pieces.select("path", "block", "size", F.octet_length("piece").cast("long").alias("n"), head.alias("head")).mapInArrow(run, "path string, block long, size long, start long, leaves long")


def _entries(scan: DataFrame) -> DataFrame:
    """path, block, base, entry: of each split its offset in the file and, in it, the first record on the file's chain (null: a record covers it)."""
    splits = scan.where("start < 0").select("path", "block", "size", F.col("leaves").alias("total"))
    base = F.sum("total").over(Window.partitionBy("path").orderBy("block")) - F.col("total")
    splits = staged(splits.withColumn("base", base))
    found = scan.where("start >= 0").join(_small(splits.select("path", "block", "base")), ["path", "block"])
    found = found.select("path", "block", "start", (F.col("base") + F.col("start")).alias("at"), (F.col("base") + F.col("leaves")).alias("after"))
    led = found.select("path", F.col("after").alias("at")).distinct().unionByName(splits.select("path", F.lit(0).cast("long").alias("at")).distinct()).distinct()
    doors = found.join(led, ["path", "at"], "left_semi").select("path", "block", "start", "at", "after")
    # A file's end is one row more, so that a file without candidates isn't overlooked.
    ends = splits.groupBy("path").agg(F.sum("total").alias("total"), F.max("size").alias("size"))
    end = F.when(F.col("path").endswith(".gz"), F.col("total")).otherwise(F.col("size"))
    doors = doors.unionByName(ends.select("path", F.lit(-1).cast("long").alias("block"), F.lit(-1).cast("long").alias("start"), F.lit(-1).cast("long").alias("at"), end.alias("after")))

    def follow(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at", ignore_index=True)
        path, size, rows = rows["path"].iloc[0], int(rows["after"].iloc[0]), rows.iloc[1:]
        rows = rows[reachable(rows["at"].to_numpy(), rows["after"].to_numpy())]
        if (int(rows["after"].iloc[-1]) if len(rows) else 0) != size:
            raise ValueError(f"the records of {path} end before its {size} bytes do")
        return rows[["path", "block", "start"]]

    chain = doors.groupBy("path").applyInPandas(follow, "path string, block long, start long").withColumnRenamed("start", "entry")
    return staged(splits.select("path", "block", "base").join(chain, ["path", "block"], "left"))


def _record(path: str, start: int, head: bytes, block: bytes) -> dict:
    """One row from a record's header and block; intact: length and digest agree with the header's."""
    fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:] if b": " in x)
    digest = fields.get(b"WARC-Payload-Digest", b"").decode("utf-8", "replace").removeprefix("sha256:")
    page = lambda field: int(m[1]) if (m := re.search(rb"<urn:page:(-?\d+)>", fields.get(field, b""))) else None
    if fields.get(b"WARC-Type") == b"revisit":
        stated = fields.get(b"X-Payload-Length", b"")
        n, found, intact = int(stated) if stated.isdigit() else -1, digest, not block
    else:
        cut = block.find(b"\r\n\r\n") + 4 if fields.get(b"Content-Type", b"").startswith(b"application/http") else 0
        found = hashlib.sha256(memoryview(block)[cut:]).hexdigest()
        n, intact = len(block) - cut, found == digest
    return {"path": path, "start": start, "page_id": page(b"WARC-Record-ID"), "payload_bytes": n, "payload_digest": found, "record_type": fields.get(b"WARC-Type", b"").decode("utf-8", "replace"), "refers_to": page(b"WARC-Refers-To"), "intact": intact}


def _length(head: bytes) -> int:
    return int(_LENGTH.search(head)[1])


class _Stretch:
    """What is read of one split: whole records, and the bytes of records that begin before it or end behind it."""

    def __init__(self, path: str, block: int, base: int, entry: int | None) -> None:
        self.path, self.block, self.base, self.entry = path, block, base, entry
        self.held: list[bytes] = []
        self.size = self.need = self.at = 0  # bytes held, bytes needed to go on, offset of the first one held
        self.begun = False
        self.cuts: list[dict] = []

    def _cut(self, data: bytes, head: bool) -> None:
        self.cuts.append({"path": self.path, "block": self.block, "start": self.base + self.at if head else None, "part": data})

    def add(self, data: bytes) -> list[dict]:
        self.held.append(data)
        self.size += len(data)
        if self.size < self.need or self.entry is None or not self.begun and self.size < self.entry:
            return []
        data, rows, pos = b"".join(self.held), [], 0
        if not self.begun:
            self.begun, pos = True, self.entry
            if pos:
                self._cut(data[:pos], False)
        while (end := data.find(b"\r\n\r\n", pos)) >= 0:
            head = data[pos:end]
            after = end + 4 + _length(head) + 4
            if after > len(data):
                break
            rows.append(_record(self.path, self.base + self.at + pos, head, data[end + 4 : after - 4]))
            pos = after
        self.need = after - pos if end >= 0 else 0
        self.held, self.size, self.at = [data[pos:]], len(data) - pos, self.at + pos
        return rows

    def close(self) -> list[dict]:
        """What is left: the head of a record that goes on, or, where no record begins in the split, all of it."""
        data = b"".join(self.held)
        if data:
            self._cut(data, self.begun)
        return self.cuts


CUT = pa.schema([*RECORD, ("block", pa.int64()), ("part", pa.binary())])


@contextmanager
def _whole_files(spark: SparkSession, whole: bool) -> Iterator[None]:
    """Meanwhile, files aren't split."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes") if whole else ()
    old = {k: spark.conf.get(k) for k in names}
    try:
        for k in names:
            spark.conf.set(k, str(1 << 50))
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record that the chain of its file reaches."""
    ready(spark)
    scan, whole = staged(_scan(_pieces(spark, path))), False
    if scan.where("start = -2").limit(1).count():  # a header that holds the sign itself was cut there: rare
        whole = True
        with _whole_files(spark, whole):
            scan = staged(_scan(_pieces(spark, path)))
        # Headers that are still open run into their file's end.
    entries = _entries(scan)

    def rows(found: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{c: r.get(c) for c in CUT.names} for r in found], schema=CUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Stretch | None = None
        for b in batches:
            paths, blocks, bases, entry, piece = (c.to_pylist() for c in b.columns)
            found: list[dict] = []
            held: list[bytes] = []
            for k in range(b.num_rows):
                fresh = now is None or (paths[k], blocks[k]) != (now.path, now.block)
                if fresh:
                    if now is not None:
                        found += now.add(b"".join(held)) + now.close()
                    now, held = _Stretch(paths[k], blocks[k], bases[k], entry[k]), []
                held += (b"" if fresh and blocks[k] == 0 else _SIGN, piece[k])
            if now is not None:
                found += now.add(b"".join(held))
            if found:
                yield rows(found)
        if now is not None and (left := now.close()):
            yield rows(left)

    pieces = _pieces(spark, path).select("path", "block", F.col("piece").cast("binary").alias("piece"))
    if entries.count() <= _SENT_ROWS:
        placed = pieces.join(F.broadcast(entries), ["path", "block"])
    else:  # the shuffle loses the order
        placed = pieces.withColumn("at", F.monotonically_increasing_id()).join(entries, ["path", "block"]).sortWithinPartitions("path", "block", "at")
    schema = SCHEMA + ", block long, part binary"
    with _whole_files(spark, whole):
        found = staged(placed.select("path", "block", "base", "entry", "piece").mapInArrow(run, schema))

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        data = b"".join(rows.sort_values("block")["part"])
        end = data.find(b"\r\n\r\n")
        length = _length(data[:end])
        return pd.DataFrame([_record(rows["path"].iloc[0], int(rows["first"].iloc[0]), data[:end], data[end + 4 : end + 4 + length])])[RECORD.names].astype({"page_id": "Int64", "refers_to": "Int64"})

    # A part without a record's start belongs to the record that began last before it.
    cut = found.where("part is not null").withColumn("first", F.last("start", ignorenulls=True).over(Window.partitionBy("path").orderBy("block", F.col("start").isNotNull())))
    joined = cut.select("path", "block", "first", "part").groupBy("path", "first").applyInPandas(join, SCHEMA)
    return found.where("part is null").select(*RECORD.names).unionByName(joined)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages to a fresh folder that all machines share and reads the archives back."""
    spark = pages.sparkSession
    path = shared_dir(spark)
    write_warc(pages, path)
    return read_warc(spark, path)
