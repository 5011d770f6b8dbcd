"""Telemetry logs (.tlm) and fixed-packet files as Spark data sources, and host-stats lines.

    spark.dataSource.register(TelemetrySource); spark.read.format("tlm").load("a.tlm,b.tlm")
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from perilune.functions.text import host_stats
from perilune.sources.files import Writer

# Fixed values of the formats.
TLM_MAGIC, PACKET_MAGIC, RECORD, PAYLOAD = b"TLM1", b"DHGEN", 242, 240


def decode_tlm(data: bytes) -> Iterator[dict]:
    """Records behind the magic: big-endian length, then compressed JSON; a cut record is an error."""
    if data[:4] != TLM_MAGIC:
        raise ValueError("not a telemetry log")
    at = 4
    while at < len(data):
        if at + 4 > len(data):
            raise ValueError("a record's length is cut")
        (n,) = struct.unpack_from(">I", data, at)
        if at + 4 + n > len(data):
            raise ValueError("a record is cut")
        yield json.loads(zlib.decompress(data[at + 4 : at + 4 + n]))
        at += 4 + n


def encode_tlm(records: list[dict], level: int = 6) -> bytes:
    parts = [zlib.compress(json.dumps(r, sort_keys=True, separators=(",", ":")).encode(), level) for r in records]
    return TLM_MAGIC + b"".join(struct.pack(">I", len(p)) + p for p in parts)


def decode_packets(data: bytes) -> list[bytes]:
    """Payloads of fixed packets; without the magic, 240-byte chunks. A bad length or a cut payload fails the file; a short last record whose payload is whole is taken."""
    if data[:5] != PACKET_MAGIC:
        return [data[k : k + PAYLOAD] for k in range(0, len(data), PAYLOAD)]
    out = []
    for at in range(5, len(data), RECORD):
        part = data[at : at + RECORD]
        n = int.from_bytes(part[:2], "big") if len(part) >= 2 else 0
        if not 0 < n <= PAYLOAD or len(part) < n + 2:
            raise ValueError(f"bad packet at {at}")
        out.append(part[2 : 2 + n])
    return out


def encode_packets(payloads: list[bytes]) -> bytes:
    if any(not 0 < len(p) <= PAYLOAD for p in payloads):
        raise ValueError("a payload must have 1 to 240 bytes")
    return PACKET_MAGIC + b"".join(len(p).to_bytes(2, "big") + p.ljust(PAYLOAD, b"\0") for p in payloads)


def _opened(path: str):
    """A file that can be read at any place, on a local disk or any store that Arrow knows."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(path)
    store, inside = fs.FileSystem.from_uri("file://" + path.removeprefix("file:").removeprefix("//") if path.startswith("file:") else path)
    return store.open_input_file(inside)


class _Files(DataSourceReader):
    """Files by path, each a task's work."""

    def __init__(self, options: dict) -> None:
        self.paths = [p for p in options.get("path", "").split(",") if p]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]


class _Logs(_Files):
    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with _opened(partition.value) as f:
            for k, (start, n) in enumerate(record_places(f, partition.value)):
                f.seek(start + 4)
                yield partition.value, k, _record(f.read(n), partition.value, start)


class _Packets(_Files):
    """Fixed records, so any range of them is a task's work."""

    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.rows = int(options.get("recordsPerPartition", 1 << 16))

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.paths:
            with _opened(path) as f:
                size, framed = f.size(), f.read(len(PACKET_MAGIC)) == PACKET_MAGIC
            first, step = (len(PACKET_MAGIC), RECORD) if framed else (0, PAYLOAD)
            n = -(-(size - first) // step)
            out += [InputPartition((path, framed, k, min(k + self.rows, n))) for k in range(0, n, self.rows)]
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path, framed, k, end = partition.value
        first, step = (len(PACKET_MAGIC), RECORD) if framed else (0, PAYLOAD)
        with _opened(path) as f:
            f.seek(first + step * k)
            data = f.read(step * (end - k))
        try:
            yield from ((path, k + i, p) for i, p in enumerate(decode_packets(PACKET_MAGIC + data if framed else data)))
        except ValueError as e:
            raise ValueError(f"{path}, records {k} to {end}: {e}") from None


class TelemetrySource(DataSource):
    """format('tlm'): path, record_id, json. A task reads a file; `read_tlm` spreads large files and reads any Hadoop path."""

    @classmethod
    def name(cls) -> str:
        return "tlm"

    def schema(self) -> str:
        return "path string, record_id int, json string"

    def reader(self, schema) -> DataSourceReader:
        return _Logs(self.options)


class PacketSource(DataSource):
    """format('fixedpackets'): path, packet_id, payload, read by ranges of records (recordsPerPartition); and a writer of files by path."""

    @classmethod
    def name(cls) -> str:
        return "fixedpackets"

    def schema(self) -> str:
        return "path string, packet_id int, payload binary"

    def reader(self, schema) -> DataSourceReader:
        return _Packets(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _PacketWriter(self.options["path"].removeprefix("file://"), overwrite)


class _PacketWriter(Writer):
    """A file's rows must be in one partition; two partitions with the same file are an error. Files appear when all tasks have ended well, and a failed job leaves none."""

    def write(self, rows: Iterator) -> WriterCommitMessage:
        held: dict[str, list] = {}
        for r in rows:
            held.setdefault(r["path"], []).append((r["packet_id"], bytes(r["payload"])))
        return super().write({"name": name, "content": encode_packets([p for _, p in sorted(parts)])} for name, parts in held.items())


def record_places(f, path: str = "", keep: bool = False) -> Iterator[tuple[int, int]]:
    """(start, length of the compressed part) of each record of a log, by its chain of lengths; a cut record is an error, or with `keep` the end."""
    size, at = f.size(), 4
    f.seek(0)
    if f.read(4) != TLM_MAGIC:
        raise ValueError(f"{path}: not a telemetry log")
    while at < size:
        f.seek(at)
        head = f.read(4)
        n = int.from_bytes(head, "big")
        if len(head) < 4 or at + 4 + n > size:
            if keep:
                return
            raise ValueError(f"{path}: the record at byte {at} is cut")
        yield at, n
        at += 4 + n


def _record(data: bytes, path: str, at: int) -> str:
    try:
        return json.dumps(json.loads(zlib.decompress(data)), sort_keys=True)
    except (ValueError, zlib.error) as e:
        raise ValueError(f"{path}: the record at byte {at} is damaged: {e}") from None


def _parts(path: str, f, size: int, keep: bool) -> Iterator[tuple]:
    """path, start, end, first record, error: stretches of about `size` bytes of whole records; with keep, a last one for what is wrong."""
    begin, end, first, k = 4, 4, 0, 0
    try:
        for at, n in record_places(f, path):
            if at - begin >= size:
                yield path, begin, at, first, None
                begin, first = at, k
            end, k = at + 4 + n, k + 1
        yield path, begin, end, first, None
    except ValueError as e:
        if not keep:
            raise
        yield path, begin, end, first, None
        yield path, end, end, k, str(e)


def read_tlm(spark: SparkSession, path: str, damaged: str = "fail", size: int = 16 << 20) -> DataFrame:
    """path, record_id, json from logs at any path that Spark reads. A log that is cut, damaged or of another kind is an error that names it.

    One task a log follows the chain of lengths, which tells where records begin whatever their bytes look like; stretches of `size` bytes are
    then unpacked and parsed by as many tasks. damaged='keep' returns the whole records of such a log instead, and one more row whose
    `error` says what follows them. Stores that Arrow can't open at a place are read a file at a time. Files without a byte are skipped, as Spark doesn't list them."""
    import io

    import pyarrow as pa
    from pyarrow import fs

    if damaged not in ("fail", "keep"):
        raise ValueError("damaged must be 'fail' or 'keep'")
    keep = damaged == "keep"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tlm").load(path)
    kinds = "path string, start long, end long, first long, error string"
    out = "path string, record_id int, json string, error string"

    def known(name: str) -> bool:
        try:
            return bool(fs.FileSystem.from_uri(name if "://" in name else "file://" + name.removeprefix("file:")))
        except (pa.ArrowInvalid, NotImplementedError, OSError):
            return False

    def table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*zip(*rows, strict=True)] or [()] * len(schema), schema, strict=True)], schema=schema)

    places = pa.schema([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("first", pa.int64()), ("error", pa.string())])
    records = pa.schema([("path", pa.string()), ("record_id", pa.int32()), ("json", pa.string()), ("error", pa.string())])

    def found(f, name: str, start: int, end: int, first: int, error: str | None) -> Iterator[pa.RecordBatch]:
        f.seek(start)
        data, at, rows = f.read(end - start), 0, []
        try:
            while at < len(data):
                n = int.from_bytes(data[at : at + 4], "big")
                rows.append((name, first + len(rows), _record(data[at + 4 : at + 4 + n], name, start + at), None))
                at += 4 + n
        except ValueError as e:
            if not keep:
                raise
            error = str(e)
        if error:
            rows.append((name, None, None, error))
        for k in range(0, len(rows), 4096):
            yield table(rows[k : k + 4096], records)

    def index(batches):
        for b in batches:
            for name in b.column(0).to_pylist():
                with _opened(name) as f:
                    yield table([*_parts(name, f, size, keep)], places)

    def unpack(batches):
        for b in batches:
            for row in b.to_pylist():
                with _opened(row["path"]) as f:
                    yield from found(f, row["path"], row["start"], row["end"], row["first"], row["error"])

    def whole(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                f = pa.BufferReader(data or b"")
                for part in _parts(name, f, 1 << 62, keep):
                    yield from found(io.BytesIO(data or b""), *part)

    first = files.select("path").first()
    if first is None or known(first[0]):
        rows = files.select("path").mapInArrow(index, kinds).repartition("path", "start").mapInArrow(unpack, out)
    else:
        rows = files.select("path", "content").mapInArrow(whole, out)
    return rows if keep else rows.drop("error")


def write_tlm(records: DataFrame, path: str, log: str, level: int = 6) -> None:
    """One log for each value of column `log`, its other columns the records in order of all of them, in a folder that all machines see. A log's records fit a task, as the format is one stream."""
    import pyarrow as pa

    from perilune.sources.files import write_files

    rest = [c for c in records.columns if c != log]
    held = records.groupBy(F.col(log).cast("string").alias("name")).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("records"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"name": pa.array([f"{n}.tlm" for n in b.column(0).to_pylist()], pa.string()), "content": pa.array([encode_tlm(r, level) for r in b.column(1).to_pylist()], pa.binary())})

    write_files(held.mapInArrow(pack, "name string, content binary"), path)


def write_ndjson(logs: DataFrame, path: str) -> None:
    """Records of logs (`read_tlm`) as lines of JSON, as they are, a folder for each log."""
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]*?)(?:\.tlm)?$", 1), "[^A-Za-z0-9_.-]+", "_")
    logs.repartition("path").sortWithinPartitions("path", "record_id").select(name.alias("log"), F.col("json").alias("value")).write.partitionBy("log").text(path)


def read_host_stats(spark: SparkSession, path: str) -> DataFrame:
    """Fields of host-stats lines; a field that a line lacks is null."""
    lines = spark.read.text(path)
    return lines.select("value", *(c.alias(k) for k, c in host_stats(F.col("value")).items()))
