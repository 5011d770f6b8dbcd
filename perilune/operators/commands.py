"""Commands, telemetry frames and transfer packets as fixed-width byte layouts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilune.functions.binary import pack_uint, pad_right, strip_bom, unpack_uint
from perilune.operators.framing import chunks, packet_file, read_packets

# Fields and byte widths of the telemetry frame as it is sent. The host's older view lacks the IMU temperature.
TELEMETRY = (
    ("system_time", 8), ("system_uptime", 4), ("last_cmd_time", 4), ("last_cmd_id", 1), ("payload_state", 1), ("active_cameras", 1), ("capture_mode", 1), ("cam_status_0", 1), ("cam_status_1", 1), ("cam_status_2", 1), ("cam_status_3", 1),
    ("imu_status", 1), ("imu_temperature", 2), ("tasks", 1), ("disk_usage", 1), ("latest_error", 1), ("stats_status", 1), ("ram_usage", 1), ("swap_usage", 1), ("active_cores", 1), ("cpu_load_0", 1), ("cpu_load_1", 1), ("cpu_load_2", 1),
    ("cpu_load_3", 1), ("cpu_load_4", 1), ("cpu_load_5", 1), ("gpu_freq", 1), ("cpu_temp", 1), ("gpu_temp", 1), ("vdd_in", 2), ("vdd_cpu_gpu_cv", 2), ("vdd_soc", 2),
)
HOST_TELEMETRY = tuple(f for f in TELEMETRY if f[0] != "imu_temperature")
# The 13 bytes of a start-capture command, and a tilepack image's metadata.
START_CAPTURE = (("mode", 1), ("period", 2), ("frames", 2), ("start_s", 4), ("imu_mode", 1), ("image_rate", 1), ("imu_rate_tenths", 1), ("stage", 1))
IMAGE_METADATA = (("page_id", 2), ("tiles_x", 2), ("tiles_y", 2), ("tile_w", 2), ("tile_h", 2), ("width", 2), ("height", 2), ("quality", 1))
DATA_CHUNK, CHUNK_SIZE = 0x30, 250


def encode(layout: tuple, columns: dict[str, Column]) -> Column:
    """Big-endian bytes of a layout; a field without a column is 0."""
    return F.concat(*(pack_uint(columns.get(name, F.lit(0)), width) for name, width in layout))


def decode(layout: tuple, data: Column) -> dict[str, Column]:
    """A column for each field; null if the data ends before it."""
    out, at = {}, 0
    for name, width in layout:
        out[name] = unpack_uint(data, at, width)
        at += width
    return out


def size(layout: tuple) -> int:
    return sum(width for _, width in layout)


def start_capture(data: Column, now_ms: Column) -> dict[str, Column]:
    """Fields of a start-capture command, `error` (the first fault, or null) and `start_ms`, never in the past."""
    f = decode(START_CAPTURE, data)
    error = (
        F.when(F.coalesce(F.octet_length(data), F.lit(0)) < 13, "too_short").when(~f["mode"].between(2, 5), "mode").when(f["imu_mode"] > 3, "imu_mode").when(f["stage"] > 3, "stage")
        .when(~f["frames"].between(1, 255), "frames").when((f["period"] < 1) | (f["period"] > 10800), "period").when(~f["image_rate"].between(1, 254), "image_rate").when(~f["imu_rate_tenths"].between(1, 250), "imu_rate")
    )
    return {**f, "error": error, "start_ms": F.greatest(f["start_s"] * 1000, now_ms)}


def chunk_packets(files: DataFrame, key: str, data: str, crc5) -> DataFrame:
    """key, chunk_id (from 1), last, packet: id, chunk, length, data, last flag and CRC5 over all before it, padded to 250 bytes. crc5: an Arrow-batched function."""
    rows = chunks(files, [key], data, CHUNK_SIZE - 11)
    body = F.concat(pack_uint(F.lit(DATA_CHUNK), 1), pack_uint(F.col("chunk_id"), 4), pack_uint(F.octet_length("payload"), 4), F.col("payload"), pack_uint(F.col("last").cast("int"), 1))
    rows = rows.select(key, "chunk_id", "last", body.alias("_b")).withColumn("_c", crc5("_b"))
    return rows.select(key, "chunk_id", "last", pad_right(F.concat("_b", pack_uint(F.col("_c"), 1)), CHUNK_SIZE).alias("packet"))


def check_packets(packets: DataFrame, packet: str, crc5, literal: bool = False) -> DataFrame:
    """Adds `crc_valid`. literal: the CRC is taken over the whole packet, as one implementation does, which never holds for a padded one."""
    n = unpack_uint(F.col(packet), 5, 4).cast("int")
    body = F.col(packet) if literal else F.substring(F.col(packet), F.lit(1), n + 10)
    sent = unpack_uint(F.substring(F.col(packet), n + 11, F.lit(1)), 0, 1)
    rows = packets.withColumn("_b", body).withColumn("_s", sent).withColumn("_c", crc5("_b"))
    return rows.withColumn("crc_valid", F.coalesce(F.col("_c") == F.col("_s"), F.lit(False))).drop("_b", "_s", "_c")


def packet_stream(files: DataFrame, key: str, content: str) -> DataFrame:
    """Packets of concatenated streams (7-byte header, payload), up to the first that is cut. Offsets follow from the lengths before them, so a file is walked in one task, Arrow-batched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: dict[str, list] = {c: [] for c in ("key", "page_id", "tile_idx", "frag_idx", "payload")}
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = 0
                while data and at + 7 <= len(data):
                    n = int.from_bytes(data[at : at + 2], "big")
                    if at + 7 + n > len(data):
                        break
                    for c, v in zip(rows, (name, int.from_bytes(data[at + 2 : at + 4], "big"), int.from_bytes(data[at + 4 : at + 6], "big"), data[at + 6], data[at + 7 : at + 7 + n]), strict=True):
                        rows[c].append(v)
                    at += 7 + n
            kinds = (b.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], names=[b.schema.names[0], *list(rows)[1:]])

    return files.select(key, content).mapInArrow(run, f"{key} {dict(files.dtypes)[key]}, page_id int, tile_idx int, frag_idx int, payload binary")


def json_packets(files: DataFrame, key: str, text: str) -> DataFrame:
    """key, content: JSON files as fixed packets, a byte-order mark taken off; empty files have no row."""
    rows = chunks(files.select(key, strip_bom(F.col(text).cast("binary")).alias("_b")), [key], "_b")
    return packet_file(rows, key, "chunk_id", "payload")


def json_from_packets(files: DataFrame, key: str) -> DataFrame:
    """key, text, plausible: JSON put together again; plausible if it begins with a brace or bracket."""
    parts = F.array_sort(F.collect_list(F.struct("packet_id", "payload")))
    whole = read_packets(files, key).groupBy(key).agg(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["payload"])).cast("string").alias("text"))
    return whole.withColumn("plausible", F.substring("text", 1, 1).isin("{", "["))


def parse_command(lines: DataFrame, value: str = "value") -> DataFrame:
    """cmd_id and its arguments from text lines ('12 1 0x0A'); lines that don't begin with a number have a null id."""
    parts = F.split(F.trim(F.col(value)), r"\s+")
    number = lambda x: F.when(x.startswith("0x"), F.conv(F.substring(x, 3, 16), 16, 10).try_cast("int")).otherwise(x.try_cast("int"))
    return lines.select("*", number(F.try_element_at(parts, F.lit(1))).alias("cmd_id"), F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), number).alias("arguments"))


# What a receiver answers.
ACK, NACK = 0x0A, 0x0B


def answers(checked: DataFrame, valid: str = "crc_valid") -> DataFrame:
    """Adds the answer to each packet: ACK if its CRC holds, else NACK."""
    return checked.withColumn("answer", F.when(F.col(valid), F.lit(ACK)).otherwise(F.lit(NACK)))


def radio_files(fragments: DataFrame, key: str, packet: str = "packet", order: str = "frag", framed: bool = True) -> DataFrame:
    """key, content: an image's fragments as a radio file, in order; framed as fixed packets, or one after the other. An image's fragments fit a task."""
    if framed:
        return packet_file(fragments, key, order, packet)
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("n"), F.col(packet).alias("p"))))
    return fragments.groupBy(key).agg(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["p"])).alias("content"))


def handlers(commands: DataFrame, name: str, table: dict[str, str], default: str = "INVALID") -> DataFrame:
    """Adds each command's handler from a table of names, whose few entries are part of the plan."""
    known = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return commands.withColumn("handler", F.coalesce(F.try_element_at(known, F.col(name)), F.lit(default)))
