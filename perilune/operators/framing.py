"""Operators on byte streams: chunks, fixed packets, tiles and their reassembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilune.functions.binary import PACKET_PAYLOAD, PACKET_RECORD, TILE_PAYLOAD, pack_uint, pad_right, unpack_uint

# Fixed value: what a fixed-packet file begins with.
MAGIC = b"DHGEN"


def chunks(df: DataFrame, keys: list[str], data: str, size: int = PACKET_PAYLOAD) -> DataFrame:
    """chunk_id (from 1), payload, last. Empty data has no chunk."""
    n = F.ceil(F.octet_length(data) / size).cast("int")
    rows = df.where(F.octet_length(data) > 0).select(*keys, data, n.alias("_n"), F.explode(F.sequence(F.lit(1), n)).alias("chunk_id"))
    return rows.select(*keys, "chunk_id", F.substring(F.col(data), (F.col("chunk_id") - 1) * size + 1, F.lit(size)).alias("payload"), (F.col("chunk_id") == F.col("_n")).alias("last"))


def packet_record(payload: Column) -> Column:
    """A fixed packet: big-endian length and the payload padded to 240 bytes."""
    return F.concat(pack_uint(F.octet_length(payload), 2), pad_right(payload, PACKET_PAYLOAD))


def packet_file(packets: DataFrame, key: str, order: str, payload: str) -> DataFrame:
    """key, content: the magic and all packets of a file, whose size bounds the group."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("n"), packet_record(F.col(payload)).alias("p"))))
    return packets.groupBy(key).agg(F.aggregate(parts, F.lit(bytearray(MAGIC)).cast("binary"), lambda a, x: F.concat(a, x["p"])).alias("content"))


def read_packets(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """key, packet_id, payload. Without the magic a file is raw 240-byte chunks. A file with a length of 0 or over 240, or a last packet cut inside its payload, has no rows."""
    framed = F.substring(content, 1, len(MAGIC)) == F.lit(bytearray(MAGIC)).cast("binary")
    size = F.octet_length(content)
    step, start = F.when(framed, PACKET_RECORD).otherwise(PACKET_PAYLOAD), F.when(framed, len(MAGIC)).otherwise(0)
    n = F.ceil((size - start) / step).cast("int")
    rows = files.where(size > start).select(key, content, framed.alias("_f"), F.explode(F.sequence(F.lit(0), n - 1)).alias("packet_id"), step.alias("_s"), start.alias("_o"))
    part = F.substring(F.col(content), F.col("_o") + F.col("packet_id") * F.col("_s") + 1, F.col("_s"))
    length = F.when(F.col("_f"), unpack_uint(part, 0, 2)).otherwise(F.octet_length(part))
    rows = rows.select(key, "packet_id", "_f", part.alias("_p"), length.alias("_n"))
    bad = F.col("_f") & (F.col("_n").isNull() | (F.col("_n") == 0) | (F.col("_n") > PACKET_PAYLOAD) | (F.octet_length("_p") < F.col("_n") + 2))
    broken = rows.where(bad).select(key).distinct()
    return rows.join(broken, key, "left_anti").select(key, "packet_id", F.substring(F.col("_p"), F.when(F.col("_f"), 3).otherwise(1), F.col("_n").cast("int")).alias("payload"))


def file_chunk(content: Column, start: Column, length: Column) -> Column:
    """A stretch of bytes, cut at the end; null if start lies beyond it."""
    return F.when((start >= 0) & (start < F.octet_length(content)), F.substring(content, (start + 1).cast("int"), length.cast("int")))


def tile_grid(width: Column, height: Column, tile_width: int = 64, tile_height: int = 32) -> Column:
    """Tiles that cover an image; those at the edges are padded."""
    return (F.ceil(width / tile_width) * F.ceil(height / tile_height)).cast("int")


def tile_fragments(tiles: DataFrame, keys: list[str], data: str, page: int = 1) -> DataFrame:
    """Fragments of at most 233 bytes, each behind its 7-byte header (payload size, page, tile, fragment)."""
    rows = chunks(tiles, keys, data, TILE_PAYLOAD)
    frag = F.col("chunk_id") - 1
    header = F.concat(pack_uint(F.octet_length("payload"), 2), pack_uint(F.lit(page), 2), pack_uint(F.col(keys[-1]), 2), pack_uint(frag, 1))
    return rows.select(*keys, frag.alias("frag_idx"), F.concat(header, "payload").alias("packet"))


def decode_fragment(packet: Column) -> dict[str, Column]:
    size = unpack_uint(packet, 0, 2)
    return {"payload_size": size, "page_id": unpack_uint(packet, 2, 2), "tile_idx": unpack_uint(packet, 4, 2), "frag_idx": unpack_uint(packet, 6, 1), "payload": F.substring(packet, F.lit(8), size.cast("int"))}


def tile_status(fragments: DataFrame, key: str, tile: str, frag: str, expected: DataFrame) -> DataFrame:
    """Per key how many tiles are complete, partial (a number below the largest is missing) or missing. expected: key, tiles."""
    per = fragments.groupBy(key, tile).agg((F.count_distinct(frag) == F.max(frag) + 1).alias("whole"))
    seen = per.groupBy(key).agg(F.count_if("whole").alias("complete"), F.count_if(~F.col("whole")).alias("partial"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return expected.join(seen, key, "left").select(key, zero("complete"), zero("partial"), (F.col("tiles") - F.coalesce("complete", F.lit(0)) - F.coalesce("partial", F.lit(0))).cast("long").alias("missing"))


def directory_summary(files: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Count, bytes and newest path of a table of files (path, length, modificationTime), of each folder if keys name it."""
    return files.groupBy(*(keys or [])).agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.max_by("path", F.struct("modificationTime", "path")).alias("newest"))


def pulled(files: DataFrame, keys: list[str], content: str, first: Column, n: int = 3, size: int = PACKET_PAYLOAD) -> DataFrame:
    """keys, packet, payload, no_more: a batch of n packets of each file from a number on (from 1), as a receiver asks for them."""
    rows = files.select(*keys, F.col(content).alias("_c"), F.explode(F.sequence(first, first + n - 1)).alias("packet"))
    part = file_chunk(F.col("_c"), (F.col("packet") - 1) * size, F.lit(size))
    return rows.select(*keys, "packet", part.alias("payload"), part.isNull().alias("no_more"))
