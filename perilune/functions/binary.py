"""Big-endian fields, padding, CRC and message frames as expressions over binary columns."""

from __future__ import annotations

from collections.abc import Iterable
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the link's formats.
PACKET_PAYLOAD, PACKET_RECORD = 240, 242
MESSAGE_DATA, MESSAGE_SIZE = 245, 247
TILE_PAYLOAD = 233


def pack_uint(value: Column, width: int) -> Column:
    """Big-endian, `width` bytes; the value must fit."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * width, "0"))


def unpack_uint(data: Column, start: int, width: int) -> Column:
    """A big-endian number at a 0-based place; null if data ends before it."""
    part = F.substring(data, start + 1, width)
    return F.when(F.octet_length(part) == width, F.conv(F.hex(part), 16, 10).cast("long"))


def pad_right(data: Column, size: int) -> Column:
    """Cut or zero-padded to size bytes."""
    return F.unhex(F.substring(F.rpad(F.hex(data), 2 * size, "0"), 1, 2 * size))


def chunk_count(size: Column, payload: int = PACKET_PAYLOAD) -> Column:
    return F.ceil(size / payload).cast("long")


def packet_count(file_size: Column) -> Column:
    """Whole records behind the five bytes of magic."""
    return F.floor((file_size - 5) / PACKET_RECORD).cast("long")


def strip_bom(data: Column) -> Column:
    return F.when(F.hex(F.substring(data, 1, 3)) == "EFBBBF", F.substring(data, 4, 1 << 30)).otherwise(data)


@cache
def crc_table(width: int, polynomial: int) -> list[int]:
    """The remainders of all bytes for a CRC of `width` bits (5 to 16), most significant bit first, kept at the top of 16 bits."""
    table = []
    for byte in range(256):
        value = byte << 8
        for _ in range(8):
            value = (value << 1) ^ (polynomial << (16 - width)) if value & 0x8000 else value << 1
            value &= 0xFFFF
        table.append(value)
    return table


def crc(data: bytes, width: int, polynomial: int, start: int) -> int:
    table, value = crc_table(width, polynomial), start << (16 - width)
    for byte in data:
        value = ((value << 8) & 0xFFFF) ^ table[(value >> 8) ^ byte]
    return value >> (16 - width)


def crc16(data: bytes) -> int:
    """Polynomial 0x1021, start 0xFFFF."""
    return crc(data, 16, 0x1021, 0xFFFF)


def crc5(data: bytes) -> int:
    """Polynomial 0x05, start 0x1F."""
    return crc(data, 5, 0x05, 0x1F)


def _over(values: Iterable, fn) -> pd.Series:
    return pd.Series([None if v is None else fn(bytes(v)) for v in values], dtype="Int64")


def crc_udf(kind: str = "crc16"):
    """An Arrow-batched CRC: the built-in crc32 has another polynomial, and byte loops in SQL are slower still."""
    fn = {"crc16": crc16, "crc5": crc5}[kind]

    def batch(data: pd.Series) -> pd.Series:
        return _over(data, fn)

    batch.__annotations__ = {"data": pd.Series, "return": pd.Series}
    return F.pandas_udf(batch, "long")


def message(message_id: Column, sequence: Column, data: Column) -> Column:
    """Header (id, sequence, length) and data padded to 245 bytes, without the CRC that crc_udf adds."""
    return pad_right(F.concat(pack_uint(message_id, 1), pack_uint(sequence, 2), pack_uint(F.octet_length(data), 2), data), MESSAGE_DATA)


def decode_message(frame: Column) -> dict[str, Column]:
    length = unpack_uint(frame, 3, 2)
    return {"message_id": unpack_uint(frame, 0, 1), "sequence": unpack_uint(frame, 1, 2), "length": length, "data": F.substring(frame, F.lit(6), length.cast("int"))}


def serialize(fields: list[tuple[Column, int]]) -> Column:
    """Numbers with their widths, one behind the other."""
    return F.concat(*(pack_uint(c, w) for c, w in fields))
