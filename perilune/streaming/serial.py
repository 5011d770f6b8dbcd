"""A serial line's bytes as a stream of messages: a capture that grows, read on from where the last whole message ended.

    spark.dataSource.register(SerialMessages); spark.readStream.format("serial_messages").load("/captures/uart0.bin")

A message is a header (id, sequence, length), data padded to a fixed size, and a CRC over both. The offset of a micro-batch is the byte
behind its last whole message, so a message that is cut at the end of what has been captured is read again with the next batch, also
after a restart. Behind damage the next place is taken where the CRC holds and the length fits.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from perilune.functions.binary import MESSAGE_DATA, crc16

_CRC = 2
_HEADER = 5
FRAME = MESSAGE_DATA + _CRC


def messages(data: bytes, first: int = 0) -> tuple[list[tuple], int]:
    """(at, message_id, sequence, data) of the whole messages of a stretch, and how many of its bytes are done with. first: the stretch's place."""
    out, at = [], 0
    while at + FRAME <= len(data):
        frame = data[at : at + FRAME]
        length = int.from_bytes(frame[3:5], "big")
        if length <= MESSAGE_DATA - _HEADER and crc16(frame[:MESSAGE_DATA]) == int.from_bytes(frame[MESSAGE_DATA:], "big"):
            out.append((first + at, frame[0], int.from_bytes(frame[1:3], "big"), frame[_HEADER : _HEADER + length]))
            at += FRAME
        else:
            at += 1
    return out, at


class _Line(SimpleDataSourceStreamReader):
    """Reads on the driver: a serial line brings some ten thousand bytes a second."""

    def __init__(self, options: dict) -> None:
        self.path, self.most = options["path"].removeprefix("file://"), max(int(options.get("maxBytesPerBatch", 1 << 22)), FRAME)

    def initialOffset(self) -> dict:  # noqa: N802  Spark's name
        return {"at": 0}

    def _bytes(self, at: int, n: int) -> bytes:
        with open(self.path, "rb") as f:
            f.seek(at)
            return f.read(n)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, done = messages(self._bytes(start["at"], self.most), start["at"])
        return iter(rows), {"at": start["at"] + done}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter(messages(self._bytes(start["at"], end["at"] - start["at"]), start["at"])[0])


class SerialMessages(DataSource):
    """format('serial_messages'): at (the byte in the capture), message_id, sequence, data. The capture is on the driver's disk or one that it sees."""

    @classmethod
    def name(cls) -> str:
        return "serial_messages"

    def schema(self) -> str:
        return "at long, message_id int, sequence int, data binary"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _Line(self.options)
