"""The serial line as a stream: cut messages, damage, and restarts."""

import random

from perilune.functions.binary import MESSAGE_DATA, crc16
from perilune.streaming.serial import FRAME, SerialMessages, messages


def framed(k, data):
    body = (bytes([k % 256]) + k.to_bytes(2, "big") + len(data).to_bytes(2, "big") + data).ljust(MESSAGE_DATA, b"\0")
    return body + crc16(body).to_bytes(2, "big")


def test_messages_are_found_again_behind_damage():
    rng = random.Random(1)
    sent = [framed(k, rng.randbytes(rng.randint(0, 240))) for k in range(20)]
    line = sent[0] + b"noise" + sent[1] + sent[2][:100] + b"".join(sent[3:6]) + bytes([sent[6][0] ^ 1]) + sent[6][1:] + b"".join(sent[7:])
    found, done = messages(line)
    assert [m[2] for m in found] == [k for k in range(20) if k not in (2, 6)] and done == len(line)
    cut, done = messages(sent[0] + sent[1][:-1])
    assert [m[2] for m in cut] == [0] and done == FRAME


def test_a_restart_in_the_middle_of_a_message(spark, tmp_path):
    spark.dataSource.register(SerialMessages)
    line, out = tmp_path / "uart.bin", str(tmp_path / "out")
    sent = [framed(k, b"%d" % k) for k in range(30)]
    data = b"".join(sent[:12]) + b"\x07\x07" + b"".join(sent[12:])
    # Captured in three parts, two of them cut inside a message and one inside the damage; a query of its own reads each.
    for end in (5 * FRAME + 17, 12 * FRAME + 1, len(data)):
        line.write_bytes(data[:end])
        query = spark.readStream.format("serial_messages").option("maxBytesPerBatch", 3 * FRAME + 5).load(str(line)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).start(out)
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    rows = sorted((r.sequence, r.at, bytes(r.data)) for r in spark.read.parquet(out).collect())
    assert [(k, d) for k, _, d in rows] == [(k, b"%d" % k) for k in range(30)]
    assert all(data[at : at + FRAME] == sent[k] for k, at, _ in rows)
