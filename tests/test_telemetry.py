"""Telemetry logs and fixed packets as sources and sinks: ranges, damage, and files that appear as a whole."""

import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from perilune.sources import telemetry as L


@pytest.fixture
def logs(tmp_path):
    """A log whose stored payloads hold another log byte by byte, one that is cut, one that is damaged, one of another kind."""
    inner = L.encode_tlm([{"inner": 1}, {"inner": 2}], level=0).decode("latin-1")
    whole = [{"n": i, "text": inner * (i % 3)} for i in range(200)]
    (tmp_path / "a.tlm").write_bytes(L.encode_tlm(whole, level=0))
    return tmp_path, whole


@pytest.mark.parametrize("size", [1, 300, 1 << 20])
def test_logs_are_read_by_ranges(spark, logs, size):
    folder, whole = logs
    rows = L.read_tlm(spark, str(folder), size=size)
    got = sorted((r.record_id, json.loads(r.json)) for r in rows.collect())
    assert [r for _, r in got] == whole and [k for k, _ in got] == list(range(200)) and rows.columns == ["path", "record_id", "json"]
    if size == 300:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 1
        finally:
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize(("bad", "says"), [(lambda d: d[:-3], "cut"), (lambda d: d + b"\0\0", "cut"), (lambda d: b"XXXX" + d[4:], "not a telemetry log")])
def test_cut_and_alien_logs_are_errors(spark, logs, bad, says):
    folder, whole = logs
    data = (folder / "a.tlm").read_bytes()
    (folder / "b.tlm").write_bytes(bad(data))
    with pytest.raises(PySparkException, match=rf"b.tlm.*{says}"):
        L.read_tlm(spark, str(folder)).collect()
    kept = L.read_tlm(spark, str(folder), "keep", size=500).where(F.col("path").endswith("b.tlm")).collect()
    errors = [r for r in kept if r.error]
    assert len(errors) == 1 and says in errors[0].error and errors[0].json is None
    left = {(lambda d: d)(len(data) - 3): 199, len(data) + 2: 200}.get(len(bad(data)), 0)
    assert [json.loads(r.json) for r in sorted((r for r in kept if not r.error), key=lambda r: r.record_id)] == whole[:left]


def test_a_damaged_record_ends_its_stretch(spark, tmp_path):
    data = bytearray(L.encode_tlm([{"n": i} for i in range(5)]))
    (tmp_path / "c.tlm").write_bytes(bytes(data[:-2]) + b"\0\0")
    with pytest.raises(PySparkException, match="damaged"):
        L.read_tlm(spark, str(tmp_path)).collect()
    kept = L.read_tlm(spark, str(tmp_path), "keep").collect()
    assert sorted(json.loads(r.json)["n"] for r in kept if r.json) == [0, 1, 2, 3] and sum(r.error is not None for r in kept) == 1


def test_no_logs(spark, tmp_path):
    os.makedirs(tmp_path / "none")
    (tmp_path / "none" / "d.tlm").write_bytes(L.TLM_MAGIC)
    assert L.read_tlm(spark, str(tmp_path / "none")).count() == 0


def test_packets_are_read_by_ranges(spark, tmp_path):
    spark.dataSource.register(L.PacketSource)
    payloads = [bytes([i % 256]) * (i % 240 + 1) for i in range(1000)]
    (tmp_path / "p").write_bytes(L.encode_packets(payloads))
    (tmp_path / "raw").write_bytes(bytes(range(250)) * 3)
    read = lambda name, n: spark.read.format("fixedpackets").option("recordsPerPartition", n).load(str(tmp_path / name))
    rows = read("p", 64)
    assert rows.rdd.getNumPartitions() == 16
    assert [bytes(r.payload) for r in rows.orderBy("packet_id").collect()] == payloads
    assert b"".join(bytes(r.payload) for r in read("raw", 2).orderBy("packet_id").collect()) == bytes(range(250)) * 3
    (tmp_path / "cut").write_bytes(L.encode_packets(payloads)[:-205])  # a short last record is taken only if its payload is whole
    with pytest.raises(PySparkException, match="cut, records"):
        read("cut", 64).collect()


def test_packet_files_appear_as_a_whole(spark, tmp_path):
    spark.dataSource.register(L.PacketSource)
    out = tmp_path / "out"
    rows = spark.createDataFrame([(f"f{i % 3}", i, bytes([i]) * 5) for i in range(9)], "path string, packet_id int, payload binary")
    rows.repartition(2, "path").write.format("fixedpackets").mode("append").save(str(out))
    assert sorted(os.listdir(out)) == ["f0", "f1", "f2"]
    assert L.decode_packets((out / "f1").read_bytes()) == [bytes([i]) * 5 for i in (1, 4, 7)]
    bad = rows.unionByName(spark.createDataFrame([("g", 0, b"x" * 241)], rows.schema))
    with pytest.raises(PySparkException):
        bad.withColumn("path", F.concat(F.lit("new-"), "path")).repartition(3, "path").write.format("fixedpackets").mode("append").save(str(out))
    assert sorted(os.listdir(out)) == ["f0", "f1", "f2"]  # not even those of the tasks that ended well
