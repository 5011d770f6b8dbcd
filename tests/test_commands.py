import json

import pytest
from pyspark.sql import functions as F

from perilune.functions.binary import crc_udf
from perilune.operators import calibration as K
from perilune.operators import commands as C
from perilune.sources import outputs as O
from perilune.streaming import dispatch

GOOD = {"mode": 2, "period": 60, "frames": 10, "start_s": 0, "imu_mode": 0, "image_rate": 1, "imu_rate_tenths": 10, "stage": 0}


@pytest.mark.parametrize(
    ("change", "error"),
    [({}, None), ({"mode": 1}, "mode"), ({"mode": 6}, "mode"), ({"period": 0}, "period"), ({"period": 10801}, "period"), ({"frames": 0}, "frames"), ({"frames": 256}, "frames"), ({"imu_mode": 4}, "imu_mode"), ({"image_rate": 0}, "image_rate"), ({"image_rate": 255}, "image_rate"), ({"imu_rate_tenths": 0}, "imu_rate"), ({"imu_rate_tenths": 251}, "imu_rate"), ({"stage": 4}, "stage")],
)
def test_one_bad_value_is_named(spark, change, error):
    data = C.encode(C.START_CAPTURE, {k: F.lit(v) for k, v in (GOOD | change).items()})
    made = C.start_capture(data, F.lit(777).cast("long"))
    assert tuple(spark.range(1).select(made["error"], made["start_ms"]).first()) == (error, 777)


def test_short_command(spark):
    assert spark.range(1).select(C.start_capture(F.lit(b"\2").cast("binary"), F.lit(0).cast("long"))["error"]).first()[0] == "too_short"


def test_layout_sizes():
    assert (C.size(C.TELEMETRY), C.size(C.HOST_TELEMETRY), C.size(C.START_CAPTURE), C.size(C.IMAGE_METADATA)) == (49, 47, 13, 15)


def test_literal_crc_fails_on_padded_packets(spark):
    files = spark.createDataFrame([("a", b"x" * 500), ("b", b"")], "k string, d binary")
    packets = C.chunk_packets(files, "k", "d", crc_udf("crc5"))
    assert [r.crc_valid for r in C.check_packets(packets, "packet", crc_udf("crc5")).collect()] == [True] * 3
    assert packets.where(F.octet_length("packet") != 250).count() == 0
    broken = packets.withColumn("packet", F.concat(F.substring("packet", 1, 12), F.lit(b"\0").cast("binary"), F.substring("packet", 14, 300)))
    assert not any(r.crc_valid for r in C.check_packets(broken, "packet", crc_udf("crc5")).collect())
    assert not all(r.crc_valid for r in C.check_packets(packets, "packet", crc_udf("crc5"), literal=True).collect())


def test_packet_streams_stop_at_a_cut(spark):
    one = b"\0\3\0\1\0\2\5abc"
    files = spark.createDataFrame([("a", one + one), ("cut", one + one[:-1]), ("head", one[:4]), ("none", None)], "k string, d binary")
    got = sorted((r.k, r.tile_idx, r.frag_idx, bytes(r.payload)) for r in C.packet_stream(files, "k", "d").collect())
    assert got == [("a", 2, 5, b"abc"), ("a", 2, 5, b"abc"), ("cut", 2, 5, b"abc")]


def test_json_packets(spark):
    files = spark.createDataFrame([("a", "﻿" + json.dumps({"x": "y" * 600})), ("b", ""), ("c", "plain")], "k string, t string")
    got = {r.k: (r.text, r.plausible) for r in C.json_from_packets(C.json_packets(files, "k", "t"), "k").collect()}
    assert got == {"a": (json.dumps({"x": "y" * 600}), True), "c": ("plain", False)}


def test_command_lines(spark):
    rows = C.parse_command(spark.createDataFrame([("12 1 0x0A",), ("bad",), ("",), (None,)], "value string")).collect()
    assert [(r.cmd_id, r.arguments) for r in rows][:2] == [(12, [1, 10]), (None, [])]


def test_flat_images_are_blurred(spark):
    rows = [("flat", x, y, 100) for x in range(4) for y in range(4)] + [("sharp", x, y, 255 * ((x + y) % 2)) for x in range(4) for y in range(4)]
    got = {r.f: r.blurred for r in K.blurred(spark.createDataFrame(rows, "f string, x int, y int, gray int"), "f").collect()}
    assert got == {"flat": True, "sharp": False}


def test_calibration(spark):
    rows = [("s", i, 1000 + i, 100.0 + (5 * i if i < 3 else 0.1 * i), 0.0, 0.0) for i in range(12)]
    row = K.calibration(spark.createDataFrame(rows, "s string, i int, exposure int, luminance double, saturated_pct double, dark_pct double"), "s", "i", "exposure").first()
    assert row.stable_at == 7 and row.exposure == 1002


def test_documents_and_tables(spark, tmp_path):
    data = spark.createDataFrame([("/d/a", 1.5, [(0, 5)])], "folder_path string, maximum_period double, frame_id_list array<struct<cam_id:int,timestamp:long>>")
    frames = spark.createDataFrame([("/d/a", 1, 9), ("/d/a", 0, 5), ("/d/a", 1, 9)], "folder_path string, cam_id int, timestamp long")
    counters = spark.createDataFrame([("/d/a", 3)], "folder_path string, num_frames long")
    lines = spark.createDataFrame([("/d/a", 25)], "folder_path string, lines long")
    summary = json.loads(O.dataset_summaries(data.drop("frame_id_list"), counters, frames, lines).first().value)
    assert summary["frame_id_list"] == [{"cam_id": 0, "timestamp": 5}, {"cam_id": 1, "timestamp": 9}] and summary["imu_timestamps_collected"] == 25
    done = spark.createDataFrame([("/d/a", 1, 9, 3, 0.5)], "folder_path string, cam_id int, timestamp long, annotation_state int, rank float")
    manifest = O.processing_manifests(data, done)
    assert "frame_id_list" not in json.loads(manifest.first().value) and len(json.loads(manifest.first().value)["processed_frames"]) == 1
    O.write_documents(manifest, str(tmp_path / "docs"))
    assert spark.read.text(str(tmp_path / "docs")).count() == 1
    marks = spark.createDataFrame([(5, 1.0, 0.0, 0.0, 7000.0, 0.0, 0.0, 0, 0.01)], "timestamp_ms long, bearing_x double, bearing_y double, bearing_z double, eci_x_km double, eci_y_km double, eci_z_km double, group int, sigma double")
    O.write_measurements(marks, str(tmp_path / "m"))
    assert [tuple(r) for r in O.read_measurements(spark, str(tmp_path / "m")).collect()] == [tuple(r) for r in marks.collect()]
    states = spark.createDataFrame([("d", 0.1234567890123456)], "dataset_id string, t double")
    O.write_results({"state_estimates": states}, str(tmp_path / "r"))
    found = O.read_results(spark, str(tmp_path / "r"))
    assert found["state_estimates"].first().t == 0.123456789012 and found["covariance"] is None and found["od_result"] is None
    O.write_trajectory(states, spark.createDataFrame([("d", [1.0, 2.0, 3.0])], "dataset_id string, bias array<double>"), str(tmp_path / "t"))
    assert spark.read.option("header", True).csv(str(tmp_path / "t" / "trajectory")).columns == ["t", "gyro_bias_x", "gyro_bias_y", "gyro_bias_z", "dataset"]
    residuals = spark.createDataFrame([(1.0, 2.0)], "pos_res_x double, gyro_bias_res_x double")
    assert O.residual_columns(residuals).columns == ["pos_res_x"] and O.residual_columns(residuals, "tv").columns == residuals.columns
    assert O.markdown([{"a": 1, "b": None}], ["a", "b"]).splitlines()[-1] == "| 1 | n/a |" and O.toml({"x": {"a": True, "b": "q"}}) == '[x]\na = true\nb = "q"\n'


def test_dispatch_retries_single_commands_in_priority_order(spark):
    batch = spark.createDataFrame([(1, 0, 5, "PING"), (2, 9, 7, "BAD"), (3, 9, 6, "PING"), (4, 5, 1, "SHUTDOWN")], "cmd_id int, priority int, created_at long, name string")
    seen, lost = [], []

    def act(row):
        seen.append(row.cmd_id)
        if row["name"] == "BAD" and seen.count(2) < 3:
            raise RuntimeError("again")

    dispatch.with_retries(act, workers=1)(batch, 0)
    assert seen == [3, 2, 2, 2, 4, 1]  # only the command that failed is run again

    def never(row):
        seen.append(row.cmd_id)
        if row["name"] == "BAD":
            raise RuntimeError("no")

    seen.clear()
    dispatch.with_retries(never, 2, failed=lambda row, e: lost.append((row.cmd_id, str(e))))(batch, 1)
    assert lost == [(2, "no")] and sorted(seen) == [1, 2, 2, 3, 4] and seen.index(4) > seen.index(3)
    with pytest.raises(RuntimeError):
        dispatch.with_retries(never)(batch, 2)
    assert sorted(seen)[-1] == 4 and seen.count(1) == 2  # the others are done nevertheless


def test_batches_are_handed_over_once(spark, tmp_path):
    hand = dispatch.drained(str(tmp_path / "out"))
    for epoch in (0, 1, 1):  # the second batch is run twice
        hand(spark.range(10 * epoch, 10 * epoch + 3), epoch)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2, 10, 11, 12]


def test_rate_limit(spark, tmp_path):
    from test_orbit_and_streams import run

    rows = [{"key": "c", "t": float(t), "mode": "periodic" if t < 8 else "earth", "target": 2} for t in (0, 1, 5, 6, 7, 8, 9)]
    got = run(spark, tmp_path, rows, "key string, t double, mode string, target long", lambda s: dispatch.rate_limited(s, 5.0), "append")
    assert sorted((r.t, r.shot) for r in got) == [(0.0, 1), (5.0, 2), (8.0, 1)]
