"""Configuration, byte files, logs, reports, images, commands that are still active, and every Allan factor."""

import json
import os
import tomllib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from perilune.operators import images as I
from perilune.operators import sequence as S
from perilune.operators.commands import parse_command
from perilune.plans.reprocess import processed_frames
from perilune.sources import config as C
from perilune.sources import outputs as O
from perilune.sources.files import scratch, write_files
from perilune.sources.imu import read_imu, stream_imu
from perilune.sources.telemetry import read_tlm, write_ndjson, write_tlm

SYSTEM = "\n".join(f'[camera-device.cam{k}]\nid = {3 - k}\npath = "/dev/video{k}"\nresolution_width = 4608\nenabled = {str(k % 2 == 0).lower()}' for k in range(4))
SYSTEM += '\n[imu-device]\nchipid = 1\n[camera-isp]\nfps = 10\n[camera-calibration]\ncamera_matrix = [2, 0, 1, 0, 2, 1, 0, 0, 1]\ndist_coeffs = [1]\n[inference]\nrc_version = 2\n[inference.ldnet]\nweight_quant = 1\nuse_trt = true\n'


def test_system_configuration():
    s = C.system_config(SYSTEM)
    assert [(c.id, c.path, c.resolution_width, c.resolution_height, c.enabled) for c in s.cameras] == [(k, f"/dev/video{3 - k}", 4608, 480, k % 2 == 1) for k in range(4)]
    assert s.inertial == C.Inertial(chipid=1) and s.calibration.camera_matrix[0] == 2.0 and s.calibration.dist_coeffs == (0.0,) * 5 and s.isp == {"fps": 10}
    assert s.inference == C.Inference(rc_version=2, weight_quant=1, use_trt=True)
    for bad in (SYSTEM.replace("id = 3", "id = 2"), SYSTEM.replace("id = 3", "id = 4"), SYSTEM.replace("[imu-device]", "[other]"), SYSTEM + "[camera-device.more]\nid = 1\n"):
        with pytest.raises((ValueError, KeyError)):
            C.system_config(bad)


@pytest.mark.parametrize("bad", [{"rc_version": 0}, {"ld_version": -1}, {"ldnet": {"weight_quant": 3}}, {"ldnet": {"input_width": 0}}, {"ldnet": {"input_height": -5}}])
def test_inference_ranges(bad):
    with pytest.raises(ValueError):
        C.inference_config(bad)


def test_dataset_configuration():
    assert C.dataset_config("") == C.Dataset() and C.dataset_config("maximum_period = 5\nactive_cameras = [true, false, true, false]").active_cameras == (True, False, True, False)
    for bad in ("maximum_period = 0.05", "maximum_period = 10801.0", "target_frame_nb = 0", "target_frame_nb = 256", "dataset_capture_mode = 1", "imu_collection_mode = 4", "image_capture_rate = 255", "imu_sample_rate_hz = 0.0", "imu_sample_rate_hz = 26.0", "target_processing_stage = 4", "dataset_capture_mode = 5\ntarget_processing_stage = 2", "active_cameras = [true]"):
        with pytest.raises(ValueError):
            C.dataset_config(bad)
    for bad in ("maximum_period = 'x'", "target_frame_nb = 1.5", "target_frame_nb = true"):
        with pytest.raises(TypeError):
            C.dataset_config(bad)


def test_byte_files_appear_whole_and_once(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([(f"{k}.bin", bytes([k]) * k) for k in range(6)], "name string, content binary").repartition(3)
    write_files(rows, path)
    assert {n: open(os.path.join(path, n), "rb").read() for n in sorted(os.listdir(path))} == {f"{k}.bin": bytes([k]) * k for k in range(6)}
    write_files(rows.limit(1), path, "overwrite")
    assert len(os.listdir(path)) == 1
    before = os.listdir(path)
    with pytest.raises(Exception, match="called|same name"):
        write_files(rows.unionByName(rows), path)
    failing = rows.select("name", F.when(F.col("name") == "3.bin", F.raise_error(F.lit("stop")).cast("binary")).otherwise(F.col("content")).alias("content"))
    with pytest.raises(Exception, match="stop"):
        write_files(failing, path)
    assert [n for n in os.listdir(path) if n[0] != "_"] == before  # no file of a job that failed is seen


def test_logs_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, None)], "log string, SYSTEM_TIME long, note string")
    write_tlm(rows, str(tmp_path / "logs"), "log")
    back = read_tlm(spark, str(tmp_path / "logs"))
    assert sorted((os.path.basename(r.path), r.record_id, json.loads(r.json)["SYSTEM_TIME"]) for r in back.collect()) == [("a.tlm", 0, 1), ("a.tlm", 1, 2), ("b.tlm", 0, 3)]
    write_ndjson(back, str(tmp_path / "lines"))
    lines = spark.read.text(str(tmp_path / "lines"))
    assert sorted((r.log, json.loads(r.value)["SYSTEM_TIME"]) for r in lines.collect()) == [("a", 1), ("a", 2), ("b", 3)]
    assert scratch(spark) != scratch(spark)


def test_inertial_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text("\n".join(json.dumps({"timestamp_ms": k, "gyro_x_dps": 0.5 * k, "gyro_y_dps": 0.0, "gyro_z_dps": -1.0}) for k in range(5)))
    rows = spark.readStream.schema("timestamp_ms long, gyro_x_dps double, gyro_y_dps double, gyro_z_dps double").json(str(tmp_path / "in"))
    q = stream_imu(rows, str(tmp_path / "out"), str(tmp_path / "cp"), every="0 seconds")
    q.processAllAvailable()
    q.stop()
    assert sorted((r.timestamp_ms, r.gyro_x_dps) for r in read_imu(spark, str(tmp_path / "out")).collect()) == [(k, 0.5 * k) for k in range(5)]


def test_reports(spark):
    report = spark.createDataFrame([("b", 4, 2, 8, 500, 250), ("a", 0, 0, 0, None, None)], "region string, predicted long, true_positives long, truth long, precision_permille long, recall_permille long")
    classes = spark.createDataFrame([("b", 7, 2, 4)], "region string, class_id int, true_positives long, n long")
    text = O.validation_report(report, classes)
    assert "| a | 0 | 0 | 0 | n/a | n/a |\n| b | 4 | 2 | 8 | 50.0 % | 25.0 % |\n| all | 4 | 2 | 8 | 50.0 % | 25.0 % |" in text and "| b | 7 | 2 | 4 |" in text
    rows = spark.createDataFrame([(2, 1, None), (1, 5, 0.25)], "session int, stable_at long, gain double")
    assert tomllib.loads(O.calibration_report(rows, "session")) == {"session-1": {"stable_at": 5, "gain": 0.25}, "session-2": {"stable_at": 1}}


def test_commands_have_as_many_arguments_as_they_come_with(spark):
    df = spark.createDataFrame([("7 " + " ".join(map(str, range(100))),), ("7",), ("",), (None,)], "value string")
    assert [r.arguments if r.arguments is None else len(r.arguments) for r in parse_command(df).collect()] == [100, 0, 0, None]


slow = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@slow
@given(st.integers(1, 9), st.integers(1, 9), st.integers(1, 3), st.binary(min_size=243, max_size=243))
def test_tiles_put_images_together_again(spark, width, height, depth, data):
    pixels = data[: width * height * depth]
    df = spark.createDataFrame([(1, width, height, pixels)], "k int, w int, h int, p binary")
    tiles = I.image_tiles(df, "k", "w", "h", "p", 4, 3, depth)
    rows = {r.tile_idx: bytes(r.tile) for r in tiles.collect()}
    across = -(-width // 4)
    assert sorted(rows) == list(range(across * -(-height // 3)))
    for t, tile in rows.items():
        for k in range(12):
            x, y = t % across * 4 + k % 4, t // across * 3 + k // 4
            want = pixels[(y * width + x) * depth : (y * width + x + 1) * depth] if x < width and y < height else bytes(depth)
            assert tile[k * depth : (k + 1) * depth] == want
    back = I.paste_tiles(tiles.join(df.select("k", "w", "h"), "k"), "k", "w", "h", "tile", 4, 3, depth)
    assert bytes(back.first().pixels) == pixels
    # A lost tile is black, the others stand.
    some = I.paste_tiles(tiles.where("tile_idx > 0").join(df.select("k", "w", "h"), "k"), "k", "w", "h", "tile", 4, 3, depth).collect()
    for r in some:
        for k in range(width * height):
            x, y = k % width, k // width
            lost = x < 4 and y < 3
            assert bytes(r.pixels)[k * depth : (k + 1) * depth] == (bytes(depth) if lost else pixels[k * depth : (k + 1) * depth])


@slow
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 300), st.one_of(st.none(), st.integers(0, 80))), max_size=15))
def test_commands_are_held_back_while_an_equal_one_is_active(spark, rows):
    df = spark.createDataFrame([(i, k, t, None if n is None else t + n) for i, (k, t, n) in enumerate(rows)], "id int, k int, start long, end long")
    got = {r.id: r.duplicate for r in S.duplicate_commands(df, ["k"], "start", "end", 60).collect()}
    for key in (0, 1):
        ran = []
        for i, (_, t, n) in sorted(((i, r) for i, r in enumerate(rows) if r[0] == key), key=lambda x: (x[1][1], float("inf") if x[1][2] is None else x[1][1] + x[1][2], x[0])):
            held = any(e is None or t < e + 60 for e in ran)
            assert got[i] == held
            if not held:
                ran.append(None if n is None else t + n)
    assert len(got) == len(rows)


@slow
@given(st.lists(st.integers(-50, 50), max_size=12))
def test_every_allan_factor(spark, values):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k int, i int, v long")
    got = {r.m: (r.terms, r.squares) for r in S.allan_all(df, "k", ["i"], "v").collect()}
    want = {}
    for m in range(1, len(values)):
        terms = [values[i + 2 * m] - 2 * values[i + m] + values[i] for i in range(len(values) - 2 * m)]
        if terms:
            want[m] = (len(terms), sum(t * t for t in terms))
    assert got == want


def test_stages_look_only_where_the_last_one_found_something(spark):
    frames = spark.createDataFrame([(1, True), (2, False), (3, True), (4, True)], "frame int, passed boolean")
    regions = spark.createDataFrame([(1, 5, 0.9), (2, 5, 0.9), (3, 5, 0.1), (4, 5, 0.9)], "frame int, region_id int, score double")
    box = lambda f, k, x, s: (f, k, x, 0.0, 10.0, 10.0, 1, s)
    boxes = spark.createDataFrame([box(1, 1, 0.0, 0.9), box(1, 2, 1.0, 0.8), box(1, 3, 50.0, 0.7), box(1, 4, 90.0, 0.2), box(2, 1, 0.0, 0.9), box(3, 1, 0.0, 0.9)], "frame int, box_id int, x double, y double, w double, h double, class_id int, score double")
    got = {r.frame: (r.regions, r.landmarks, r.stage, r.state) for r in processed_frames(frames, regions, boxes, "frame").collect()}
    assert got == {1: (1, 2, 3, 3), 2: (0, 0, 1, 0), 3: (0, 0, 2, 1), 4: (1, 0, 3, 2)}
