import json

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from perilune.operators import detection as D
from perilune.operators import framing as P
from perilune.operators import frames as R
from perilune.operators import measure as M
from perilune.sources import frames as S
from perilune.sources import telemetry as L
from perilune.sources.config import Solver, solver_config, update_section
from perilune.sources.imu import format_imu, parse_imu


def test_both_layouts_decode(spark):
    nested = {"timestamp": 5, "cam_id": 1, "annotation_state": 3, "processing_stage": 3, "inference_results": {"rcnet_version": 2, "ldnet_version": 3, "regions": [{"region_0": {"id": 5, "confidence": 0.9}}], "landmarks": [{"landmark_0": {"x": 1.5, "y": 2, "height": 3, "width": 4, "confidence": 0.5, "class_id": 7, "region_id": 5}}]}}
    flat = {"timestamp": 6, "cam_id": 0, "regions": [{"region_0": {"id": 1, "confidence": 0.95}}], "landmarks": []}
    none = {"timestamp": 7, "cam_id": 2}
    texts = [json.dumps(x) for x in (nested, flat, none)] + ["{ definitely not json", "", None]
    rows = S.decode_frames(spark.createDataFrame([(t,) for t in texts], "value string")).orderBy("timestamp_ms").collect()
    assert [r.timestamp_ms for r in rows] == [5, 6, 7]
    assert rows[0].inference_results.landmarks[0].class_id == 7 and rows[1].inference_results.regions[0].id == 1 and rows[2].inference_results is None
    again = S.decode_frames(S.encode_frames(S.decode_frames(spark.createDataFrame([(texts[0],)], "value string"))).select("value")).first()
    assert again.inference_results.landmarks == rows[0].inference_results.landmarks


def test_catalogue_numbers_good_rows(spark):
    text = "lon,lat,x\n1.0,2.0,9\nbad,row\n3.0,4.0\n"
    rows = S.decode_catalogue(spark.createDataFrame([("17R", text)], "region string, value string")).orderBy("class_id").collect()
    assert [(r.region_id, r.class_id, r.lon_deg) for r in rows] == [(5, 0, 1.0), (5, 1, 3.0)]


def test_labels(spark):
    lines = [("3 0.5 0.5 0.1 0.2", "17R_1000_yp.txt"), ("broken", "17R_1000_yp.txt"), ("1 0 0 0 0", "other.txt")]
    rows = S.decode_labels(spark.createDataFrame(lines, "value string, name string"), 100, 100).collect()
    assert [(r.region, r.timestamp_ms, r.cam_id, r.class_id, r.x, r.y, r.w, r.h) for r in rows] == [("17R", 1000, 1, 3, 45, 40, 10, 20)]


def test_imu_drops_dirty_rows_and_round_trips(spark):
    lines = ["Timestamp_ms, Gyro_X_dps, Gyro_Y_dps, Gyro_Z_dps", "", "10 ms, ERROR 3", "bad,row", "5, 1.5, -2, 0.25", None, "6,1,2"]
    rows = parse_imu(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [tuple(r) for r in rows.collect()] == [(5, 1.5, -2.0, 0.25)]
    assert [tuple(r) for r in parse_imu(format_imu(rows)).collect()] == [(5, 1.5, -2.0, 0.25)]


def test_read_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "frame_5_1.json").write_text(json.dumps({"timestamp": 5, "cam_id": 1}, indent=1))
    (tmp_path / "a" / "frame_6_1.json").write_text("{ no")
    (tmp_path / "a" / "raw_5_1.png").write_bytes(b"png")
    (tmp_path / "a" / "raw_5_1.jpg").write_bytes(b"jp")
    (tmp_path / "a" / "dataset.json").write_text(json.dumps({"capture_start_time": 1, "maximum_period": 2.0, "target_frame_nb": 3, "dataset_capture_mode": 2, "imu_collection_mode": 0, "target_processing_stage": 1}))
    assert [(r.dataset_id, r.timestamp_ms) for r in S.read_frames(spark, str(tmp_path)).collect()] == [("a", 5)]
    assert S.read_images(spark, str(tmp_path)).first().path.endswith(".jpg")
    assert S.read_datasets(spark, str(tmp_path)).count() == 1


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=240), max_size=6))
def test_fixed_packets_round_trip(payloads):
    data = L.encode_packets(payloads)
    assert len(data) == 5 + 242 * len(payloads) and L.decode_packets(data) == payloads


def test_fixed_packets_reject(spark):
    with pytest.raises(ValueError, match="bad packet"):
        L.decode_packets(b"DHGEN" + b"\0\0" + bytes(240))
    with pytest.raises(ValueError, match="1 to 240"):
        L.encode_packets([bytes(241)])
    assert L.decode_packets(bytes(500)) == [bytes(240), bytes(240), bytes(20)]
    assert L.decode_packets(b"DHGEN\0\x03abc") == [b"abc"]
    files = spark.createDataFrame([("good", L.encode_packets([b"\1\2\3", b"\xaa\xbb"])), ("cut", b"DHGEN\0\x09abc"), ("raw", b"x" * 250), ("none", b"")], "f string, content binary")
    got = sorted((r.f, r.packet_id, bytes(r.payload)) for r in P.read_packets(files, "f").collect())
    assert got == [("good", 0, b"\1\2\3"), ("good", 1, b"\xaa\xbb"), ("raw", 0, b"x" * 240), ("raw", 1, b"x" * 10)]


def test_sources(spark, tmp_path):
    spark.dataSource.register(L.TelemetrySource)
    spark.dataSource.register(L.PacketSource)
    log = tmp_path / "a.tlm"
    log.write_bytes(L.encode_tlm([{"b": 1, "a": 2}, {"c": None}]))
    (tmp_path / "bad.tlm").write_bytes(b"TLM1\0\0\0\x09abc")
    assert [r.json for r in spark.read.format("tlm").load(str(log)).orderBy("record_id").collect()] == ['{"a": 2, "b": 1}', '{"c": null}']
    assert L.read_tlm(spark, str(tmp_path), damaged="keep").where("error is null").count() == 2
    with pytest.raises(ValueError, match="cut"):
        list(L.decode_tlm(log.read_bytes()[:-1]))
    rows = spark.createDataFrame([("x.bin", 0, b"one"), ("x.bin", 1, b"two")], "path string, packet_id int, payload binary").coalesce(1)
    rows.write.format("fixedpackets").mode("append").save(str(tmp_path / "out"))
    assert L.decode_packets((tmp_path / "out" / "x.bin").read_bytes()) == [b"one", b"two"]


def test_dataset_checks(spark):
    cases = [(60.0, 10, 2, 0, 1, 1.0, 0, []), (0.05, 10, 2, 0, 1, 1.0, 0, ["period"]), (60.0, 256, 6, 4, 255, 26.0, 4, ["frames", "mode", "imu_mode", "image_rate", "imu_rate", "stage"]), (60.0, 1, 5, 0, 1, 1.0, 2, ["stage_below_mode"])]
    df = spark.createDataFrame([c[:-1] for c in cases], "p double, f int, m int, i int, r int, h double, s int")
    got = [r.x for r in df.select(R.check_list(R.dataset_checks(*(F.col(c) for c in "pfmirhs"))).alias("x")).collect()]
    assert got == [c[-1] for c in cases]


def test_cascade_order(spark):
    cases = [(31.0, 21.0, 0.0, 0.0, 0.0, 99, "", True), (0.0, 0.0, 40.0, 60.0, 10.0, 60, "cloudy", False), (0.0, 0.0, 40.0, 60.0, 10.0, 0, "black", False), (0.0, 0.0, 40.0, 20.0, 210.0, 0, "white", False), (0.0, 0.0, 40.0, 60.0, 100.0, 0, "green", True), (0.0, 0.0, 90.0, 60.0, 100.0, 0, "single_color", True)]
    df = spark.createDataFrame([c[:6] for c in cases], "a double, b double, h double, s double, v double, c int")
    made = R.dominant_type(*(F.col(x) for x in "abhsvc"))
    got = [(r.dominant_type, r.passed) for r in df.select(*(c.alias(k) for k, c in made.items())).collect()]
    assert got == [c[6:] for c in cases]


def test_ties_go_to_the_first_frame(spark):
    df = spark.createDataFrame([(1, 7, 1.0), (1, 3, 1.0), (1, 5, 0.5)], "d int, f int, rank double")
    assert R.best_frame(df, "d", ["rank"], "f").first().best_frame == 3


boxes = st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20), st.integers(1, 10), st.integers(1, 10), st.integers(0, 1), st.integers(0, 9)), max_size=15)


@settings(max_examples=60, deadline=None)
@given(boxes)
def test_suppressed_boxes_do_not_overlap(rows):
    df = pd.DataFrame(rows, columns=["x", "y", "w", "h", "class_id", "score"])
    df["box_id"] = range(len(df))
    kept = D.suppress(df).reset_index(drop=True)

    def iou(a, b):
        w, h = min(a.x + a.w, b.x + b.w) - max(a.x, b.x), min(a.y + a.h, b.y + b.h) - max(a.y, b.y)
        both = max(w, 0) * max(h, 0)
        return both / (a.w * a.h + b.w * b.h - both)

    pairs = [(a, b) for a in kept.itertuples() for b in kept.itertuples() if a.box_id < b.box_id and a.class_id == b.class_id]
    assert all(iou(a, b) <= 0.45 for a, b in pairs)
    for r in df.itertuples():  # whatever went overlaps a kept box of its class with no lower score
        assert r.box_id in set(kept.box_id) or any(k.class_id == r.class_id and k.score >= r.score and iou(k, r) > 0.45 for k in kept.itertuples())


def test_enclosing_score_is_at_most_the_true_one(spark):
    a, b = tuple(map(F.lit, (0, 0, 4, 4))), tuple(map(F.lit, (2, 2, 4, 4)))
    r = spark.range(1).select(D.overlap_score(a, b).alias("x"), D.overlap_score(a, b, True).alias("y")).first()
    assert r.x == pytest.approx(4 / 36) and r.y == pytest.approx(4 / 28)


def test_report_may_exceed_full_recall(spark):
    p = spark.createDataFrame([("a", True), ("a", True), ("b", False)], "k string, hit boolean")
    t = spark.createDataFrame([("a",), ("c",)], "k string")
    got = {r.k: (r.precision_permille, r.recall_permille) for r in D.detection_report(p, t, "k", "hit").collect()}
    assert got == {"a": (1000, 2000), "b": (0, None), "c": (None, 0)}


def test_landmark_measurements(spark):
    frames = spark.createDataFrame([("d", 1000, 0, [(4608.0 / 2, 1296.0, 6.0, 12.0, 0.5, 0, 5), (1.0, 1.0, 1.0, 1.0, 0.5, 999999, 5)]), ("d", 2000, 9, [(1.0, 1.0, 1.0, 1.0, 0.5, 0, 5)])], f"dataset_id string, timestamp_ms long, cam_id int, landmarks array<{S.LANDMARK}>")
    catalogue = spark.createDataFrame([(5, 0, 10.0, 20.0)], "region_id int, class_id int, lon_deg double, lat_deg double")
    cameras = spark.createDataFrame([(0, 3548.0, 3548.0, 2304.0, 1296.0, [float(x in (0, 4, 8)) for x in range(9)])], "cam_id int, fx double, fy double, cx double, cy double, r array<double>")
    rows = M.landmark_measurements(frames, catalogue, cameras).collect()
    assert len(rows) == 1 and rows[0].bearing_z == 1 and rows[0].sigma == pytest.approx(6 / (6 * 3548))
    assert (rows[0].eci_x_km ** 2 + rows[0].eci_y_km ** 2 + rows[0].eci_z_km ** 2) ** 0.5 == pytest.approx(6375, abs=5)


def test_config():
    assert solver_config("[solver]\nhuber = 4\n", max_seconds=7.0) == Solver(huber=4.0, max_seconds=7.0)
    with pytest.raises(KeyError):
        solver_config("[solver]\nnope = 1\n")
    with pytest.raises(TypeError):
        solver_config('[solver]\nhuber = "x"\n')
    assert update_section("[a]\nx = 1\n[b]\ny = 2\n", "a", {"x": 3, "z": True}, {"x", "z"}) == "[a]\nx = 3\nz = true\n[b]\ny = 2\n"
