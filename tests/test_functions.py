import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from perilune.functions import binary as B
from perilune.functions import codes, nav, text, units
from perilune.functions import quaternion as Q


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def lits(*xs):
    return tuple(F.lit(float(x)) for x in xs)


def test_crc_known_values():
    assert B.crc16(b"123456789") == 0x29B1
    assert B.crc5(b"123456789") == _crc5_bits(b"123456789")


def _crc5_bits(data):
    value = 0x1F
    for byte in data:
        for k in range(7, -1, -1):
            top = (value >> 4 ^ byte >> k) & 1
            value = (value << 1 & 0x1F) ^ (0x05 if top else 0)
    return value


def test_pack_and_unpack(spark):
    x = B.pack_uint(F.lit(0xBEEF), 4)
    assert bytes(one(spark, x)[0]) == b"\x00\x00\xbe\xef"
    assert one(spark, B.unpack_uint(x, 2, 2), B.unpack_uint(x, 3, 2)) == (0xBEEF, None)


def test_message_round_trip(spark):
    m = B.message(F.lit(7), F.lit(300), F.lit(b"hello").cast("binary"))
    got = B.decode_message(m)
    assert one(spark, F.octet_length(m), got["message_id"], got["sequence"], got["length"], got["data"].cast("string")) == (245, 7, 300, 5, "hello")


def test_bom_is_stripped(spark):
    assert bytes(one(spark, B.strip_bom(F.lit(b"\xef\xbb\xbf{}").cast("binary")))[0]) == b"{}"
    assert bytes(one(spark, B.strip_bom(F.lit(b"{}").cast("binary")))[0]) == b"{}"


def test_principal_and_side_bearings(spark):
    assert one(spark, *nav.pixel_bearing(F.lit(1000), F.lit(1000), 4000.0, 4000.0, 1000.0, 1000.0)) == (0, 0, 1)
    assert np.allclose(one(spark, *nav.pixel_bearing(F.lit(5000), F.lit(1000), 4000.0, 4000.0, 1000.0, 1000.0)), (2**-0.5, 0, 2**-0.5))


def test_rates_convert(spark):
    assert np.allclose(one(spark, *(units.dps_to_rad(F.lit(x)) for x in (180.0, -90.0, 45.0))), (math.pi, -math.pi / 2, math.pi / 4))


def test_epoch_models_differ_by_leap_seconds(spark):
    a, b = one(spark, units.unix_to_j2000(F.lit(1.6e9)), units.unix_to_j2000(F.lit(1.6e9), "constant"))
    assert a - b == pytest.approx(5.184)


def test_earth_orientation(spark):
    """A published example of the full reduction (2004-04-06 07:51:28.386 UTC, UT1 - UTC -0.44 s): within 60 m of 10,000 km; and back again."""
    df = spark.createDataFrame([(5102.508958, 6123.011401, 6378.136928, 1081237888.386009)], "x double, y double, z double, unix double")
    fixed = nav.inertial_to_earth(df, ["x", "y", "z"], F.col("unix"), -0.4399619)
    assert list(fixed.first())[:3] == pytest.approx([-1033.4793830, 7901.2952754, 6380.3565958], abs=0.06)
    back = nav.earth_to_inertial(fixed, ["x", "y", "z"], F.col("unix"), -0.4399619)
    assert list(back.first()) == pytest.approx([5102.508958, 6123.011401, 6378.136928, 1081237888.386009], abs=1e-8)


def test_geodetic_round_trip(spark):
    there = nav.geodetic_to_ecef(F.lit(0.3), F.lit(-1.1), F.lit(550.0))
    assert np.allclose(one(spark, *nav.ecef_to_geodetic(there)), (550, 0.3, -1.1), atol=1e-8)


def test_quaternion_identities(spark):
    q = lits(0.1, 0.2, 0.3, math.sqrt(1 - 0.14))
    v = lits(1, -2, 0.5)
    back = Q.inverse_rotate_xyzw(Q.conjugate_xyzw(q), Q.inverse_rotate_xyzw(q, v))
    assert np.allclose(one(spark, *back), (1, -2, 0.5))
    assert np.allclose(one(spark, *Q.product_wxyz(lits(1, 0, 0, 0), lits(0.5, 0.5, 0.5, 0.5))), 0.5)
    assert one(spark, Q.norm(Q.slerp_wxyz(lits(1, 0, 0, 0), lits(0, 1, 0, 0), F.lit(0.5))))[0] == pytest.approx(1)
    # Nearly parallel ones are mixed without being normalised.
    assert one(spark, Q.norm(Q.slerp_wxyz(lits(2, 0, 0, 0), lits(0.5, 0, 0, 0), F.lit(0.5))))[0] == pytest.approx(1.25)


def test_wahba_recovers_a_rotation():
    g = np.random.default_rng(0)
    r = np.linalg.qr(g.normal(size=(3, 3)))[0]
    r *= np.sign(np.linalg.det(r))
    body = g.normal(size=(6, 3))
    q = Q.wahba((body @ r.T).T @ body)
    assert np.allclose(np.abs(q @ Q.matrix_to_xyzw(r)), 1)
    assert Q.wahba(np.zeros((3, 3))).tolist() == [0, 0, 0, 1]


def test_wahba_of_a_stack_is_that_of_each():
    """Half turns, mirrored, flat and empty sums among random ones; a stack of no sums too."""
    b = np.random.default_rng(1).normal(size=(50, 3, 3))
    b[0], b[1], b[2], b[3], b[4] = 0, np.diag([1.0, -1, -1]), np.diag([3.0, 2, -1]), np.diag([1.0, 1, 0]), -np.eye(3)
    q = Q.wahba(b)
    assert q.shape == (50, 4) and np.allclose(np.linalg.norm(q, axis=1), 1) and Q.wahba(b[:0]).shape == (0, 4)
    assert np.array_equal(q, np.array([Q.wahba(x) for x in b])) and q[0].tolist() == [0, 0, 0, 1] and q[1].tolist() == [1, 0, 0, 0]


def test_host_stats_line(spark):
    line = "12-23-2024 22:54:11 RAM 3162/7620MB (lfb 4x2MB) SWAP 0/3810MB (cached 0MB) CPU [0%@883,7%@883,0%@883,0%@883,off,off] GR3D_FREQ 1% cpu@62.843C gpu@61.687C VDD_IN 3913mW/3922mW VDD_CPU_GPU_CV 598mW/598 VDD_SOC 1238mW/1237mW"
    made = text.host_stats(F.lit(line))
    got = dict(zip(made, one(spark, *made.values()), strict=True))
    assert got["cpu_load"] == [0, 7, 0, 0, 0, 0] and got["active_cores"] == 4 and got["cpu_temp"] == 62.843 and got["vdd_soc"] == 1238 and got["ram_total"] == 7620


@pytest.mark.parametrize(("name", "want"), [("17R_weights_fp16_sz_1024x640_nms.trt", ("17R", "fp16", 1024, 640, True)), ("10S_weights_int8_sz_640.onnx", ("10S", "int8", 640, 640, False)), ("readme.txt", (None, None, None, None, None))])
def test_model_names(spark, name, want):
    assert one(spark, *text.model_name(F.lit(name)).values()) == want


def test_percent_is_truncated(spark):
    assert one(spark, units.percent(F.lit(2), F.lit(3)), units.percent(F.lit(9), F.lit(3)), units.percent(F.lit(1), F.lit(0))) == (66, 100, None)


def test_codes(spark):
    assert one(spark, codes.decode(F.lit(12), codes.REGIONS, "UNKNOWN"), codes.decode(F.lit(99), codes.REGIONS, "UNKNOWN"), codes.encode(F.lit("53S"), codes.REGIONS, 16)) == ("52S", "UNKNOWN", 13)
    assert codes.region_table(spark).count() == 17
