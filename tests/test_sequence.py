import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from perilune.operators import sequence as S

times = st.lists(st.tuples(st.integers(0, 2), st.integers(0, 30)), min_size=0, max_size=25)
slow = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@slow
@given(times, times)
def test_asof_equals_brute_force(spark, left, right):
    a = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(left)], "k int, t long, id int")
    b = spark.createDataFrame(sorted(set(right)), "k int, t long").selectExpr("k", "t", "t * 10 as v")
    got = {r.id: r.r_t for r in S.asof(a, b, "k", "t", ["v"]).collect()}
    for i, (k, t) in enumerate(left):
        near = sorted({x for q, x in right if q == k}, key=lambda x: (abs(x - t), x))
        assert got[i] == (near[0] if near else None)
    assert len(got) == len(left)
    # Cut into stretches, many of them empty on one side, nothing changes.
    for how in ("nearest", "backward", "forward"):
        whole = S.asof(a, b, "k", "t", ["v"], how).collect()
        assert sorted(whole) == sorted(S.asof(a, b, "k", "t", ["v"], how, width=4).collect())


def test_one_long_series_is_read_in_linear_time(spark):
    """200,000 rows of one key: frames that grow row by row, not ones that are computed anew for each row."""
    import time

    from pyspark.sql import functions as F

    left = spark.range(200_000).select(F.lit(1).alias("k"), (F.col("id") * 10).alias("t"), "id")
    right = spark.range(200_000).select(F.lit(1).alias("k"), (F.col("id") * 10 + 3).alias("t"), "id")
    for width in (None, 100_000):
        begun = time.time()
        rows = S.asof(left, right, "k", "t", ["id"], width=width).agg(F.sum("r_id"), F.count("*")).first()
        assert tuple(rows) == (sum(range(200_000)), 200_000) and time.time() - begun < 60


def test_null_keys_and_times_match_nothing(spark):
    left = spark.createDataFrame([(None, 5, 1), (1, None, 2), (1, 5, 3)], "k int, t long, id int")
    right = spark.createDataFrame([(None, 5, 7), (1, None, 8), (1, 4, 9)], "k int, t long, v int")
    for width in (None, 2):
        assert {r.id: r.r_v for r in S.asof(left, right, "k", "t", ["v"], "backward", width=width).collect()} == {1: None, 2: None, 3: 9}


@slow
@given(times)
def test_overlaps_equal_brute_force(spark, rows):
    spans = [(i, t, t + k * 7) for i, (k, t) in enumerate(rows)]
    df = spark.createDataFrame(spans, "id int, a long, b long")
    got = sorted((r.id, r.id_b) for r in S.overlapping(df, df, "a", "b", 5).collect())
    assert got == sorted((x[0], y[0]) for x in spans for y in spans if x[1] <= y[2] and y[1] <= x[2])


@pytest.mark.parametrize(
    ("a", "b", "meets"),
    [((5000, 15000), (1000, 11000), True), ((1000, 11000), (5000, 15000), True), ((1000, 61000), (5000, 10000), True), ((1000, 11000), (1000, 11000), True), ((1000, 11000), (20000, 30000), False), ((1000, 11000), (11001, 21001), False)],
)
def test_overlap_truth_table(spark, a, b, meets):
    x, y = spark.createDataFrame([a], "a long, b long"), spark.createDataFrame([b], "a long, b long")
    assert S.overlapping(x, y, "a", "b", 10000).count() == meets


def test_group_starts_and_ids(spark):
    df = spark.createDataFrame([(1, i, g) for i, g in enumerate([0, 0, 1, 1, 3])], "k int, i int, g int")
    rows = S.group_ids(S.start_flags(df, "k", ["i"], "g"), "k", ["i"]).orderBy("i").collect()
    assert [r.starts for r in rows] == [True, False, True, False, True]
    assert [r.group_id for r in rows] == [0, 0, 1, 1, 2]


def test_interpolation_holds_the_ends(spark):
    left = spark.createDataFrame([(1, t) for t in (0, 10, 15, 20, 99)], "k int, t long")
    right = spark.createDataFrame([(1, 10, 100), (1, 20, 200)], "k int, t long, v long")
    assert [r.interpolated for r in S.interpolate(left, right, "k", "t", "v").orderBy("t").collect()] == [100, 100, 150, 200, 200]


def test_central_difference_of_single_row_is_zero(spark):
    assert S.central_difference(spark.createDataFrame([(1, 5, 7)], "k int, t long, v long"), "k", ["t"], "t", "v").first().rate == 0


def test_stalled_rounds_fail_at_the_limit(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([1, 2, 2, 2, 3, 3])], "k int, i int, v int")
    rows = S.stalled(df, "k", ["i"], "v", 2).orderBy("i").collect()
    assert [r.stalled for r in rows] == [0, 0, 1, 2, 0, 1] and [r.failed for r in rows] == [False, False, False, True, False, False]


def test_gaps_and_reassembly(spark):
    df = spark.createDataFrame([(1, 2, "c"), (1, 0, "a"), (1, 0, "a"), (2, 0, "x")], "k int, n int, p string")
    assert [tuple(r) for r in S.gaps(df, "k", "n").collect()] == [(1, 1, 1)]
    stray = spark.createDataFrame([(1, 10**15), (1, 3), (1, 4), (None, 1), (2, None), (2, -5)], "k int, n long")
    assert sorted(map(str, S.gaps(stray, "k", "n").collect())) == ["Row(k=1, first=0, last=2)", "Row(k=1, first=5, last=999999999999999)", "Row(k=None, first=0, last=0)"]
    assert {r.k: (r.present, r.largest, r.missing) for r in S.coverage(stray, "k", "n").collect()} == {1: (3, 10**15, 10**15 - 2), None: (1, 1, 1), 2: (0, None, 0)}
    assert {r.k: r.payload for r in S.reassemble(df, "k", "n", "p").collect()} == {1: "ac", 2: "x"}


def test_counter_load_is_truncated_and_held(spark):
    df = spark.createDataFrame([(1, 0, 0, 0), (1, 1, 1, 3), (1, 2, 1, 3), (1, 3, 9, 10)], "k int, i int, idle long, total long")
    assert [r.load for r in S.counter_load(df, "k", ["i"], "idle", "total").orderBy("i").collect()] == [0, 66, 0, 0]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k int, t long, v long")
    assert S.asof(none, none, "k", "t", ["v"]).count() == 0
    assert S.gaps(none, "k", "v").count() == 0
    assert S.violations(none, "k", ["t"], "v").count() == 0
