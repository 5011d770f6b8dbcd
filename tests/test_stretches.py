"""Long series: scans over stretches, dyadic intervals, exact medians and Allan factors by blocks, each against its plain form or brute force."""

import statistics

import numpy as np
import pytest
from conftest import agree
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from perilune.operators import sequence as S
from perilune.plans.catalogue import QUERIES, SQL

slow = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
series = st.lists(st.tuples(st.sampled_from([1, 2, None]), st.integers(0, 60), st.one_of(st.none(), st.integers(0, 6))), min_size=1, max_size=40)


@pytest.mark.parametrize("name", ["long_series_groups", "long_series_violations", "long_series_load", "long_series_stalled", "interval_overlap_pairs", "median_representative", "unit_autodetect", "allan_all_factors"])
def test_queries_against_sql(spark, duck, name):
    agree(spark, duck, QUERIES[name], SQL[name])


@slow
@given(series)
def test_stretches_change_nothing(spark, rows):
    df = spark.createDataFrame([(k, t, i, v, 3 * (v or 0) + t) for i, (k, t, v) in enumerate(rows)], "k int, t long, i long, v int, w long")
    order = ["t", "i"]
    ops = [
        lambda width: S.start_flags(df, "k", order, "v", width=width),
        lambda width: S.group_ids(S.start_flags(df, "k", order, "v"), "k", order, width=width),
        lambda width: S.violations(df, "k", order, "v", width=width),
        lambda width: S.counter_load(df, "k", order, "v", "w", width=width),
        lambda width: S.stalled(df.where("v is not null"), "k", order, "v", 2, width=width),
        lambda width: S.numbered(df, "k", order, width=width),
    ]
    for op in ops:
        whole, cut = op(None), op(7)
        assert whole.columns == cut.columns and sorted(map(repr, whole.collect())) == sorted(map(repr, cut.collect()))


def test_one_key_of_millions_is_spread(spark):
    """No task of the scan holds more than a small share of a series of one key."""
    n, width = 2_000_000, 50_000
    df = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("t"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("v"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = S.group_ids(S.start_flags(df, "k", ["t"], "v", width=width), "k", ["t"], width=width)
        got = rows.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count("*").alias("c"), F.max("group_id").alias("g")).collect()
        assert sum(r.c for r in got) == n and max(r.c for r in got) < n / 3
        values = [r.v for r in df.orderBy("t").select("v").limit(5000).collect()]
        want = sum(a != b for a, b in zip(values, values[1:], strict=False))
        assert rows.where("t = 4999").first().group_id == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@slow
@given(st.lists(st.tuples(st.integers(-50, 50), st.one_of(st.integers(0, 4), st.integers(0, 3000))), max_size=25), st.sampled_from([1, 5, 64]))
def test_dyadic_overlaps_equal_brute_force(spark, rows, width):
    spans = [(i, a, a + n) for i, (a, n) in enumerate(rows)]
    df = spark.createDataFrame(spans, "id int, a long, b long")
    got = sorted((r.id, r.id_b) for r in S.overlapping(df, df, "a", "b", width).collect())
    assert got == sorted((x[0], y[0]) for x in spans for y in spans if x[1] <= y[2] and y[1] <= x[2])


def test_an_interval_of_a_billion_buckets(spark):
    """It is stored as some dozens of blocks."""
    rows = [(0, -3, 10**9), (1, 5, 5), (2, 10**9, 10**9 + 7), (3, 10**9 + 1, 10**9 + 2), (4, -9, -4), (5, 7, 3), (6, None, 4)]
    df = spark.createDataFrame(rows, "id int, a long, b long")
    got = sorted((r.id, r.id_b) for r in S.overlapping(df, df, "a", "b", 1).where("id < id_b").collect())
    assert got == [(0, 1), (0, 2), (2, 3)]
    lo, hi = F.lit(-3).cast("long"), F.lit(10**9).cast("long")
    pieces = spark.range(1).select(F.explode(S._pieces(lo, hi, 30)).alias("x")).select("x.*").collect()
    held = sorted((p.i << p.level, (p.i + 1) << p.level) for p in pieces)
    assert len(held) < 60 and held[0][0] == -3 and held[-1][1] == 10**9 + 1 and all(x[1] == y[0] for x, y in zip(held, held[1:], strict=False))


@slow
@given(st.lists(st.tuples(st.sampled_from([1, 2, None]), st.one_of(st.none(), st.floats(-1e300, 1e300), st.integers(0, 3).map(float))), min_size=1, max_size=200), st.sampled_from([1, 16, 1000]))
def test_medians_are_exact(spark, rows, most):
    df = spark.createDataFrame(rows, "k int, v double")
    got = {r.k: r.median for r in S.medians(df, "k", "v", most).collect()}
    want = {}
    for k, v in rows:
        if v is not None:
            want.setdefault(k, []).append(v)
    assert got == {k: 0.5 * statistics.median_low(v) + 0.5 * statistics.median_high(v) if statistics.median_low(v) != statistics.median_high(v) else statistics.median_low(v) for k, v in want.items()}


def test_median_of_one_large_group_narrows(spark):
    """A million values with heavy ties and outliers beside a small key: two passes leave what one window may count."""
    df = spark.range(1_000_001).select(F.lit(1).alias("k"), F.when(F.col("id") % 3 == 0, F.lit(0.5)).otherwise(F.exp(F.pmod(F.xxhash64("id"), F.lit(10**6)) / 2e3)).alias("v"))
    df = df.unionByName(spark.createDataFrame([(2, 4.0), (2, 1.0), (2, float("nan")), (2, None)], "k int, v double"))
    got = {r.k: r.median for r in S.medians(df, "k", "v", 5000).collect()}
    values = np.sort(np.array([r.v for r in df.where("k = 1").select("v").collect()]))
    assert got == {1: values[500_000], 2: 2.5}


@pytest.mark.parametrize(("n", "size"), [(1, 4), (2, 4), (3, 4), (17, 4), (64, 8), (65, 8), (100, 7), (50, 100)])
def test_allan_factors_by_blocks(spark, n, size):
    rng = np.random.default_rng(n)
    x = rng.integers(-100, 100, n).astype(float)
    df = spark.createDataFrame([(7, i * 10, float(v)) for i, v in enumerate(x)], "k int, t long, v double")
    got = {r.m: (r.terms, r.squares) for r in S.allan_all(df, "k", ["t"], "v", size, width=130).collect()}
    want = {}
    for m in range(1, (n - 1) // 2 + 1):
        d = x[2 * m :] - 2 * x[m : n - m] + x[: n - 2 * m]
        want[m] = (len(d), float(d @ d))
    assert got == want
