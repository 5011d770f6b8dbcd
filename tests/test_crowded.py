"""Suppression by cells and rounds against the walk of one group."""

import random
from functools import partial

import pandas as pd
import pyarrow as pa
import pytest

from perilune.operators import detection as D
from perilune.operators.crowded import _Grid, _walked, suppress_crowded

SCHEMA = "frame int, box_id long, score double, x double, y double, w double, h double, class_id int"


def brute(rows, threshold=0.45):
    kept = set()
    for frame in {r[0] for r in rows}:
        group = pd.DataFrame([r[1:] for r in rows if r[0] == frame and r[2] is not None and r[2] > 0.5], columns=["box_id", "score", "x", "y", "w", "h", "class_id"])
        kept |= {(frame, b) for b in (D.suppress(group, threshold)["box_id"] if len(group) else ())}
    return kept


def got(spark, rows, **kw):
    out = suppress_crowded(spark.createDataFrame(rows, SCHEMA), "frame", **{"few": 0} | kw).collect()
    assert len(out) == len({(r.frame, r.box_id) for r in out})
    return {(r.frame, r.box_id) for r in out}


@pytest.mark.parametrize("threshold", [0.45, 0.8, 0.1])
def test_crowded_frames_equal_the_walk(spark, threshold):
    rng = random.Random(11)
    rows = [
        (k % 2, k, rng.choice([0.4, 0.6, 0.7, rng.uniform(0.5, 1)]), rng.uniform(-40, 40), rng.uniform(-40, 40), 2 ** rng.uniform(-1, 5), 2 ** rng.uniform(-1, 5), rng.randrange(2))
        for k in range(1500)
    ]
    assert got(spark, rows, threshold=threshold) == brute(rows, threshold) == got(spark, rows, threshold=threshold, few=300)


def test_edges_of_levels_and_cells(spark):
    """Sizes at powers of the ratio, overlaps at the very threshold, equal boxes, and a full cell."""
    rng = random.Random(2)
    rows = [(0, k, rng.choice([0.6, 0.8, 0.9]), float(rng.randrange(-3, 4)), float(rng.randrange(-3, 4)), 2.0 ** rng.randrange(0, 4), 2.0 ** rng.randrange(0, 4), 0) for k in range(500)]
    rows += [(1, 1000 + k, 0.6 + k % 7 / 100, 5.0, 5.0, 3.0, 3.0, 1) for k in range(400)]
    assert got(spark, rows, threshold=0.5) == brute(rows, 0.5)


def test_scores_that_rise_across_a_frame(spark):
    """One long chain: undecided after the rounds, and right nevertheless."""
    rows = [(0, k, 0.5 + (k + 1) / 1000, k * 0.3, 0.0, 1.0, 1.0, 0) for k in range(400)]
    assert got(spark, rows, rounds=2) == brute(rows) == {(0, k) for k in range(399, -1, -2)}


def test_odd_boxes_stay_and_odd_scores_go(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, 0.9, 0.0, 0.0, 2.0, 2.0, 0), (0, 2, 0.8, 0.0, 0.0, 2.0, 2.0, 0), (0, 3, None, 0.0, 0.0, 2.0, 2.0, 0), (0, 4, 0.5, 9.0, 9.0, 2.0, 2.0, 0)]
    rows += [(0, 5, 0.8, nan, 0.0, 2.0, 2.0, 0), (0, 6, 0.8, 0.0, None, 2.0, 2.0, 0), (0, 7, 0.8, 0.0, 0.0, 0.0, 2.0, 0), (0, 8, 0.8, 0.0, 0.0, inf, 2.0, 0), (None, 9, 0.8, 0.0, 0.0, 2.0, 2.0, 0), (0, 10, 0.8, 0.0, 0.0, 2.0, 2.0, None)]
    assert got(spark, rows) == {(0, 1), (0, 5), (0, 6), (0, 7), (0, 8), (None, 9), (0, 10)}
    assert got(spark, [rows[0]] * 3) == {(0, 1)} and got(spark, []) == set()
    with pytest.raises(ValueError):
        suppress_crowded(spark.createDataFrame([], SCHEMA), "frame", 1.0)


def test_copies_of_boxes_are_never_broadcast(spark):
    """What a box is copied to for its cells is far more than the box, and must not meet in one place."""
    rows = [(k % 3, k, 0.6 + k % 301 / 1000, k * 37 % 997 / 2, k * 61 % 991 / 2, 5.0 + k % 20, 6.0 * (1 + k % 4), 0) for k in range(3000)]
    limit = "spark.sql.maxBroadcastTableSize"
    spark.conf.set(limit, "40m")
    try:
        assert got(spark, rows) == brute(rows)
    finally:
        spark.conf.unset(limit)


def test_a_round_settles_chains_inside_a_tile(spark):
    """No job for each link of a chain: four frames whose boxes wait for one another from one end to the other."""
    rows = [(f, 1000 * f + k, 0.5 + (k + 1) / 1000, k * 0.3 + 7.0 * f, 0.0, 1.0, 1.0, 0) for f in range(4) for k in range(400)]
    spark.sparkContext.setJobGroup("chains", "chains")
    try:
        assert got(spark, rows) == brute(rows)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("chains")) < 200
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_blocks_of_rows_and_dense_places_equal_the_walk():
    """Tiles that go over many blocks, blocks of many tiles, and places where all overlap."""
    rng = random.Random(5)
    rows = [(k // 900 if k < 1800 else 2 + k // 3, k, rng.choice([0.6, 0.7, rng.uniform(0.5, 1)]), rng.uniform(-9, 9), rng.uniform(-9, 9), 2 ** rng.uniform(0, 4), 2 ** rng.uniform(0, 4), 0) for k in range(3000)]
    rows += [(-1, 5000 + k, 0.9 - k % 11 / 100, k % 5 / 10, 0.0, 3.0, 3.0, 0) for k in range(700)]
    frame = pd.DataFrame(sorted(rows, key=lambda r: (r[0], -r[2], *r[1:2], *r[3:])), columns=["_key", "box_id", "score", *"xywh", "class_id"])
    table = pa.Table.from_pandas(frame.assign(_how=frame["_key"] * 4 + 2), preserve_index=False)
    for block, most in ((70, 500), (1000, 1 << 22)):
        out = pa.Table.from_batches(_walked(table.to_batches(64), _Grid(0.45), ["_key", "box_id", "_open"], block, most)).to_pandas()
        assert not out["_open"].any() and len(out) == len(found := set(zip(out["_key"], out["box_id"], strict=True)))
        assert found == brute(rows)


def test_the_query_equals_the_walk(spark, monkeypatch):
    from conftest import DATA

    from perilune.plans import frame_queries

    monkeypatch.setattr(frame_queries, "suppress_crowded", partial(suppress_crowded, few=500))
    found = {tuple(r) for r in frame_queries.nms_crowded(spark, DATA).select("camera", "box_id").collect()}
    monkeypatch.setattr(frame_queries, "suppress_crowded", D.non_maximum_suppression)
    assert found == {tuple(r) for r in frame_queries.nms_crowded(spark, DATA).select("camera", "box_id").collect()}
