"""What the physical plans must look like."""

import pytest
from conftest import DATA

from perilune.plans.catalogue import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_multiplies_its_tables(spark, name):
    text = plan(QUERIES[name](spark, DATA))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scans_read_only_what_is_asked(spark):
    text = plan(QUERIES["topn_unsent"](spark, DATA))
    assert "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string>" in text and "EqualTo(l_returnflag,R)" in text


def test_alignment_is_one_shuffle(spark):
    from perilune.operators.sequence import asof
    from perilune.plans.series_queries import _sides

    left, right = _sides(spark, DATA)
    assert plan(asof(left, right, "user_id", "us", ["id"])).count("Exchange hashpartitioning") == 1
    # Cut into stretches, the rows still move once; the ends of stretches, a row each, move besides.
    assert plan(QUERIES["asof_nearest"](spark, DATA)).count("Exchange hashpartitioning") <= 4


def test_no_python_in_sql_expressible_paths(spark):
    python = {n for n in QUERIES if any(w in plan(QUERIES[n](spark, DATA)) for w in ("Python", "Pandas", "MapInArrow"))}
    assert python == {"crc16_payload", "nms_greedy", "wahba_attitude", "od_solve", "od_invariants", "chunk_transfer_packets", "packet_answers", "radio_streams", "telemetry_logs", "allan_all_factors", "active_duplicates", "processed_frames"}
