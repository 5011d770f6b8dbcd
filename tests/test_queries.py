"""Every registered query of the library against its SQL at the smallest scale."""

import pytest
from conftest import DATA, agree

from perilune.plans.catalogue import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, duck, name):
    agree(spark, duck, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_crc_is_of_whole_texts(spark):
    from perilune.functions.binary import crc5, crc16

    texts = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect()}
    assert max(len((t or "").encode()) for t in texts.values()) > 240
    for r in QUERIES["crc16_payload"](spark, DATA).collect():
        t = texts[r.conv_id, r.turn]
        assert (r.crc16, r.crc5) == ((None, None) if t is None else (crc16(t.encode()), crc5(t.encode())))


@pytest.mark.parametrize("name, column", [("fixed_packet_roundtrip", None), ("message_frames", "length")])
def test_whole_texts_are_framed(spark, name, column):
    sizes = [len((r.text or "").encode()) for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect()]
    rows = QUERIES[name](spark, DATA).collect()
    assert sum(r[column] for r in rows) == sum(sizes) if column else len(rows) == sum(-(-n // 240) for n in sizes)


def test_every_nation_is_solved(spark):
    nations = {str(r.n_nationkey) for r in spark.read.parquet(f"{DATA}/nation.parquet").collect()}
    rows = QUERIES["od_solve"](spark, DATA).collect()
    assert {r.dataset_id for r in rows} == nations and len(rows) == 6 * len(nations)


def test_every_region_is_decoded(spark):
    rows = QUERIES["region_codes"](spark, DATA).collect()
    assert len(rows) == spark.read.parquet(f"{DATA}/part.parquet").count() and len({r.code for r in rows}) == 17


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 25
    assert set(e.oracle_sql()) <= set(e.queries())


def _embeddings(spark, duck, tmp_path, name, rows):
    """A query and its SQL over some embeddings: both sides' rows, sorted."""
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    sql = f"with embeddings as (select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')), " + SQL[name].strip().removeprefix("with ") if SQL[name].startswith("with ") else SQL[name].replace("from embeddings", f"from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    found = duck.sql(sql)
    return sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).select(*found.columns).collect()), sorted(found.fetchall())


def test_positions_turn_back_at_any_time(spark, duck, tmp_path):
    """Vectors whose numbers put them up to 2,700 years after J2000, and before it, near the pole and off it."""
    rows = [(k, [0.3 * ((k // 7) % 3 - 1), 0.1 * (k % 5), 0.2 + 0.1 * (k % 2)] + [0.1] * 13, 0) for k in (0, 1, 9_999, 15_000, 51_281, 102_564, 400_001, 999_999, -200_000)]
    found, want = _embeddings(spark, duck, tmp_path, "earth_orientation", rows)
    assert found == want and len(found) == len(rows)


@pytest.mark.parametrize("name, threshold", [("score_threshold", 0.15), ("detector_best_class", 0.2)])
def test_float_scores_at_the_very_threshold(spark, duck, tmp_path, name, threshold):
    import numpy as np

    at = np.float32(threshold)
    rows = [(k, [0.0] * 5 + [float(s), 0.0], 0) for k, s in enumerate((at, np.nextafter(at, np.float32(1)), np.nextafter(at, np.float32(0)), np.float32(0.5)))]
    found, want = _embeddings(spark, duck, tmp_path, name, rows)
    assert found == want and {r[0] for r in found} == {1, 3}
