"""Operator 12 against brute force: links, components and recall."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from perilune.llm import multi_index as M
from perilune.llm.op12_near_vectors import SQL, op12_near_vectors
from conftest import agree

ROWS = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=0.93):
    """(vec_id, n_links, component_id, kept) for each row, sorted."""
    takes = lambda v, label, i: i is not None and label is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    width = max([len(v or ()) for _, v, _ in rows], default=1)
    x = np.array([[*np.float32(v).astype(float), *[0.0] * (width - len(v))] if takes(v, label, i) else [0.0] * width for i, v, label in rows])
    norm = np.sqrt((x * x).sum(1))
    fine = norm > 0
    x[fine] /= norm[fine, None]
    label = np.array([-1 if r[2] is None else r[2] for r in rows])
    near = (x @ x.T >= cosine) & (label[:, None] == label[None, :]) & fine[:, None] & fine[None, :]
    np.fill_diagonal(near, False)
    comp = [r[0] for r in rows]
    seen = set()
    for k in range(len(rows)):
        if k not in seen and fine[k]:
            group, todo = {k}, [k]
            while todo:
                new = set(np.flatnonzero(near[todo.pop()]).tolist()) - group
                group |= new
                todo += new
            seen |= group
            for g in group:
                comp[g] = min(rows[h][0] for h in group)
    return sorted(((r[0], int(n), c, r[0] == c) for r, n, c in zip(rows, near.sum(1), comp, strict=True)), key=repr)


def found(spark, rows, near=M.Near()):
    return sorted(map(tuple, M.near_duplicates(spark.createDataFrame(rows, ROWS), near).collect()), key=repr)


def neighbours(rng, base, cosine):
    other = rng.normal(size=base.shape)
    other -= (other * base).sum(1, keepdims=True) * base
    return cosine * base + math.sqrt(1 - cosine**2) * other / np.linalg.norm(other, axis=1, keepdims=True)


def test_query_against_sql(spark, duck):
    agree(spark, duck, op12_near_vectors, SQL)


def test_planted_groups_and_copies(spark, duck):
    rng = np.random.default_rng(1)
    base = M.unit(rng.normal(size=(150, 12)))
    x = np.concatenate([base, neighbours(rng, base[:40], 0.97), neighbours(rng, base[:20], 0.9), base[:10], 3 * base[10:15], np.repeat(base[:1], 30, axis=0)])
    rows = [(1000 - i, v.tolist(), i % 3) for i, v in enumerate(x)]
    rows += [(2000 + i, v.tolist(), i % 3) for i, v in enumerate(x)]
    want = brute(rows)
    assert sum(r[1] > 0 for r in want) > 300
    # A limit that reaches every cell makes it exact; the default reaches nearly all.
    assert found(spark, rows, M.Near(recall=1.0, cell=1, block=16, most=8)) == want
    got = found(spark, rows, M.Near(cell=4))
    assert sum(r[1] for r in got) >= 0.99 * sum(r[1] for r in want)


def test_odd_rows(spark):
    one = [1.0, 2.0, 3.0]
    rows = [
        (1, one, 0), (2, None, 0), (3, [0.0, 0.0, 0.0], 0), (4, [1.0, None, 3.0], 0), (5, [1.0, math.nan, 3.0], 0), (6, [math.inf, 2.0, 3.0], 0), (7, one, None), (8, one, 1),
        (None, one, 0), (9, [1.0, 2.0, 3.0, 0.0], 0), (10, [2.0, 4.0, 6.0], 0), (10, [2.0, 4.0, 6.0], 0), (11, [], 0), (12, [-1.0, -2.0, -3.0], 0), (13, [1e30, 2e30, 3e30], 0), (14, [1e-30, 2e-30, 3e-30], 0), (0, [1.0, 2.0, 2.8], 0),
    ]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    clash = spark.createDataFrame(rows, ROWS).select("*", *(F.lit(1).alias(c) for c in ("v", "cls", "own", "links", "comp", "fine", "times", "a.b")))
    assert sorted(map(tuple, M.near_duplicates(clash).collect()), key=repr) == brute(rows)


def test_traversal_is_in_order_and_complete():
    rng = np.random.default_rng(2)
    a, b = rng.random((9, 5)), rng.random((9, 7))
    query, cell = M.traversed(a, b, 0.6)
    for q in range(9):
        away = (a[q] - a[q].min())[:, None] + (b[q] - b[q].min())[None, :]
        got = cell[query == q]
        assert sorted(got.tolist()) == np.flatnonzero(away.ravel() <= 0.6).tolist()
        assert (np.diff(away.ravel()[got]) >= 0).all()


@pytest.mark.parametrize("block", [64, 1024])
def test_a_cell_with_a_third_of_all_rows(spark, block):
    """Near copies in one cell: blocks bound what a task holds, and every pair counts."""
    rng = np.random.default_rng(3)
    centre = M.unit(rng.normal(size=(1, 16)))
    x = np.concatenate([M.unit(centre + 0.02 * rng.normal(size=(500, 16))), M.unit(rng.normal(size=(1000, 16)))])
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    got, want = found(spark, rows, M.Near(block=block)), brute(rows)
    assert sum(r[1] for r in got) >= 0.999 * sum(r[1] for r in want) and [r[2:] for r in got[:500]] == [r[2:] for r in want[:500]]


def test_recall_at_the_very_limit():
    """Neighbours at the wanted cosine itself, the farthest that there are, in the table's number of dimensions."""
    rng = np.random.default_rng(4)
    base = M.unit(rng.normal(size=(6000, 64)))
    grid = M.fitted(base, np.zeros(len(base)), 16, M.Near(sample=6000))
    x = M.unit(rng.normal(size=(4000, 64)))
    y = neighbours(rng, x, 0.9301)
    own, cells = grid.asked(np.concatenate([x, y]))
    met = [own[i + 4000] in cells[i] if own[i] <= own[i + 4000] else own[i] in cells[i + 4000] for i in range(4000)]
    assert np.mean(met) >= 0.99 and np.mean([len(c) for c in cells]) < 0.2 * 256
