"""Nearest neighbours by a grid index against all pairs."""

import numpy as np
import pytest

from kinetrace.operators import points


def all_pairs(p, k):
    out = set()
    for i, x, y in p:
        near = sorted(((a - x) ** 2 + (b - y) ** 2, j) for j, a, b in p)[:k]
        out |= {(i, j, n + 1) for n, (_, j) in enumerate(near)}
    return out


SETS = {
    "even": lambda rng: rng.uniform(0, 100, (150, 2)),
    "whole numbers, with ties": lambda rng: rng.integers(0, 7, (150, 2)).astype(float),
    "a crowd and a few far ones": lambda rng: np.concatenate([rng.normal(size=(130, 2)) * 0.01, rng.uniform(-500, 500, (20, 2))]),
    "one place and others": lambda rng: np.concatenate([np.full((80, 2), 3.5), rng.uniform(0, 10, (30, 2))]),
    "one place": lambda rng: np.zeros((20, 2)),
    "a line": lambda rng: np.stack([np.arange(60.0) ** 2, np.zeros(60)], 1),
    "fewer than k": lambda rng: rng.uniform(0, 1, (3, 2)),
}


@pytest.mark.parametrize("name", SETS)
def test_nearest_points(spark, name):
    xy = SETS[name](np.random.default_rng(len(name)))
    p = [(i, float(x), float(y)) for i, (x, y) in enumerate(xy)]
    df = spark.createDataFrame([*p, (None, 1.0, 1.0), (900, None, 1.0), (901, float("nan"), 1.0)], "point_id long, x0 double, y0 double").repartition(3)
    got = {(r.point_id, r.neighbor_id, r.rank) for r in points.nearest_points(df, 4).collect()}
    assert got == all_pairs(p, 4)


def test_no_points(spark):
    assert points.nearest_points(spark.createDataFrame([], "point_id long, x0 double, y0 double"), 3).collect() == []
