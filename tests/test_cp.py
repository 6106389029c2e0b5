"""CP decompositions: full passes against numpy, penalties, sampled fibres, many indices."""

import numpy as np
import pytest

from kinetrace.operators import cp

DIMS = ["i", "j", "k"]


def cells_of(spark, tensors):
    rows = [(e, *map(int, at), float(x[tuple(at)])) for e, x in tensors.items() for at in np.ndindex(x.shape)]
    return spark.createDataFrame(rows, "elem string, i long, j long, k long, value double").repartition(3)


def arrays(fit, dims=DIMS):
    out: dict = {}
    for r in fit.factors.collect():
        out.setdefault(r["elem"], {}).setdefault(r["mode"], {})[r["idx"], r["r"]] = r["value"]
    return {e: {d: np.array([[f[i, r] for r in range(1 + max(r for _, r in f))] for i in range(1 + max(i for i, _ in f))]) for d, f in modes.items()} for e, modes in out.items()}


def error(x, f):
    return np.linalg.norm(x - np.einsum("ir,jr,kr->ijk", *[f[d] for d in DIMS])) / np.linalg.norm(x)


@pytest.fixture(scope="module")
def tensors():
    rng = np.random.default_rng(0)
    made = {e: np.einsum("ir,jr,kr->ijk", *[rng.random((n, 2)) for n in (4 + s, 5, 6)]) for s, e in enumerate("ab")}
    return made | {"zero": np.zeros((2, 2, 2))}


@pytest.mark.parametrize("non_negative", [True, False])
def test_full_passes(spark, tensors, non_negative):
    fit = cp.CP(2, non_negative, iterations=8).fit(cells_of(spark, tensors), DIMS)
    got = arrays(fit)
    exact = {r["elem"]: r["error"] for r in cp.residuals(cells_of(spark, tensors), DIMS, fit.factors).collect()}
    for e, x in tensors.items():
        objectives = [o for _, elem, o, _ in fit.history if elem == e]
        assert all(b <= a + 1e-9 for a, b in zip(objectives, objectives[1:], strict=False))
        told = fit.history[-len(tensors) :][sorted(tensors).index(e)][3]
        assert abs(told - exact[e]) < 1e-6
        if e == "zero":
            assert told == 0 and any((f == 0).all() for f in got[e].values())
        else:
            assert abs(told - error(x, got[e])) < 1e-6 and told < 0.2
            assert not non_negative or all((f >= 0).all() for f in got[e].values())


def test_an_update_is_the_least_squares_solution(spark, tensors):
    """After a plain sweep the last mode solves its normal equations, against numpy's."""
    f = arrays(cp.CP(2, False, iterations=2).fit(cells_of(spark, {"a": tensors["a"]}), DIMS))["a"]
    z = np.einsum("ir,jr->ijr", f["i"], f["j"]).reshape(-1, 2)
    want = np.linalg.lstsq(z, tensors["a"].reshape(-1, 6), rcond=None)[0].T
    assert np.allclose(f["k"], want, atol=1e-8)


def test_elements_do_not_meet(spark, tensors):
    together = arrays(cp.CP(2, iterations=3).fit(cells_of(spark, tensors), DIMS))
    alone = arrays(cp.CP(2, iterations=3).fit(cells_of(spark, {"b": tensors["b"]}), DIMS))
    assert all(np.allclose(together["b"][d], alone["b"][d]) for d in DIMS)


def test_proximal_steps():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 4))
    p = cp.nearest(x, cp.Penalty(simplex=True), 1.0)
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all()
    for row, near in zip(x, p, strict=True):  # no point of the simplex is nearer
        other = rng.dirichlet(np.ones(4), 200)
        assert (np.linalg.norm(other - row, axis=1) >= np.linalg.norm(near - row) - 1e-12).all()
    assert np.allclose(cp.nearest(x, cp.Penalty(False, sparsity=0.5), 1.0), np.sign(x) * np.maximum(abs(x) - 0.5, 0))
    d, links, rhs = 3 + rng.random((30, 2)), rng.random((29, 2)), rng.normal(size=(30, 2))
    got = cp.tridiagonal(d, links, rhs)
    for c in range(2):
        assert np.allclose((np.diag(d[:, c]) - np.diag(links[:, c], 1) - np.diag(links[:, c], -1)) @ got[:, c], rhs[:, c])


@pytest.mark.parametrize("block", [16, 4096])
def test_penalties_hold(spark, monkeypatch, block):
    monkeypatch.setattr(cp, "BLOCK", block)
    rng = np.random.default_rng(2)
    a, b, c = rng.random((5, 2)), rng.random((6, 2)), np.abs(np.cumsum(rng.normal(size=(150, 2)), axis=0))
    x = np.einsum("ir,jr,kr->ijk", a, b, c) + 0.3 * rng.random((5, 6, 150))
    cells = cells_of(spark, {"a": x})
    penalties = {"i": cp.Penalty(simplex=True), "j": cp.Penalty(sparsity=30.0), "k": cp.Penalty(smoothness=2.0)}
    fit = cp.CP(2, penalties=penalties, iterations=4).fit(cells, DIMS)
    f = arrays(fit)["a"]
    plain = arrays(cp.CP(2, iterations=4).fit(cells, DIMS))["a"]
    assert np.allclose(f["i"].sum(axis=1), 1) and all((v >= 0).all() for v in f.values())
    rough = lambda v: (np.diff(v, axis=0) ** 2).sum() / (v**2).sum()
    assert rough(f["k"]) < rough(plain["k"]) and (f["j"] == 0).sum() > (plain["j"] == 0).sum()
    objectives = [h[2] for h in fit.history]
    assert all(q <= p + 1e-9 for p, q in zip(objectives, objectives[1:], strict=False))
    model = np.einsum("ir,jr,kr->ijk", f["i"], f["j"], f["k"])
    want = ((x - model) ** 2).sum() / 2 + 30 * abs(f["j"]).sum() + (np.diff(f["k"], axis=0) ** 2).sum()
    assert abs(objectives[-1] - want) < 1e-6 * want
    if block == 16:  # blocks with margins are the whole mode's solution
        monkeypatch.setattr(cp, "BLOCK", 4096)
        whole = arrays(cp.CP(2, penalties=penalties, iterations=4).fit(cells, DIMS))["a"]
        assert all(np.allclose(whole[d], f[d], atol=1e-8) for d in DIMS)


def test_sampled_fibres_find_known_factors(spark):
    rng = np.random.default_rng(3)
    x = np.einsum("ir,jr,kr->ijk", *[rng.random((n, 2)) for n in (12, 15, 18)])
    cells = cells_of(spark, {"a": x})
    fit = cp.CP(2, samples=128, iterations=6).fit(cells, DIMS)  # of 180 to 270 fibres a mode
    assert error(x, arrays(fit)["a"]) < 0.1
    once, again = (arrays(cp.CP(2, samples=16, iterations=1).fit(cells, DIMS))["a"] for _ in range(2))
    assert all(np.allclose(again[d], v) for d, v in once.items())


def test_draws_follow_the_leverage(spark):
    rng = np.random.default_rng(4)
    v = rng.random((40, 2)) * np.where(np.arange(40) < 3, 30, 1)[:, None]
    rows = spark.createDataFrame([("a", i, row.tolist()) for i, row in enumerate(v)], "elem string, idx long, v array<double>")
    g = v.T @ v
    fit = cp.CP(2, samples=4000)
    got = fit._with_draws(cp.Factor(rows, {"a": np.concatenate([g.ravel(), [0, 0, 0]])}), 1, "i").draws.collect()
    want = ((v @ np.linalg.inv(g)) * v).sum(axis=1) / 2
    assert sorted(r["_t"] for r in got) == list(range(4000))
    n = np.bincount([r["_i"] for r in got], minlength=40)
    assert (abs(n - 4000 * want) <= 2).all() and all(abs(r["_p"] - want[r["_i"]]) < 1e-9 for r in got)


def test_a_long_mode_stays_in_tables(spark):
    """300,000 indices in a mode: no row of them reaches the driver, repeated cells add up, nulls are left out."""
    from pyspark.sql import functions as F

    n = 300_000
    cells = spark.range(n).select(F.lit("a").alias("elem"), F.explode(F.array(F.lit(0), F.lit(1))).alias("i"), (F.col("id") % 3).alias("j"), F.col("id").alias("k"))
    cells = cells.withColumn("value", ((F.col("i") + 1) * (F.col("j") + 1) * (1 + F.col("k") % 5)) / 2.0)
    twice = cells.union(cells).union(spark.createDataFrame([("a", None, 1, 1, 1.0), ("a", 1, 1, 1, None)], "elem string, i int, j long, k long, value double"))
    fit = cp.CP(1, iterations=1).fit(twice, DIMS)
    assert fit.factors.where("mode = 'k'").count() == n
    assert cp.CP(1).fit(twice.limit(0), DIMS).factors.count() == 0
