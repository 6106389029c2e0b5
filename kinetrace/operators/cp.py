"""CP decomposition of long tables: full, penalised or from sampled fibres, with factors that stay tables.

A tensor is (elem, <dims>, value); every element is factored for itself, all in the same
plan. A mode's factor is a table (elem, idx, v) with a row for each index that has a
cell (others would be zero) and v the components. A pass over a mode

* joins the cells with the other modes' factors and sums them by the mode's index (the
  matricised tensor times Khatri-Rao product, M); Spark broadcasts factors whose table is
  small and shuffles the others, and sums within tasks before it shuffles;
* updates rows against M and the r x r products of the other factors (G);
* writes the new factor to the shared folder, with the sums that the next passes need
  (its own r x r product, its part of the objective) as rows without an index. These
  r * r + 3 numbers an element are all that the driver collects.

Updates: non-negative coordinate descent (HALS), plain least squares, or, where a mode
has a ``Penalty``, the alternating direction method: a ridge step against G, then the
penalty's proximal step, a few times. Penalties add up in the objective

    1/2 |X - model|^2 + sparsity |A|_1 + smoothness/2 sum |A[i+1] - A[i]|^2,

rows are kept non-negative or on the simplex if asked. A row whose part of the objective
would rise keeps its value; with smoothness, where rows depend on each other, the same
holds for a whole mode of an element. Smooth modes are solved in blocks of ``BLOCK``
indices with a margin beyond which neighbours have no effect (less than 1e-12).

Sampled passes (``samples``) solve the least squares problem on some fibres: index tuples
of the other modes, each index drawn by its leverage score, a stratified draw by running
sums within blocks and over blocks, paired at random, weighted by the inverse of
its probability. Only the cells of drawn fibres are multiplied and summed.

Defined cases: cells that repeat add up, null values and indices are left out, an
element without cells has no factor, a zero tensor has a model of zeros (and an error of
0). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinetrace.storage import keep

#: Indices in a block of a smooth mode, and of the running sums of a draw.
BLOCK = 4096
#: Alternations of a penalised update, and passes of coordinate descent over the components.
INNER, DESCENTS = 12, 2


@dataclass(frozen=True)
class Penalty:
    """What a mode's factor is held to; smoothness couples rows of neighbouring indices."""

    non_negative: bool = True
    sparsity: float = 0.0
    smoothness: float = 0.0
    simplex: bool = False

    def __post_init__(self) -> None:
        if self.simplex and (self.sparsity or self.smoothness):
            raise ValueError("rows on the simplex are neither sparse by their sums nor smoothed here")
        if min(self.sparsity, self.smoothness) < 0:
            raise ValueError("weights of penalties are not negative")


def nearest(x: np.ndarray, penalty: Penalty, step: float) -> np.ndarray:
    """The proximal step of a penalty without its smoothness."""
    if penalty.simplex:
        # the threshold that leaves each row's positive part with a sum of one
        ordered = -np.sort(-x, axis=1)
        excess = (np.cumsum(ordered, axis=1) - 1) / np.arange(1, x.shape[1] + 1)
        n = (ordered > excess).sum(axis=1)
        return np.maximum(x - excess[np.arange(len(x)), n - 1][:, None], 0)
    if penalty.non_negative:
        return np.maximum(x - penalty.sparsity * step, 0)
    return np.sign(x) * np.maximum(np.abs(x) - penalty.sparsity * step, 0)


def tridiagonal(diagonal: np.ndarray, links: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """x of (diagonal - links beside it) x = rhs, for many columns at once; links (n - 1, columns) are not negative."""
    n = len(rhs)
    c, x = np.zeros_like(rhs), rhs.copy()
    scale = diagonal[0].copy()
    x[0] /= scale
    for i in range(1, n):
        c[i - 1] = -links[i - 1] / scale
        scale = diagonal[i] + links[i - 1] * c[i - 1]
        x[i] = (x[i] + links[i - 1] * x[i - 1]) / scale
    for i in range(n - 2, -1, -1):
        x[i] -= c[i] * x[i + 1]
    return x


def objective_rows(a: np.ndarray, m: np.ndarray, g: np.ndarray, penalty: Penalty | None) -> np.ndarray:
    """Each row's part of the objective, smoothness and |X|^2 apart."""
    return ((a @ g) * a).sum(axis=1) / 2 - (m * a).sum(axis=1) + (penalty.sparsity * np.abs(a).sum(axis=1) if penalty else 0.0)


def alternated(a: np.ndarray, m: np.ndarray, g: np.ndarray, penalty: Penalty, linked: np.ndarray | None = None) -> np.ndarray:
    """Rows after ``INNER`` alternations; ``linked``: whether a row and the next are neighbours."""
    r = len(g)
    rho = max(np.trace(g) / r, 1e-12)
    values, vectors = np.linalg.eigh(g)
    values = np.maximum(values, 0) + rho
    h, u = a, np.zeros_like(a)
    if linked is not None and penalty.smoothness:
        links = np.repeat(linked[:, None] * penalty.smoothness, r, axis=1)
        diagonal = np.repeat(values[None, :], len(a), axis=0)
        diagonal[:-1] += links
        diagonal[1:] += links
        solve = lambda x: tridiagonal(diagonal, links, x @ vectors) @ vectors.T
    else:
        solve = lambda x: (x @ vectors) / values @ vectors.T
    for _ in range(INNER):
        ridge = solve(m + rho * (h + u))
        h = nearest(ridge - u, penalty, 1 / rho)
        u = u + h - ridge
    return h


def descended(a: np.ndarray, m: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Rows after coordinate descent under non-negativity."""
    a = a.copy()
    for _ in range(DESCENTS):
        for r in range(len(g)):
            if g[r, r] > 1e-12:
                a[:, r] = np.maximum(0, a[:, r] + (m[:, r] - a @ g[:, r]) / g[r, r])
    return a


def margin(g_least: float, smoothness: float) -> int:
    """Rows beyond which a smooth row's neighbours change it by less than 1e-12, for all alternations."""
    mu = smoothness / max(g_least, 1e-12)
    decay = (1 + 2 * mu - np.sqrt(1 + 4 * mu)) / (2 * mu)
    return int(np.ceil(np.log(1e-12) / np.log(decay))) + 1


# ---- tables ----------------------------------------------------------------

_ROWS = "elem string, idx long, v array<double>, before array<double>"
Batches = Iterator[pa.RecordBatch]


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).ravel()))


def _matrix(column: pa.Array, rank: int) -> np.ndarray:
    """Lists of ``rank`` numbers as rows; null lists are zeros."""
    out = np.zeros((len(column), rank))
    known = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    if len(known):
        out[known] = column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, rank)
    return out


def _sums(a: np.ndarray, m: np.ndarray, g: np.ndarray, penalty: Penalty | None, rough: float = 0.0) -> np.ndarray:
    """What later passes need of a factor: its products, <M, A>, its penalties, its part of the objective with |model|^2."""
    cost = (penalty.sparsity * np.abs(a).sum() + penalty.smoothness / 2 * rough) if penalty else 0.0
    return np.concatenate([(a.T @ a).ravel(), [(m * a).sum(), cost, objective_rows(a, m, g, None).sum() + cost]])


def _updater(rank: int, products, penalty: Penalty | None, non_negative: bool) -> Callable[[Batches], Batches]:
    """Rows (elem, idx, v, m) to updated ones, then each element's sums of this task."""

    def run(batches: Batches) -> Batches:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            code = names.indices.to_numpy(zero_copy_only=False)
            a, m = _matrix(batch.column(2), rank), _matrix(batch.column(3), rank)
            new = a.copy()
            for k, name in enumerate(names.dictionary.to_pylist()):
                at = np.flatnonzero(code == k)
                g = products.value[name]
                if penalty is not None:
                    tried = alternated(a[at], m[at], g, penalty)
                    better = objective_rows(tried, m[at], g, penalty) <= objective_rows(a[at], m[at], g, penalty)
                    new[at] = np.where(better[:, None], tried, a[at])
                elif non_negative:
                    new[at] = descended(a[at], m[at], g)
                else:
                    new[at] = m[at] @ np.linalg.pinv(g)
                found = _sums(new[at], m[at], g, penalty)
                sums[name] = sums[name] + found if name in sums else found
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(new), pa.nulls(len(new), pa.list_(pa.float64()))], ["elem", "idx", "v", "before"])
        if sums:
            total = np.stack(list(sums.values()))
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.nulls(len(sums), pa.int64()), _lists(total), pa.nulls(len(sums), pa.list_(pa.float64()))], ["elem", "idx", "v", "before"])

    return run


def _smoother(rank: int, products, penalty: Penalty) -> Callable[[tuple, pa.Table], pa.Table]:
    """A block with its margins to its updated rows and both states' sums."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("idx").combine_chunks()
        own = table.column("own").to_numpy()
        idx = table.column("idx").to_numpy()
        a, m = (_matrix(table.column(c).combine_chunks(), rank) for c in ("v", "m"))
        g = products.value[key[0].as_py()]
        linked = (np.diff(idx) == 1).astype(float)
        new = alternated(a, m, g, penalty, linked)
        mine = np.flatnonzero(own)
        pairs = mine[mine < len(idx) - 1]  # a pair counts where its first row is
        rough = [float((linked[pairs, None] * (x[pairs + 1] - x[pairs]) ** 2).sum()) for x in (new, a)]
        both = [_sums(x[mine], m[mine], g, penalty, q)[None, :] for x, q in zip((new, a), rough, strict=True)]
        n = len(mine)
        columns = [pa.array([key[0].as_py()] * (n + 1), pa.string()), pa.array([*idx[mine].tolist(), None], pa.int64())]
        columns += [pa.concat_arrays([_lists(x[mine]), _lists(s)]) for x, s in zip((new, a), both, strict=True)]
        return pa.table(columns, ["elem", "idx", "v", "before"])

    return run


def _collected(rows: DataFrame, column: str, n: int) -> dict[str, np.ndarray]:
    """Arrays of ``n`` numbers, added up by element: a row for each element."""
    sums = rows.groupBy("elem").agg(*[F.sum(F.col(column)[i]) for i in range(n)]).collect()
    return {r[0]: np.array(r[1:], float) for r in sums}


@dataclass
class Factor:
    """One mode's written table, each element's sums (products of components, <M, A>, penalties, objective), and drawn rows."""

    rows: DataFrame  # (elem, idx, v)
    sums: dict[str, np.ndarray]
    draws: DataFrame | None = None  # (elem, _t, _i, _v, _p)


def _uniform(*parts: Column | int | str) -> Column:
    """A number in (0, 1) that only depends on its parts."""
    h = F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return (F.pmod(h, F.lit(1 << 52)) + 0.5) / float(1 << 52)


@dataclass
class Fit:
    """Factors (elem, mode, idx, r, value) and, for each sweep and element, its (sweep, elem, objective, error).

    The objective never rises; that of sampled passes is what their fibres tell (see :func:`residuals`).
    """

    factors: DataFrame
    history: list[tuple[int, str, float, float]]


@dataclass
class CP:
    """How to factor: the rank; full or sampled passes; penalties by mode, or non-negative or plain least squares."""

    rank: int
    non_negative: bool = True
    penalties: dict[str, Penalty] = field(default_factory=dict)
    samples: int = 0
    iterations: int = 50
    tolerance: float = 0.0
    seed: int = 0

    def fit(self, tensor: DataFrame, dims: list[str]) -> Fit:
        if set(self.penalties) - set(dims):
            raise ValueError("a penalty's mode is no dimension")
        known = tensor.select(F.col("elem").cast("string").alias("elem"), *[F.col(f"`{d}`").cast("long").alias(f"i{k}") for k, d in enumerate(dims)], F.col("value").cast("double").alias("value"))
        cells = keep(known.where(" AND ".join(f"{c} IS NOT NULL" for c in known.columns)), "cells")
        modes = range(len(dims))
        # repeated cells are one cell in the model, so |X|^2 is that of their sums
        norm = dict(cells.groupBy("elem", *[f"i{k}" for k in modes]).agg(F.sum("value").alias("x")).groupBy("elem").agg(F.sum(F.col("x") * F.col("x"))).collect())
        factors = [self._started(cells, k, dims[k]) for k in modes]
        history: list[tuple] = []
        last: dict[str, float] = {}
        for sweep in range(1, self.iterations + 1 if norm else 1):
            for k in modes:
                factors[k] = self._updated(cells, factors, k, dims[k], sweep)
            told = list(self._told(norm, factors, sweep))
            history += told
            if last and all(abs(e - last[elem]) < self.tolerance for _, elem, _, e in told):
                break
            last = {elem: e for _, elem, _, e in told}
        rows = [f.rows.select("elem", F.lit(d).alias("mode"), "idx", F.posexplode("v").alias("r", "value")) for f, d in zip(factors, dims, strict=True)]
        return Fit(reduce(DataFrame.union, rows), history)

    def _started(self, cells: DataFrame, k: int, dim: str) -> Factor:
        rows = cells.select("elem", F.col(f"i{k}").alias("idx")).distinct()
        v = F.array(*[_uniform(self.seed, dim, F.col("idx"), r) for r in range(self.rank)])
        p = self.penalties.get(dim)
        if p is not None and p.simplex:
            v = F.transform(v, lambda x: x / F.aggregate(v, F.lit(0.0), lambda s, y: s + y))
        rows = keep(rows.select("elem", "idx", v.alias("v")), "factor")
        n, weight = self.rank, p.sparsity if p else 0.0
        products = [F.sum(F.col("v")[i] * F.col("v")[j]) for i in range(n) for j in range(n)]
        cost = F.lit(weight) * F.sum(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.abs(x)))
        sums = {r[0]: np.array([*r[1 : n * n + 1], 0.0, r[-1], 0.0]) for r in rows.groupBy("elem").agg(*products, cost).collect()}
        return self._with_draws(Factor(rows, sums), 0, dim)

    def _product(self, factor: Factor, elem: str) -> np.ndarray:
        return factor.sums[elem][: self.rank**2].reshape(self.rank, self.rank)

    def _products_with(self, cells: DataFrame, tables: dict[int, DataFrame], k: int) -> DataFrame:
        """(elem, idx, m): cells times the rows of the other factors, by the index of mode k."""
        out = cells
        for j, f in tables.items():
            g = f.select(F.col("elem").alias(f"_e{j}"), F.col("idx").alias(f"_i{j}"), F.col("v").alias(f"_v{j}"))
            out = out.join(g, (F.col("elem") == F.col(f"_e{j}")) & (F.col(f"i{j}") == F.col(f"_i{j}")))
        term = lambda r: reduce(lambda x, j: x * F.col(f"_v{j}")[r], tables, F.col("value"))
        sums = out.groupBy("elem", F.col(f"i{k}").alias("idx")).agg(*[F.sum(term(r)).alias(f"_m{r}") for r in range(self.rank)])
        return sums.select("elem", "idx", F.array(*[f"_m{r}" for r in range(self.rank)]).alias("m"))

    def _updated(self, cells: DataFrame, factors: list[Factor], k: int, dim: str, sweep: int) -> Factor:
        others = [j for j in range(len(factors)) if j != k]
        if self.samples:
            m, g = self._sampled(cells, factors, k, dim, sweep)
        else:
            m = self._products_with(cells, {j: factors[j].rows for j in others}, k)
            g = {elem: np.prod([self._product(factors[j], elem) for j in others], axis=0) for elem in factors[k].sums}
        shared = cells.sparkSession.sparkContext.broadcast(g)  # r x r numbers an element
        rows = factors[k].rows.join(m, ["elem", "idx"], "left").select("elem", "idx", "v", "m")
        p, n = self.penalties.get(dim), self.rank**2 + 3
        if p is None or not p.smoothness:
            table = keep(rows.mapInArrow(_updater(self.rank, shared, p, self.non_negative), _ROWS), "factor")
            found = Factor(table.where("idx IS NOT NULL").select("elem", "idx", "v"), _collected(table.where("idx IS NULL"), "v", n))
        else:
            reach = INNER * max(margin(float(np.trace(x)) / self.rank, p.smoothness) for x in g.values())
            block = F.floor(F.col("idx") / BLOCK)
            reached = F.sequence(F.floor((F.col("idx") - reach) / BLOCK), F.floor((F.col("idx") + reach) / BLOCK))
            spread = rows.withColumn("block", F.explode(reached)).withColumn("own", F.col("block") == block)
            spread = spread.join(rows.select("elem", block.alias("block")).distinct(), ["elem", "block"], "left_semi")
            table = keep(spread.groupBy("elem", "block").applyInArrow(_smoother(self.rank, shared, p), _ROWS), "factor")
            values, totals = table.where("idx IS NOT NULL"), table.where("idx IS NULL")
            new, old = _collected(totals, "v", n), _collected(totals, "before", n)
            worse = [elem for elem in new if new[elem][-1] > old[elem][-1]]
            v = F.when(F.col("elem").isin(worse), F.col("before")).otherwise(F.col("v")) if worse else F.col("v")
            found = Factor(values.select("elem", "idx", v.alias("v")), new | {elem: old[elem] for elem in worse})
        return self._with_draws(found, sweep, dim)

    def _sampled(self, cells: DataFrame, factors: list[Factor], k: int, dim: str, sweep: int) -> tuple[DataFrame, dict[str, np.ndarray]]:
        """M and G of mode k from ``samples`` drawn fibres."""
        others = [j for j in range(len(factors)) if j != k]
        paired = []
        for j in others:
            # rows in random order, another one for each pass: ``samples`` rows an element
            order = Window.partitionBy("elem").orderBy(_uniform(self.seed, f"{sweep}:{dim}:{j}", F.col("elem"), F.col("_t")), "_t")
            renamed = [F.col(c).alias(f"{c}{j}") for c in ("_i", "_v", "_p")]
            paired.append(factors[j].draws.select("elem", F.row_number().over(order).alias("_s"), *renamed))
        tuples = reduce(lambda a, b: a.join(b, ["elem", "_s"]), paired)
        p = reduce(lambda x, y: x * y, [F.col(f"_p{j}") for j in others])
        v = reduce(lambda x, c: F.zip_with(x, F.col(c), lambda a, b: a * b), [f"_v{j}" for j in others[1:]], F.col(f"_v{others[0]}"))
        weighted = tuples.select("elem", *[f"_i{j}" for j in others], v.alias("_z"), (F.lit(1.0) / (self.samples * p)).alias("_w"))
        fibres = keep(weighted.groupBy("elem", *[f"_i{j}" for j in others]).agg(F.first("_z").alias("_z"), F.sum("_w").alias("_w")), "fibres")
        r = self.rank
        rows = fibres.groupBy("elem").agg(*[F.sum(F.col("_w") * F.col("_z")[i] * F.col("_z")[j]) for i in range(r) for j in range(r)]).collect()
        g = {x[0]: np.array(x[1:], float).reshape(r, r) for x in rows}
        on = reduce(lambda a, j: a & (F.col(f"i{j}") == F.col(f"_i{j}")), others, F.col("elem") == F.col("_e"))
        hit = cells.join(fibres.withColumnRenamed("elem", "_e"), on)
        sums = hit.groupBy("elem", F.col(f"i{k}").alias("idx")).agg(*[F.sum(F.col("value") * F.col("_w") * F.col("_z")[i]).alias(f"_m{i}") for i in range(r)])
        zero = np.zeros((r, r))
        return sums.select("elem", "idx", F.array(*[f"_m{i}" for i in range(r)]).alias("m")), {elem: g.get(elem, zero) for elem in factors[k].sums}

    def _with_draws(self, factor: Factor, sweep: int, dim: str) -> Factor:
        """The factor with ``samples`` of its rows by leverage, one from each stratum of the running sum."""
        if not self.samples:
            return factor
        n, r, name = self.samples, self.rank, f"{sweep}:{dim}"
        inverses = factor.rows.sparkSession.sparkContext.broadcast({e: np.linalg.pinv(self._product(factor, e), hermitian=True) for e in factor.sums})

        def scores(batches: Batches) -> Batches:
            for batch in batches:
                v, out = _matrix(batch.column(2), r), np.zeros(len(batch))
                names = batch.column(0).dictionary_encode()
                code = names.indices.to_numpy(zero_copy_only=False)
                for c, elem in enumerate(names.dictionary.to_pylist()):
                    at = np.flatnonzero(code == c)
                    out[at] = np.maximum(((v[at] @ inverses.value[elem]) * v[at]).sum(axis=1), 0)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out)], ["elem", "idx", "v", "l"])

        scored = factor.rows.select("elem", "idx", "v").mapInArrow(scores, "elem string, idx long, v array<double>, l double").withColumn("_b", F.floor(F.col("idx") / BLOCK))
        blocks = scored.groupBy("elem", "_b").agg(F.sum("l").alias("_n"))
        earlier = Window.partitionBy("elem").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
        whole = Window.partitionBy("elem")
        blocks = blocks.select("elem", "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0.0)).alias("_from"), F.sum("_n").over(whole).alias("_all")).where("_all > 0")
        so_far = Window.partitionBy("elem", "_b").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
        placed = scored.withColumn("_to", F.sum("l").over(so_far)).join(blocks, ["elem", "_b"])
        scale = F.lit(float(n)) / F.col("_all")
        stop, start = (F.col("_from") + F.col("_to")) * scale, (F.col("_from") + F.col("_to") - F.col("l")) * scale
        strata = F.sequence(F.greatest(F.floor(start), F.lit(0)), F.least(F.floor(stop), F.lit(n - 1)))
        hits = placed.where("l > 0").select("elem", "idx", "v", (F.col("l") / F.col("_all")).alias("_p"), start.alias("_a"), stop.alias("_z"), F.explode(F.when(F.floor(start) <= n - 1, strata)).alias("_t"))
        point = F.col("_t") + _uniform(self.seed, name, F.col("elem"), F.col("_t"))
        hits = hits.where((point >= F.col("_a")) & (point < F.col("_z"))).select("elem", "_t", F.col("idx").alias("_i"), F.col("v").alias("_v"), "_p")
        return Factor(factor.rows, factor.sums, keep(hits, "draws"))

    def _told(self, norm: dict[str, float], factors: list[Factor], sweep: int) -> Iterator[tuple]:
        """(sweep, elem, objective, error) after the last mode's pass."""
        for elem, s in sorted(factors[-1].sums.items()):
            fit = norm[elem] / 2 + s[-1] - s[-2]
            error = float(np.sqrt(max(2 * fit / norm[elem], 0.0))) if norm[elem] else 0.0
            yield sweep, elem, float(fit + sum(f.sums[elem][-2] for f in factors)), error


def residuals(tensor: DataFrame, dims: list[str], factors: DataFrame) -> DataFrame:
    """(elem, error): the exact relative error of factors, from one full pass: |X|^2 - 2 <X, model> + |model|^2."""
    rank = [F.col("elem"), F.col("r")]
    cells = tensor.select(F.col("elem").cast("string").alias("elem"), *[F.col(f"`{d}`").cast("long").alias(f"i{k}") for k, d in enumerate(dims)], F.col("value").cast("double").alias("value")).dropna()
    cells = cells.groupBy("elem", *[f"i{k}" for k in range(len(dims))]).agg(F.sum("value").alias("value"))
    out, product = cells, F.col("value")
    packed = factors.groupBy("elem", "mode", "idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "value"))), lambda s: s["value"]).alias("v"))
    for k, d in enumerate(dims):
        f = packed.where(F.col("mode") == d).select(F.col("elem").alias(f"_e{k}"), F.col("idx").alias(f"_i{k}"), F.col("v").alias(f"_v{k}"))
        out = out.join(f, (F.col("elem") == F.col(f"_e{k}")) & (F.col(f"i{k}") == F.col(f"_i{k}")))
    v = reduce(lambda x, k: F.zip_with(x, F.col(f"_v{k}"), lambda a, b: a * b), range(1, len(dims)), F.col("_v0"))
    inner = out.groupBy("elem").agg(F.sum(product * F.aggregate(v, F.lit(0.0), lambda s, x: s + x)).alias("_xm"), F.sum(product * product).alias("_xx"))
    pairs = packed.select("elem", "mode", F.posexplode("v").alias("r", "_a"), "v").select("elem", "mode", "r", "_a", F.posexplode("v").alias("s", "_b"))
    grams = pairs.groupBy("elem", "mode", "r", "s").agg(F.sum(F.col("_a") * F.col("_b")).alias("g"))
    model = grams.groupBy(*rank, "s").agg(F.aggregate(F.collect_list("g"), F.lit(1.0), lambda p, x: p * x).alias("g")).groupBy("elem").agg(F.sum("g").alias("_mm"))
    rest = F.greatest(F.col("_xx") - 2 * F.col("_xm") + F.col("_mm"), F.lit(0.0))
    return inner.join(model, "elem").select("elem", F.when(F.col("_xx") > 0, F.sqrt(rest / F.col("_xx"))).otherwise(0.0).alias("error"))
