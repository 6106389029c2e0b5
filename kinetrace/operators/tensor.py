"""Tensors with named dimensions as long tables.

A tensor is (elem, <dims>, value). Rearranging is index arithmetic; joining elements
along a dimension shifts indices by the lengths before. Their decomposition is in
:mod:`kinetrace.operators.cp`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merged_dims(tensor: DataFrame, outer: str, inner: str, inner_length: int) -> tuple[DataFrame, str]:
    """Two dimensions in one: index outer * length(inner) + inner, named "(outer inner)"."""
    name = f"({outer} {inner})"
    rest = [c for c in tensor.columns if c not in (outer, inner, "value")]
    return tensor.select(*[F.col(f"`{c}`") for c in rest], (F.col(f"`{outer}`") * inner_length + F.col(f"`{inner}`")).alias(name), "value"), name


def interleaved(tensor: DataFrame, time: str) -> DataFrame:
    """Complex cells (re, im) as real ones, along time: 2 t and 2 t + 1."""
    rest = [c for c in tensor.columns if c not in (time, "re", "im")]
    part = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("re").alias("value")), F.struct(F.lit(1).alias("k"), F.col("im").alias("value"))))
    return tensor.select(*rest, time, part.alias("_p")).select(*rest, (F.col(time) * 2 + F.col("_p.k")).alias(time), F.col("_p.value").alias("value"))


def deinterleaved(tensor: DataFrame, time: str) -> DataFrame:
    """The complex cells back."""
    rest = [c for c in tensor.columns if c not in (time, "value")]
    at = lambda k: F.sum(F.when(F.col(time) % 2 == k, F.col("value")))
    return tensor.groupBy(*rest, F.floor(F.col(time) / 2).alias(time)).agg(at(0).alias("re"), at(1).alias("im"))


def windowed(tensor: DataFrame, trials: DataFrame, dim: str) -> DataFrame:
    """Cells inside each trial (trial_id, first, last), ends included, counted from its first."""
    return tensor.join(trials, F.col(dim).between(F.col("first"), F.col("last"))).withColumn(dim, F.col(dim) - F.col("first")).drop("first", "last")


def concatenated(tensor: DataFrame, dim: str) -> DataFrame:
    """All elements in one, "0", along ``dim``: each is shifted by the lengths of those before it."""
    lengths = tensor.groupBy("elem").agg((F.max(dim) + 1).alias("n"))
    before = Window.orderBy("elem").rowsBetween(Window.unboundedPreceding, -1)
    shift = lengths.select("elem", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    return tensor.join(shift, "elem").withColumn(dim, F.col(dim) + F.col("shift")).withColumn("elem", F.lit("0")).drop("shift")


def stacked(tensor: DataFrame, dim: str = "trials") -> DataFrame:
    """All elements in one, "0", with a new first dimension that numbers them."""
    ids = tensor.select("elem").distinct().select("elem", (F.row_number().over(Window.orderBy("elem")) - 1).cast("long").alias(dim))
    rest = [c for c in tensor.columns if c != "elem"]
    return tensor.join(ids, "elem").select(F.lit("0").alias("elem"), dim, *rest)


def split(factor: DataFrame, lengths: DataFrame) -> DataFrame:
    """A joined factor (idx, r, value) cut by elements (elem, n) in order: keys time_<elem>, own indices."""
    order = Window.orderBy("elem")
    ends = lengths.select("elem", F.sum("n").over(order).alias("end"), "n")
    at = (F.col("idx") >= F.col("end") - F.col("n")) & (F.col("idx") < F.col("end"))
    return factor.join(ends, at).select(F.concat(F.lit("time_"), "elem").alias("elem"), (F.col("idx") - F.col("end") + F.col("n")).alias("idx"), "r", "value")


def standardised(tensor: DataFrame, dims: list[str], centre: bool = True, scale: bool = True) -> DataFrame:
    """Minus the mean and over the sample deviation along all other dimensions."""
    over = tensor.groupBy("elem", *dims).agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    v = F.col("value")
    v = v - F.col("_m") if centre else v
    v = v / F.nullif("_s", F.lit(0.0)) if scale else v
    return tensor.join(over, ["elem", *dims]).withColumn("value", v).drop("_m", "_s")


def min_max(df: DataFrame, keys: list[str]) -> DataFrame:
    """Values scaled to 0..1 within each key."""
    over = df.groupBy(*keys).agg(F.min("value").alias("_a"), F.max("value").alias("_b"))
    return df.join(over, keys).withColumn("value", (F.col("value") - F.col("_a")) / F.nullif(F.col("_b") - F.col("_a"), F.lit(0.0))).drop("_a", "_b")


def mttkrp(tensor: DataFrame, factors: dict[str, DataFrame], mode: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(idx, r, value): sum over cells of value times the product of the other modes' factors (idx, r, value); each ``by`` for itself."""
    out, product, rank = tensor, F.col("value"), None
    for i, (dim, f) in enumerate((d, f) for d, f in factors.items() if d != mode):
        g = f.select(F.col("idx").alias(f"_i{i}"), F.col("r").alias(f"_r{i}"), F.col("value").alias(f"_v{i}"))
        on = F.col(dim) == F.col(f"_i{i}")
        out = out.join(g, on if rank is None else on & (F.col(rank) == F.col(f"_r{i}")))
        rank = rank or f"_r{i}"
        product = product * F.col(f"_v{i}")
    return out.groupBy(*by, F.col(mode).alias("idx"), F.col(rank).alias("r")).agg(F.sum(product).alias("value"))


def gram(factor: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(r, s, value): products of a factor's columns; each ``by`` for itself."""
    b = factor.select(*by, "idx", F.col("r").alias("s"), F.col("value").alias("_v"))
    return factor.join(b, [*by, "idx"]).groupBy(*by, "r", "s").agg(F.sum(F.col("value") * F.col("_v")).alias("value"))


def correlations(factor: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(r, s, corr): correlations of a factor's columns, without the identity; each ``by`` for itself."""
    a, b = factor, factor.select(*by, "idx", F.col("r").alias("_s"), F.col("value").alias("_v"))
    c = a.join(b, [*by, "idx"]).groupBy(*by, "r", F.col("_s").alias("s")).agg(F.corr("value", "_v").alias("corr"))
    return c.select(*by, "r", "s", (F.col("corr") - F.when(F.col("r") == F.col("s"), 1.0).otherwise(0.0)).alias("corr"))


def explained_variance(vectors: DataFrame, column: str, width: int) -> np.ndarray:
    """Shares of variance of the principal components of array rows: sums of products on the executors, eigenvalues here."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # around the first row, so that large means do no harm; count, sums and sums of products of one task
        origin, n, sums, products = None, 0, np.zeros(width), np.zeros((width, width))
        for p in parts:
            if len(p):
                x = np.stack(p[column].to_numpy()).astype(float)
                origin = x[0].copy() if origin is None else origin
                x -= origin
                n, sums, products = n + len(x), sums + x.sum(axis=0), products + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "mean": [(origin + sums / n).tolist()], "scatter": [(products - np.outer(sums, sums) / n).ravel().tolist()]})

    def added(p: pd.DataFrame) -> pd.DataFrame:
        n, mean, scatter = 0, np.zeros(width), np.zeros(width * width)
        for k, m, part in zip(p["n"], p["mean"], p["scatter"], strict=True):
            d = m - mean
            scatter += part + np.outer(d, d).ravel() * (n * k / (n + k))
            mean += d * k / (n + k)
            n += k
        return pd.DataFrame({"n": [n], "mean": [mean.tolist()], "scatter": [scatter.tolist()]})

    schema = "n long, mean array<double>, scatter array<double>"
    partial = vectors.select(column).where(F.col(column).isNotNull()).mapInPandas(run, schema)
    sums = partial.groupBy(F.spark_partition_id() % 64).applyInPandas(added, schema)
    total = added(sums.toPandas()).iloc[0]  # 64 rows of a fixed size
    c = np.reshape(total["scatter"], (width, width)) / max(total["n"] - 1, 1)
    w = np.linalg.eigvalsh(c)[::-1]
    return w / w.sum()


def polar_loadings(factor: DataFrame, points: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(point, r, magnitude, angle) of a factor whose first half of indices is x and second half y."""
    half = lambda k: F.sum(F.when(F.floor(F.col("idx") / points) == k, F.col("value")).otherwise(0.0))
    xy = factor.groupBy(*by, (F.col("idx") % points).alias("point"), "r").agg(half(0).alias("x"), half(1).alias("y"))
    return xy.select(*by, "point", "r", F.hypot("x", "y").alias("magnitude"), F.atan2("y", "x").alias("angle"))
