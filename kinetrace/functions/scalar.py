"""Scalar formulas as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def gaussian(x: Column, mu: float, sigma: float) -> Column:
    """The normal density."""
    return F.exp(-F.pow((x - mu) / sigma, F.lit(2)) / 2) / (math.sqrt(2 * math.pi) * sigma)


def log_spaced(spark: SparkSession, low: float, high: float, n: int) -> DataFrame:
    """(i, value): n values from low to high in equal ratios."""
    return spark.range(n).select(F.col("id").alias("i"), (low * F.pow(F.lit(high / low), F.col("id") / max(n - 1, 1))).alias("value"))


def log_spaced_between(low: Column, high: Column, n: int) -> Column:
    """An array of n values from low to high in equal ratios."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: low * F.pow(high / low, i / max(n - 1, 1)))


def raised_cosine(distance: Column, width: float) -> Column:
    """1 at a distance of 0, falling to 0 at half of ``width``."""
    return (F.cos(F.least(F.lit(math.pi), 2 * math.pi * distance / width)) + 1) / 2


def cosine_kernel(spark: SparkSession, size: int, width: float, centre: tuple[float, float]) -> DataFrame:
    """(y, x, value): a raised cosine that falls to 0 at half of ``width`` from the centre."""
    grid = spark.range(size * size).select(F.floor(F.col("id") / size).alias("y"), (F.col("id") % size).alias("x"))
    distance = F.sqrt(F.pow(F.col("y") - centre[0], F.lit(2)) + F.pow(F.col("x") - centre[1], F.lit(2)))
    return grid.select("y", "x", raised_cosine(distance, width).alias("value"))


def colour_map(value: Column, colours: list[tuple[float, float, float]]) -> list[Column]:
    """Red, green and blue of a value in 0..1, piecewise linear between the colours."""
    n = len(colours) - 1
    at = F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)) * n
    low = F.least(F.floor(at), F.lit(n - 1)).cast("int")
    channels = []
    for c, name in enumerate("rgb"):
        table = F.array(*[F.lit(float(x[c])) for x in colours])
        a, b = F.get(table, low), F.get(table, low + 1)
        channels.append((a + (b - a) * (at - low)).alias(name))
    return channels


def grey_to_rgb(value: Column) -> Column:
    """A grey value in three equal channels."""
    return F.array_repeat(value, 3)


def magnitude(re: Column, im: Column) -> Column:
    return F.hypot(re, im)


def polar(re: Column, im: Column) -> tuple[Column, Column]:
    return F.hypot(re, im).alias("magnitude"), F.atan2(im, re).alias("angle")
