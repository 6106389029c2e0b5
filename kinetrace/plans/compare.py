"""Comparing tables: within tolerances, and by keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def all_close(df: DataFrame, keys: list[str], left: str, right: str, atol: float = 1e-8, rtol: float = 1e-5, equal_nan: bool = True) -> DataFrame:
    """Per key whether |left - right| <= atol + rtol |right| everywhere, and the mean and greatest difference."""
    a, b = F.col(left), F.col(right)
    near = F.abs(a - b) <= atol + rtol * F.abs(b)
    if equal_nan:
        near = near | (F.isnan(a) & F.isnan(b))
    return df.groupBy(*keys).agg(F.bool_and(near).alias("same"), F.avg(F.abs(a - b)).alias("mean_difference"), F.max(F.abs(a - b)).alias("max_difference"), F.count("*").alias("n"))


def key_mismatches(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, problem) of keys that only one side has."""
    a, b = left.select(F.col(key).alias("a")), right.select(F.col(key).alias("b"))
    both = a.join(b, F.col("a") == F.col("b"), "full_outer").where("a IS NULL OR b IS NULL")
    return both.select(F.coalesce("a", "b").alias(key), F.when(F.col("a").isNull(), "missing left").otherwise("missing right").alias("problem"))


def tables_agree(left: DataFrame, right: DataFrame, keys: list[str], atol: float = 1e-8, rtol: float = 1e-5) -> bool:
    """Whether two tables have the same keys, and all their other columns agree; raises nothing, says so."""
    values = [c for c in left.columns if c not in keys]
    if sorted(left.columns) != sorted(right.columns):
        return False
    l, r = left.alias("l"), right.alias("r")
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    both = l.withColumn("_l", F.lit(1)).alias("l").join(r.withColumn("_r", F.lit(1)).alias("r"), on, "full_outer")
    bad = F.col("l._l").isNull() | F.col("r._r").isNull()
    for c in values:
        a, b = F.col(f"l.{c}"), F.col(f"r.{c}")
        if dict(left.dtypes)[c] in ("double", "float"):
            same = (F.abs(a - b) <= atol + rtol * F.abs(b)) | a.eqNullSafe(b)
        else:
            same = a.eqNullSafe(b)
        bad = bad | ~F.coalesce(same, F.lit(False))
    return not both.where(bad).head(1)
