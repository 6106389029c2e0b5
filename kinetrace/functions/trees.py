"""Nested values (JSON as VARIANT) as tables of paths, and their comparison.

A tree is a row's JSON text. Its leaves are rows (keys, path, kind, value): paths as in
``$.a[0].b``, keys that are not plain words in double quotes. Trees are opened level by
level, so the work is one pass for each level of the deepest one, and leaves of all trees
are spread like any rows, however large a tree is.

Defined cases: a null or malformed text has no leaves; a JSON null is a leaf of kind VOID
without a value; an empty object or array is a leaf with itself as its value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrace.storage import keep


def leaves(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, path, kind, value) of every leaf of the JSON texts in ``column``."""
    spark = df.sparkSession
    level = df.select(*keys, F.lit("$").alias("path"), F.try_parse_json(F.col(column)).alias("_v")).where("_v IS NOT NULL")
    found = []
    while True:
        known = level.select(*keys, "path", "_v", F.schema_of_variant("_v").alias("_s"), F.to_json("_v").alias("_j"))
        opened = F.col("_s").rlike("^(OBJECT|ARRAY)<") & ~F.col("_j").isin("{}", "[]")
        table = keep(known.select(*keys, "path", "_s", "_j", F.col("_v").cast("string").alias("_t"), opened.alias("_open")), "tree-level")
        kind = F.regexp_replace("_s", "[(<].*", "")
        found.append(table.where("NOT _open").select(*keys, "path", kind.alias("kind"), F.when(F.col("_s") != "VOID", F.col("_t")).alias("value")))
        inner = table.where("_open")
        if not inner.head(1):
            return reduce(DataFrame.union, found)
        inner = inner.select(*keys, "path", F.parse_json("_j").alias("_v"))
        parts = inner.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()).select(F.col("pos").alias("_pos"), F.col("key").alias("_key"), F.col("value").alias("_value")))
        name = F.when(F.col("_key").rlike(r"^[A-Za-z_]\w*$"), F.col("_key")).otherwise(F.concat(F.lit('"'), F.col("_key"), F.lit('"')))
        step = F.when(F.col("_key").isNotNull(), F.concat(F.lit("."), name)).otherwise(F.concat(F.lit("["), F.col("_pos").cast("string"), F.lit("]")))
        level = parts.select(*keys, F.concat("path", step).alias("path"), F.col("_value").alias("_v"))


def tree_differences(left: DataFrame, right: DataFrame, keys: list[str], column: str, atol: float = 1e-8, rtol: float = 1e-5) -> DataFrame:
    """(keys, path, left, right, problem): leaves that one side lacks or that differ; numbers differ beyond atol + rtol |right|."""
    number = lambda c: F.when(F.col(c).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), F.lit(True)).otherwise(False)
    a = leaves(left, keys, column).select(*[F.col(k).alias(f"_l{k}") for k in keys], F.col("path").alias("_lp"), number("kind").alias("_ln"), F.col("value").alias("left"), F.lit(True).alias("_in_left"))
    b = leaves(right, keys, column).select(*[F.col(k).alias(f"_r{k}") for k in keys], F.col("path").alias("_rp"), number("kind").alias("_rn"), F.col("value").alias("right"), F.lit(True).alias("_in_right"))
    on = reduce(lambda x, k: x & F.col(f"_l{k}").eqNullSafe(F.col(f"_r{k}")), keys, F.col("_lp") == F.col("_rp"))
    both = a.join(b, on, "full_outer")
    x, y = F.col("left").try_cast("double"), F.col("right").try_cast("double")
    near = F.when(F.col("_ln") & F.col("_rn"), F.abs(x - y) <= atol + rtol * F.abs(y)).otherwise((F.col("_ln") == F.col("_rn")) & F.col("left").eqNullSafe(F.col("right")))
    problem = F.when(F.col("_in_left").isNull(), "missing left").when(F.col("_in_right").isNull(), "missing right").when(~near, "differs")
    told = both.select(*[F.coalesce(f"_l{k}", f"_r{k}").alias(k) for k in keys], F.coalesce("_lp", "_rp").alias("path"), "left", "right", problem.alias("problem"))
    return told.where("problem IS NOT NULL")
