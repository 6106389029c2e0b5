"""Shared scratch tables: the only place where intermediate results are kept.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``, the folder that
the driver and every executor can reach; an executor that is lost takes nothing
with it. The setting is read from the session and only set here when it is unset and
the master is local (tests, a laptop); a cluster without it is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The URI of the shared scratch folder of this session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='kinetrace-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Paths that this driver has given out and not yet deleted.
_GIVEN: list[str] = []


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, deleted by :func:`cleanup` or when the driver's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/kinetrace/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    _GIVEN.append(path)
    return path


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it as read back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cleanup(spark: SparkSession) -> int:
    """Delete all scratch tables so far and forget cached ones; results that read them must have been written. The number of tables."""
    spark.catalog.clearCache()
    conf, path = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    n = len(_GIVEN)
    while _GIVEN:
        p = path(_GIVEN.pop())
        p.getFileSystem(conf).delete(p, True)
    return n
