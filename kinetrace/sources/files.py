"""Finding, listing, hashing and reading files through Spark's own readers."""

from __future__ import annotations

import json
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def natural_key(name: Column) -> list[Column]:
    """Sort keys that take every number in a name as a number: texts and numbers in turn, beginning with a text."""
    parts = F.regexp_extract_all(name, F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    plain = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
    # of two numbers the one with more digits is greater
    padded = F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), F.concat(F.lpad(F.length(plain(x)).cast("string"), 9, "0"), plain(x))).otherwise(x))
    return [F.when(name.rlike("^[0-9]"), F.concat(F.array(F.lit("")), padded)).otherwise(padded), name]


def find_paths(spark: SparkSession, folder: str, name_matches: str = ".*", folder_matches: str | None = None, depth: int = 6, natural: bool = True) -> DataFrame:
    """(path, name, folder, length) of files below ``folder`` whose name (and folder) match, up to ``depth`` folders down."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    root = F.regexp_replace(F.lit(folder.rstrip("/")), "^file:/*", "/")
    at = files.select(
        "path", "length", F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.regexp_replace(F.regexp_extract("path", "^(.*)/[^/]*$", 1), "^file:/*", "/").alias("folder")
    ).withColumn("_depth", F.size(F.split(F.col("folder"), "/")) - F.size(F.split(root, "/")))
    kept = at.where((F.col("_depth") <= depth) & F.col("name").rlike(name_matches))
    if folder_matches is not None:
        kept = kept.where(F.col("folder").rlike(folder_matches))
    kept = kept.select("path", "name", "folder", "length").distinct()
    return kept.orderBy("folder", *natural_key(F.col("name"))) if natural else kept


def manifest(spark: SparkSession, folder: str, method: str = "md5") -> DataFrame:
    """(path, length, hash) of every file: contents are hashed where they are read."""
    content = F.col("content")
    hashes = {"md5": F.md5(content), "sha1": F.sha1(content), "sha256": F.sha2(content, 256), "sha512": F.sha2(content, 512)}
    if method not in hashes:
        raise ValueError(f"method is one of {sorted(hashes)}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    base = folder.removeprefix("file://").rstrip("/")
    return files.select(F.regexp_replace("path", f"^(file:/*)?/*{base.lstrip('/')}/", "").alias("path"), "length", hashes[method].alias("hash"))


def compare_manifests(left: DataFrame, right: DataFrame) -> DataFrame:
    """(path, problem): files that one side lacks or whose contents differ."""
    l, r = left.alias("l"), right.alias("r")
    both = l.join(r, F.col("l.path") == F.col("r.path"), "full_outer")
    problem = F.when(F.col("l.path").isNull(), "missing left").when(F.col("r.path").isNull(), "missing right").when(F.col("l.hash") != F.col("r.hash"), "different")
    return both.select(F.coalesce("l.path", "r.path").alias("path"), problem.alias("problem")).where("problem IS NOT NULL")


def read_json(path: str) -> dict:
    return json.loads(Path(path).read_text())


def read_yaml(path: str) -> dict:
    """Safe YAML only; nothing in a file can make an object."""
    return yaml.safe_load(Path(path).read_text())


def write_json(value: dict, path: str, overwrite: bool = True, mkdir: bool = True) -> None:
    _prepare(path, overwrite, mkdir).write_text(json.dumps(value, indent=2))


def write_yaml(value: dict, path: str, overwrite: bool = True, mkdir: bool = True) -> None:
    _prepare(path, overwrite, mkdir).write_text(yaml.safe_dump(value, sort_keys=False))


def _prepare(path: str, overwrite: bool, mkdir: bool) -> Path:
    p = Path(path)
    if p.is_dir():
        raise IsADirectoryError(path)
    if p.exists() and not overwrite:
        raise FileExistsError(path)
    if not p.parent.exists():
        if not mkdir:
            raise FileNotFoundError(str(p.parent))
        p.parent.mkdir(parents=True)
    return p


def existing_file(path: str) -> str:
    if not Path(path).is_file():
        raise FileNotFoundError(path)
    return str(Path(path).resolve())


def folder_for(path: str, mkdir: bool = True, must_exist: bool = False) -> str:
    p = Path(path)
    if p.is_file():
        raise NotADirectoryError(path)
    if not p.exists():
        if must_exist or not mkdir:
            raise FileNotFoundError(path)
        p.mkdir(parents=True)
    return str(p.resolve())
