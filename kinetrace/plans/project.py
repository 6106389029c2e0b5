"""A project: configuration, run information and artefact tables under one folder.

Artefacts are Parquet tables at <folder>/analysis_files/<module>/<name>; the folder may
be any that Spark can write to. Side-cars are small YAML and JSON files.
"""

from __future__ import annotations

import platform
import sys
from datetime import datetime
from pathlib import Path

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrace.functions import params as P
from kinetrace.operators import cp, points, spectral, tensor, track
from kinetrace.sources import files
from kinetrace.storage import keep


def _now() -> str:
    return datetime.now().strftime("%Y-%m-%d %H:%M:%S")


def system_info() -> dict:
    """What a run's results may depend on."""
    return {"python": sys.version.split()[0], "platform": platform.platform(), "machine": platform.machine(), "pyspark": pyspark.__version__, "time": _now()}


class Project:
    """Configuration and artefacts of one project."""

    def __init__(self, folder: str, mkdir: bool = True, overwrite_config: bool = False) -> None:
        self.folder = Path(files.folder_for(folder, mkdir=mkdir))
        self.config_path, self.info_path = self.folder / "config.yaml", self.folder / "run_info.json"
        (self.folder / "analysis_files").mkdir(exist_ok=True)
        if overwrite_config or not self.config_path.exists():
            files.write_yaml({"general": {"date_created": _now(), "date_modified": _now()}, "paths": {"project": str(self.folder)}}, str(self.config_path))

    def config(self) -> dict:
        return files.read_yaml(str(self.config_path))

    def run_info(self) -> dict:
        return files.read_json(str(self.info_path)) if self.info_path.exists() else {}

    def save_config(self, module: str, values: dict, overwrite: bool = True) -> None:
        """Put a module's part of the configuration and note the time."""
        config = self.config()
        if module in config and not overwrite:
            raise KeyError(f"{module} is configured already")
        config[module] = values
        config["general"]["date_modified"] = _now()
        files.write_yaml(config, str(self.config_path))

    def save_run_info(self, module: str, values: dict, overwrite: bool = True) -> None:
        info = self.run_info()
        if module in info and not overwrite:
            raise KeyError(f"{module} has run information already")
        files.write_json({**info, module: values}, str(self.info_path))

    def path(self, module: str, name: str) -> str:
        return f"{self.folder}/analysis_files/{module}/{name}"

    def save(self, module: str, name: str, df: DataFrame, overwrite: bool = True, codec: str = "zstd", by: list[str] | None = None) -> None:
        """Write an artefact; with ``by``, only the partitions in ``df`` are replaced, and all files of a partition are written together."""
        writer = (df.repartition(*by) if by else df).write.option("compression", codec).mode("overwrite" if overwrite else "errorifexists")
        if by:
            writer = writer.partitionBy(*by).option("partitionOverwriteMode", "dynamic")
        writer.parquet(self.path(module, name))

    def load(self, spark: SparkSession, module: str, name: str) -> DataFrame:
        return spark.read.parquet(self.path(module, name))

    def tree(self) -> dict[str, list[str]]:
        """Artefacts by module."""
        base = self.folder / "analysis_files"
        return {m.name: sorted(x.name for x in m.iterdir()) for m in sorted(base.iterdir()) if m.is_dir()}


def run(spark: SparkSession, frames: DataFrame, home: DataFrame | None, params: dict, project: Project, videos: DataFrame | None = None, polygons: DataFrame | None = None) -> dict[str, DataFrame]:
    """The behavioural pipeline: track points, make spectra, factor them. Each step ends in an artefact table and the next begins from it.

    ``videos`` (video_id, num_frames, frame_rate) gives the frame rate where no clamp does; without either it is 60.
    Without ``home`` the points are a grid of ``points.spacing`` inside ``polygons`` (roi_id, ord, x, y).
    """
    p = P.resolved(params)
    steps, out = p["steps"], {}
    project.save_run_info("system", system_info())
    if home is None and "track" in steps:
        if polygons is None:
            raise ValueError("points or polygons are needed")
        size = frames.agg(F.max("height").alias("h"), F.max("width").alias("w")).first()
        inside = points.polygon_mask(points.pixels(spark, size["h"], size["w"]), polygons)
        home = keep(points.grid_points(points.mask_intersection(inside), p["points"]["spacing"]), "points")
    if "track" in steps:
        t = p["tracker"]
        found = track.track_points(frames, home, track.TrackerParams(**t), contiguous=p["videos"]["contiguous"])
        project.save("tracker", "tracks", found)
        project.save("tracker", "points", home)
        project.save_config("tracker", t)
        out["tracks"] = project.load(spark, "tracker", "tracks")
        n = out["tracks"].groupBy("video_id").agg((F.max("frame_idx") + 1).alias("num_frames"))
        bad = points.violation_fraction(out["tracks"].where("violation"), n)
        project.save_run_info("tracker", {"violation_fraction": {r["video_id"]: r["fraction"] for r in bad.collect()}})  # a row for each video
    if "spectra" in steps:
        s = p["spectra"]
        tracks, home = project.load(spark, "tracker", "tracks"), project.load(spark, "tracker", "points")
        rate = points.frame_rate(videos, p["videos"]["frame_rate_clamp"]).first()["frame_rate"] if videos is not None else p["videos"]["frame_rate_clamp"] or 60.0
        taps, hz = spectral.make_taps(rate, s["f_low"], s["f_high"], s["bins"], s["taps"], s["q_low"], s["q_high"], s["side"])
        traces = points.displacements(tracks, home)
        channels = spectral.packed(traces.withColumn("point_id", F.col("point_id").cast("int")))
        raw = spectral.vqt(channels, taps, s["pool"], s["padding"])
        project.save("spectra", "raw", raw)
        scaled = spectral.normalised(project.load(spark, "spectra", "raw"), list(hz), s["alpha"], s["exponent"], s["gamma"])
        project.save("spectra", "spectrogram", scaled)
        project.save_config("spectra", s)
        out["spectrogram"] = project.load(spark, "spectra", "spectrogram")
    if "factors" in steps:
        f = p["factors"]
        cells = project.load(spark, "spectra", "spectrogram").select(F.col("video_id").alias("elem"), F.col("axis").alias("xy"), F.col("point_id").alias("points"), F.col("f_idx").alias("frequency"), F.col("t_ds").alias("time"), F.abs("value").alias("value"))
        if f["elements"] == "concatenate":
            cells = tensor.concatenated(cells, "time")
        dims = ["xy", "points", "frequency", "time"]
        penalties = {d: cp.Penalty(**x) for d, x in (f["penalties"] or {}).items()}
        factors = cp.CP(f["rank"], f["non_negative"], penalties, f["samples"], f["iterations"], f["tolerance"], p["project"]["seed"]).fit(cells, dims).factors
        project.save("factors", "factors", factors)
        project.save_config("factors", f)
        out["factors"] = project.load(spark, "factors", "factors")
    return out


def run_many(spark: SparkSession, sessions: dict[str, tuple[DataFrame, DataFrame, dict]], folder: str) -> dict[str, dict[str, DataFrame]]:
    """Many sessions, each with its own parameters and project folder, in one application."""
    return {name: run(spark, frames, home, params, Project(f"{folder}/{name}")) for name, (frames, home, params) in sessions.items()}
